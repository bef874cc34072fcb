"""Training-data operators: text, embedding and conversation jobs on Spark."""
