"""Price bands for markets that close: a Spark library."""
