"""Order statistics of all that came before each date, for all dates at once, by a descent over the digits of ranks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import running, sized, written


def prefix_quantiles(rows: DataFrame, cell: str, period: str, value: str, dates: DataFrame, asks: Sequence[Callable[[Column], Column]], least: int = 1, bits: int = 8) -> DataFrame:
    """cell, as_of, ask, n and q: of each cell's n values from before each date (column as_of of dates), the one at each asked
    rank, from 1, among n. Cells and dates with fewer than `least` values before have no rows; nulls take no part.

    Values, counted by cell and date, are ranked by one distributed sort. Then the ranks' digits are fixed from the top: for
    every node that some date is at, one count by cell, date and next digit says, summed along dates, which digit each
    date's rank has. A level passes once over the rows of such nodes, and what a task holds of a node is a count a date and
    digit: no rows meet dates, and nothing in memory grows with the rows of a date, or with ties.
    """
    own = rows.where(F.col(cell).isNotNull() & F.col(period).isNotNull() & F.col(value).isNotNull())
    own = own.groupBy(F.col(cell).alias("cell"), F.col(period).cast("date").alias("t"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("w"))
    own = written(running(own, ["v", "t", "cell"], {"rank": "1"}), "ranked")
    total = own.count()
    levels = max(1, -(-max(total - 1, 1).bit_length() // bits))
    daily = own.groupBy("cell", "t").agg(F.sum("w").alias("w"))
    asked = dates.select(F.col("as_of").cast("date").alias("t")).distinct().crossJoin(sized(own.select("cell").distinct())).select("cell", "t", F.lit(None).cast("long").alias("w"))
    past = Window.partitionBy("cell").orderBy("t", F.col("w").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    counted = daily.unionByName(asked).withColumn("n", F.coalesce(F.sum("w").over(past), F.lit(0))).where(F.col("w").isNull() & (F.col("n") >= least))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ask"), rank(F.col("n")).cast("long").alias("k")) for i, rank in enumerate(asks)]))
    state = counted.select("cell", F.col("t").alias("as_of"), "n", each.alias("a")).select("cell", "as_of", "a.ask", "n", (F.col("a.k") - 1).alias("k"), F.lit(0).cast("long").alias("node"))
    state = written(state.where("k >= 0 AND k < n"), "asked-ranks")

    def step(counts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        t, place = np.unique(counts["t"].to_numpy("datetime64[D]"), return_inverse=True)
        table = np.zeros((len(t) + 1, 1 << bits), np.int64)
        np.add.at(table, (place + 1, counts["digit"].to_numpy()), counts["w"].to_numpy())
        along = np.cumsum(np.cumsum(table, axis=0)[np.searchsorted(t, own["as_of"].to_numpy("datetime64[D]"), "left")], axis=1)
        k = own["k"].to_numpy()
        digit = (along <= k[:, None]).sum(axis=1)
        before = np.where(digit > 0, np.take_along_axis(along, np.maximum(digit - 1, 0)[:, None], 1)[:, 0], 0)
        return own.assign(k=k - before, node=own["node"].to_numpy() * (1 << bits) + digit)

    for level in range(levels - 1, -1, -1):
        shift, mask = level * bits, (1 << bits) - 1
        nodes = sized(state.select("cell", "node").distinct())
        some = own.select("cell", "t", "w", F.expr(f"shiftright(rank, {shift + bits})").alias("node"), F.expr(f"cast(shiftright(rank, {shift}) & {mask} AS int)").alias("digit"))
        counts = some.join(nodes, ["cell", "node"]).groupBy("cell", "node", "t", "digit").agg(F.sum("w").alias("w"))
        found = counts.groupBy("cell", "node").cogroup(state.groupBy("cell", "node")).applyInPandas(step, "cell string, as_of date, ask int, n long, k long, node long")
        state = written(found, "asked-ranks")
    return state.join(own.select(F.col("rank").alias("node"), F.col("v").alias("q")), "node").select("cell", "as_of", "ask", "n", "q")
