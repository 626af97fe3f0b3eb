"""Exact quantiles and modes of columns without gathering a column's values in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that each pass cuts a range into; what comes to the driver is so many rows for each rank that is sought.
BUCKETS = 512


def _long(df: DataFrame, values: list[Column]) -> DataFrame:
    """col (the column's place), v: all values that are not missing."""
    cells = F.array(*[F.struct(F.lit(i).alias("col"), v.cast("double").alias("v")) for i, v in enumerate(values)])
    return df.select(F.inline(cells)).where("v is not null and not isnan(v)")


def at_ranks(cells: DataFrame, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each (col, rank from 0). Each pass counts the buckets of the range in which a rank is known to lie, and narrows
    that range to the values in the rank's bucket; it ends when these are one value. No value is ever sorted."""
    spark = cells.sparkSession
    ends = {r["col"]: r for r in cells.groupBy("col").agg(F.min("v").alias("a"), F.max("v").alias("b")).collect()}  # one row a column
    open_ = {(c, k): (ends[c]["a"], ends[c]["b"], 0) for c, k in wanted}  # rank: range, rows below the range
    done: dict[tuple[int, int], float] = {}
    while True:
        done |= {at: a for at, (a, b, _) in open_.items() if a == b}
        open_ = {at: x for at, x in open_.items() if at not in done}
        if not open_:
            return done
        ranges = sorted({(c, a, b) for (c, _), (a, b, _) in open_.items()})
        number = {r: i for i, r in enumerate(ranges)}
        table = F.broadcast(spark.createDataFrame([(i, c, a, b) for (c, a, b), i in number.items()], "target int, col int, a double, b double"))  # one row a rank
        inside = cells.join(table, "col").where("v >= a and v <= b")
        part = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * BUCKETS), F.lit(BUCKETS - 1))
        rows = inside.groupBy("target", part.alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("target", "bucket").collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["target"], []).append(r)
        for at, (a, b, below) in list(open_.items()):
            for r in by[number[at[0], a, b]]:
                if at[1] < below + r["n"]:
                    open_[at] = (r["a"], r["b"], below)
                    break
                below += r["n"]


def quantiles(df: DataFrame, values: list[Column], q: list[float]) -> list[list[float | None]]:
    """For each column its quantiles q, interpolated between neighbours; None for a column without values."""
    cells = _long(df, values)
    n = {r["col"]: r["n"] for r in cells.groupBy("col").agg(F.count("*").alias("n")).collect()}  # one row a column
    place = {(c, p): (n[c] - 1) * p for c in n for p in q}
    wanted = sorted({(c, k) for (c, _), x in place.items() for k in (math.floor(x), math.ceil(x))})
    got = at_ranks(cells, wanted) if wanted else {}

    def one(c: int, p: float) -> float:
        x = place[c, p]
        low, high = got[c, math.floor(x)], got[c, math.ceil(x)]
        return low + (high - low) * (x - math.floor(x))

    return [[one(c, p) if c in n else None for p in q] for c in range(len(values))]


def modes(df: DataFrame, values: list[Column]) -> list[float | None]:
    """For each column its most frequent value, the smallest of several."""
    counts = _long(df, values).groupBy("col", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("col").agg(F.max(F.struct("n", (-F.col("v")).alias("v"))).alias("best")).collect()  # one row a column
    found = {r["col"]: -r["best"]["v"] for r in best}
    return [found.get(c) for c in range(len(values))]
