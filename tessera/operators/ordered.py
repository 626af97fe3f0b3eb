"""Running numbers and sums over a whole table without sending it to one task.

Rows are dealt to parts that follow the order, as many as the table needs for ROWS rows each. A part's rows are numbered or summed
by a window of their own, and the totals of the parts before it are added: one row a part, summed up in one small window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Rows of a part, about.
ROWS = 250_000


def _totals(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """parts (keys, _part, sums) with _b_<sum> of the parts before, and _n, the rows of all parts of the keys (from the sum "n")."""
    every = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*keys, "_part", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_b_{s}") for s in sums], F.sum("n").over(every).alias("_n"))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df dealt to ranges of the order (all of its columns, so that equal leading values are split, too), with _part; written
    down, as both the totals and the windows count on the same ranges."""
    parts = max(1, math.ceil(df.count() / ROWS))
    return cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with inclusive running sums in the order of ``order``. All columns of df are written down once: pass what is needed."""
    own = _ranged(df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()]), order)
    totals = own.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(f"_v_{n}").alias(f"t_{n}") for n in sums])
    totals = _totals(totals, [], [f"t_{n}" for n in sums])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.join(totals, "_part")
    return out.select(*df.columns, *[(F.sum(f"_v_{n}").over(w) + F.col(f"_b_t_{n}")).alias(n) for n in sums])


def shuffle_key(seed: int, key: Column) -> Column:
    """A reproducible random order: md5 of the seed and the row's key."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")).cast("binary"))


def position(df: DataFrame, id_col: str, seed: int | None = None, name: str = "_pos", within: str | None = None) -> DataFrame:
    """df with a dense position from 0, and _n, the number of rows: by id, or for a seed in a reproducible random order of the ids
    (unique, no nulls); of all rows, or within those of each value of one column.

    The random order needs no ranges: its parts are prefixes of the hash, counted in one scan, and rows move once. By id, ids
    alone are dealt to ranges and numbered, and rows are joined with their numbers.
    """
    keys = [within] if within else []
    pick = lambda c: F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    if seed is not None:
        bits = min(31, max(0, math.ceil(math.log2(max(1, df.count()) / ROWS))))
        lead = F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long")
        rows = df.withColumn("_md5", shuffle_key(seed, F.col(id_col))).withColumn("_part", F.shiftright(lead, 32 - bits) if bits else F.lit(0).cast("long"))
        order = F.col("r._md5")
    else:
        rows = _ranged(df.select(*{*keys, id_col}), [*[F.col(k) for k in keys], F.col(id_col)])
        order = F.col(f"r.{id_col}")
    totals = _totals(rows.groupBy(*keys, "_part").agg(F.count("*").alias("n")), keys, ["n"])
    on = F.col("r._part") == F.col("t._part")
    for k in keys:
        on = on & pick(k)
    nth = F.row_number().over(Window.partitionBy(*[F.col(f"r.{c}") for c in (*keys, "_part")]).orderBy(order)) - 1
    place = (nth + F.col("t._b_n")).cast("long").alias(name)
    out = rows.alias("r").join(totals.alias("t"), on)
    if seed is not None:
        return out.select(*[f"r.{c}" for c in df.columns], place, "t._n")
    numbered = out.select(F.col(f"r.{id_col}").alias(id_col), place, "t._n")
    return df.join(numbered, id_col).select(*[df[c] for c in df.columns], name, "_n")
