"""Joins whose left side may hold any share of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and than a 10,000th of all, is dealt to parts.
PART = 256


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", part: int | None = None) -> DataFrame:
    """left join right (inner or left) on keys that both have. left must be a written table, as it is counted first.

    A key of many rows on the left is dealt to parts of about ``part`` rows, and its rows on the right go to each part. No more keys
    than rows / part have parts, which is 10,000 at most, so the table of these keys is broadcast.
    """
    part = part or max(PART, left.count() // 10_000)
    counts = left.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > part)
    many = F.broadcast(counts.select(*keys, F.ceil(F.col("_rows") / part).cast("int").alias("_parts")))
    # Any part will do: a row's number spreads rows that are all alike.
    at = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")), F.lit(0)).cast("int")
    spread = left.join(many, keys, "left").withColumn("_at", at).drop("_parts")
    copied = right.join(many, keys, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return spread.join(copied, [*keys, "_at"], how).drop("_at")
