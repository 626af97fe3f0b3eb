"""Labelled documents for the classifiers: a bounded sample, whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % mod).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bound: int) -> DataFrame:
    """text and label (0/1) of documents whose id is among the ``bound`` labelled ids of least hash for which ``usable`` holds; of
    these, the ``bound`` pairs of id and text of least hash. Rows with a null id or label are left out, an id with both labels
    counts as 1, and rows that repeat an id and a text count once. At most ``bound`` ids, and so many pairs, are broadcast.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    named = named.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    ids = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    pairs = rows.select("doc_id", "th").join(F.broadcast(ids), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "th"), "doc_id").limit(bound)
    return rows.join(F.broadcast(pairs), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("text", "label")
