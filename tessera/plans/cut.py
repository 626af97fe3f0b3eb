"""Cutting lineage in iterative plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .shared import kept


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names: its columns can be pruned, and it survives lost executors."""
    return kept(df)
