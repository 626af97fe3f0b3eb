"""Datasets: tables with a dense row_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resample import batches, collate, concat_datasets, subset


def array_dataset(*frames: DataFrame) -> DataFrame:
    """Columns of tables with equal row_ids 0..n-1 side by side; an error if their lengths differ."""
    sizes = {df.count() for df in frames}
    if len(sizes) > 1:
        raise ValueError(f"lengths differ: {sorted(sizes)}")
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, "row_id")
    return out


tensor_dataset = array_dataset


class DataLoader:
    """Batches of a dataset: as a table (``table``), or one after another on the driver. collate_fn makes a batch of its rows, a
    list of dicts, and replaces the columns as lists."""

    def __init__(self, dataset: DataFrame, batch_size: int = 32, shuffle: bool = False, drop_last: bool = False, random_state: int = 0, id_col: str = "row_id", collate_fn: Callable[[list[dict]], object] | None = None):
        self.collate_fn = collate_fn
        self.dataset, self.batch_size, self.drop_last, self.id_col = dataset, batch_size, drop_last, id_col
        self.shuffle, self.random_state = shuffle, random_state

    def table(self) -> DataFrame:
        return collate(batches(self.dataset, self.id_col, self.batch_size, self.shuffle, self.drop_last, self.random_state), self.dataset.columns)

    def __len__(self) -> int:
        n = self.dataset.count()
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self) -> Iterator:
        for row in self.table().orderBy("batch_id").toLocalIterator():
            batch = {c: row[c] for c in self.dataset.columns}
            if self.collate_fn:
                yield self.collate_fn([dict(zip(batch, values, strict=True)) for values in zip(*batch.values(), strict=True)])
            else:
                yield batch


def subset_dataset(dataset: DataFrame, indices: list[int]) -> DataFrame:
    return subset(dataset, "row_id", dataset.sparkSession.createDataFrame(list(enumerate(indices)), "pos long, row_id long"))


def concat_dataset(*frames: DataFrame) -> DataFrame:
    return concat_datasets(list(frames), "row_id")


def zeros(spark, n: int, width: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(0.0), width).alias("v"))


def ones(spark, n: int, width: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row_id"), F.array_repeat(F.lit(1.0), width).alias("v"))


def randn(spark, n: int, width: int, seed: int = 0) -> DataFrame:
    """Normal numbers by the Box-Muller transform of hashes of seed, row and column: the same on any number of partitions."""
    unit = lambda k, part: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(k), F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(unit(k, 0))) * F.cos(2 * F.pi() * unit(k, 1))
    return spark.range(n).select(F.col("id").alias("row_id"), F.array(*[normal(k) for k in range(width)]).alias("v"))
