"""Splits, folds and batches as columns: exact counts, reproducible, no row leaves its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import position


def train_test_split(df: DataFrame, id_col: str, test_size: float = 0.2, shuffle: bool = True, random_state: int = 0, stratify: str | None = None) -> DataFrame:
    """df with is_test: the first max(1, floor(n * test_size)) rows of the order (of each class, if stratified) are the test."""
    placed = position(df, id_col, random_state if shuffle else None, within=stratify)
    return placed.withColumn("is_test", F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("_n") * test_size))).drop("_pos", "_n")


def _folds(placed: DataFrame, n_splits: int) -> DataFrame:
    """Contiguous folds of the positions; the first n % n_splits hold one row more."""
    small, more = F.floor(F.col("_n") / n_splits), F.pmod("_n", F.lit(n_splits))
    edge = more * (small + 1)
    later = more + F.floor((F.col("_pos") - edge) / F.greatest(small, F.lit(1)))
    return placed.withColumn("fold", F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (small + 1))).otherwise(later).cast("int")).drop("_pos", "_n")


def kfold(df: DataFrame, id_col: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0) -> DataFrame:
    """df with fold (0..n_splits-1): contiguous in the order, the first n % n_splits folds hold one row more."""
    return _folds(position(df, id_col, random_state if shuffle else None), n_splits)


def stratified_kfold(df: DataFrame, id_col: str, label_col: str, n_splits: int = 5, shuffle: bool = False, random_state: int = 0) -> DataFrame:
    """The same within each class. A class may hold any share of the rows: its parts are counted and numbered apart."""
    return _folds(position(df, id_col, random_state if shuffle else None, within=label_col), n_splits)


def leave_one_out(df: DataFrame, id_col: str) -> DataFrame:
    return position(df, id_col, name="fold").drop("_n")


def batches(df: DataFrame, id_col: str, batch_size: int = 32, shuffle: bool = False, drop_last: bool = False, random_state: int = 0) -> DataFrame:
    """df with batch_id and place (position in the batch)."""
    placed = position(df, id_col, random_state if shuffle else None)
    out = placed.withColumn("batch_id", F.floor(F.col("_pos") / batch_size)).withColumn("place", F.pmod("_pos", F.lit(batch_size)))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return out.drop("_pos", "_n")


def collate(batched: DataFrame, columns: list[str]) -> DataFrame:
    """One row a batch: each column as an array in the order of place. A batch has batch_size rows at most."""
    rows = F.array_sort(F.collect_list(F.struct("place", *columns)))
    return batched.groupBy("batch_id").agg(rows.alias("_r")).select("batch_id", *[F.col(f"_r.{c}").alias(c) for c in columns])


def subset(df: DataFrame, id_col: str, indices: DataFrame) -> DataFrame:
    """indices (pos, row_id): the rows named, as often as they are named, with pos."""
    return indices.join(df, indices["row_id"] == df[id_col]).select("pos", *[df[c] for c in df.columns])


def concat_datasets(frames: list[DataFrame], id_col: str) -> DataFrame:
    """All rows, ids counted on from table to table; each table's ids must be 0..n-1."""
    out, begin = None, 0
    for df in frames:
        moved = df.withColumn(id_col, F.col(id_col) + begin)
        out = moved if out is None else out.unionByName(moved)
        begin += df.count()
    return out


def cross_val_score(make: Callable, df: DataFrame, id_col: str, label_col: str, cv: int = 5, scoring: str = "accuracy", random_state: int = 0) -> list[float]:
    """make() gives an estimator whose fit(df) gives a model whose transform adds ``prediction``. Accuracy splits by class."""
    from . import metrics as M

    folds = stratified_kfold(df, id_col, label_col, cv, True, random_state) if scoring == "accuracy" else kfold(df, id_col, cv, True, random_state)
    pick = {"accuracy": M.accuracy_score, "mse": M.mean_squared_error, "mae": M.mean_absolute_error, "r2": M.r2_score}[scoring]
    scores = []
    for k in range(cv):
        model = make().fit(folds.where(F.col("fold") != k).drop("fold"))
        scored = model.transform(folds.where(F.col("fold") == k).drop("fold"))
        scores.append(float(scored.agg(pick(label_col, "prediction").alias("s")).first()["s"]))
    return scores
