"""Exact nearest neighbours of a stated set of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(cols: list[str], metric: str = "euclidean", p: float = 2, a: str = "", b: str = "_t_") -> Column:
    d = [F.abs(F.col(f"{a}{c}").cast("double") - F.col(f"{b}{c}").cast("double")) for c in cols]
    if metric == "euclidean":
        return F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    if metric == "manhattan":
        return sum(d, F.lit(0.0))
    return F.pow(sum((F.pow(x, F.lit(float(p))) for x in d), F.lit(0.0)), F.lit(1.0 / p))


@dataclass
class _Neighbors:
    """Queries meet all training rows; each task keeps the k nearest of a query before anything is shuffled (Spark turns the
    rank filter into group limits on either side of the exchange)."""

    cols: list[str]
    label: str
    id_col: str
    n_neighbors: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    p: float = 2
    #: Queries are rows of the training table too, and no row is its own neighbour.
    others_only: bool = False

    def fit(self, df: DataFrame):
        self.train_ = df.select(F.col(self.id_col).alias("_t_id"), F.col(self.label).alias("_t_y"), *[F.col(c).alias(f"_t_{c}") for c in self.cols])
        return self

    def kneighbors(self, df: DataFrame) -> DataFrame:
        """query id, neighbour id, y, distance, rank (ties by neighbour id)."""
        pairs = df.select(F.col(self.id_col).alias("_q_id"), *self.cols).crossJoin(self.train_)
        if self.others_only:
            pairs = pairs.where(~F.col("_q_id").eqNullSafe(F.col("_t_id")))
        pairs = pairs.select("_q_id", "_t_id", "_t_y", distance(self.cols, self.metric, self.p).alias("d"))
        w = Window.partitionBy("_q_id").orderBy("d", "_t_id")
        near = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.n_neighbors)
        return near.select(F.col("_q_id").alias(self.id_col), F.col("_t_id").alias("neighbor"), F.col("_t_y").alias("y"), F.col("d").alias("distance"), "rank")

    def _weight(self) -> Column:
        return F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-10))


class KNNClassifier(_Neighbors):
    def votes(self, df: DataFrame) -> DataFrame:
        return self.kneighbors(df).groupBy(self.id_col, "y").agg(F.sum(self._weight()).alias("w"))

    def transform(self, df: DataFrame) -> DataFrame:
        """prediction: the class of most weight, the smallest of several."""
        best = self.votes(df).groupBy(self.id_col).agg(F.max("w").alias("m"), F.collect_list(F.struct("w", "y")).alias("v"))
        top = F.array_min(F.transform(F.filter("v", lambda x: x["w"] == F.col("m")), lambda x: x["y"]))
        return df.join(best.select(self.id_col, top.alias("prediction")), self.id_col)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """id, y, probability: the classes that a query's neighbours have."""
        total = F.sum("w").over(Window.partitionBy(self.id_col))
        return self.votes(df).select(self.id_col, "y", (F.col("w") / total).alias("probability"))


class KNNRegressor(_Neighbors):
    def transform(self, df: DataFrame) -> DataFrame:
        w = self._weight()
        means = self.kneighbors(df).groupBy(self.id_col).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))
        return df.join(means, self.id_col)
