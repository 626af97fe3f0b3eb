"""K-means by aggregate steps, and density clustering by a grid join."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut
from .components import components
from .linear import summed
from .neighbors import distance


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows and points."""
    return np.stack([((x - m) ** 2).sum(axis=1) for m in points], axis=1)


@dataclass
class KMeans:
    """Lloyd steps from k-means++ (or random, or given) centroids; the best of n_init starts. labels are those of the last
    assignment, before the centroids' last move."""

    cols: list[str]
    id_col: str
    n_clusters: int = 8
    init: str | list[list[float]] = "kmeans++"
    max_iter: int = 300
    tol: float = 1e-4
    n_init: int = 10
    random_state: int = 0

    def _nearest(self, centroids: list[list[float]]) -> Column:
        """label (the first of the nearest) and squared distance d of each row, batch by batch."""
        points = np.array(centroids, float)

        @F.pandas_udf("label int, d double")
        def nearest(x: pd.Series) -> pd.DataFrame:
            d = squares(np.stack(x.to_numpy()).astype(float), points) if len(x) else np.zeros((0, len(points)))
            return pd.DataFrame({"label": d.argmin(axis=1), "d": d.min(axis=1)})

        return nearest(F.array(*[F.col(c).cast("double") for c in self.cols]))

    def assign(self, df: DataFrame, centroids: list[list[float]] | None = None) -> DataFrame:
        """df with label (the first of the nearest) and its squared distance."""
        best = self._nearest(self.cluster_centers_ if centroids is None else centroids)
        return df.withColumn("_b", best).withColumn("label", F.col("_b.label")).withColumn("squared_distance", F.col("_b.d")).drop("_b")

    def _start(self, df: DataFrame, seed: int) -> list[list[float]]:
        if not isinstance(self.init, str):
            return [list(map(float, p)) for p in self.init]
        u = (F.pmod(F.xxhash64(F.lit(seed), self.id_col), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        point = F.struct(*[F.col(c).cast("double").alias(c) for c in self.cols])
        if self.init == "random":
            return [list(r["p"]) for r in df.select(point.alias("p"), u.alias("u")).orderBy("u").limit(self.n_clusters).collect()]
        found = [list(df.agg(F.min_by(point, u).alias("p")).first()["p"])]
        while len(found) < self.n_clusters:
            # The least of -ln(u) / weight is a draw in proportion to the weights, here squared distances.
            d = F.col("_d")
            v = (F.pmod(F.xxhash64(F.lit(seed), F.lit(len(found)), self.id_col), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
            got = df.withColumn("_d", self._nearest(found)["d"]).agg(F.min_by(point, F.when(d > 0, F.try_divide(-F.ln(v), d))).alias("p")).first()["p"]
            if got is None:
                break
            found.append(list(got))
        return found

    def step(self, df: DataFrame, centroids: list[list[float]]) -> tuple[list[list[float]], float]:
        """One assignment and move, and the assignment's inertia: one pass, from which each task returns a cluster's rows and sums.
        An empty cluster takes the row farthest from its centroid."""
        k, p, points = len(centroids), len(self.cols), np.array(centroids, float)

        def work(x: np.ndarray) -> np.ndarray:
            d = squares(x, points)
            label = d.argmin(axis=1)
            sums = np.zeros((k, p + 1))
            for i in range(k):
                mine = label == i
                sums[i, 0], sums[i, 1:] = mine.sum(), x[mine].sum(axis=0)
            return np.append(sums.ravel(), d.min(axis=1).sum() if len(d) else 0.0)

        got = summed(df, [F.col(c) for c in self.cols], work)
        sums = got[:-1].reshape(k, p + 1)
        new = [(s[1:] / s[0]).tolist() if s[0] else None for s in sums]
        if None in new:
            a = self.assign(df, centroids)
            far = list(a.agg(F.max_by(F.struct(*[F.col(c).cast("double") for c in self.cols]), F.struct("squared_distance", self.id_col)).alias("p")).first()["p"])
            new = [far if v is None else v for v in new]
        return new, float(got[-1])

    def fit(self, df: DataFrame):
        best = None
        for run in range(self.n_init if isinstance(self.init, str) else 1):
            centers = self._start(df, self.random_state * 1000 + run)
            for n in range(1, self.max_iter + 1):
                used = centers
                centers, inertia = self.step(df, used)
                moved = max(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 for p, q in zip(used, centers, strict=True))
                if moved < self.tol:
                    break
            if best is None or inertia < best[0]:
                best = (inertia, centers, used, n)
        self.inertia_, self.cluster_centers_, self._assigned, self.n_iter_ = best
        return self

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).assign(df, self._assigned).drop("squared_distance")

    def predict(self, df: DataFrame) -> DataFrame:
        return self.assign(df).drop("squared_distance")

    def transform(self, df: DataFrame) -> DataFrame:
        """d0, d1, ..: distances to the centroids."""
        far = lambda m: F.sqrt(sum(((F.col(c).cast("double") - float(v)) * (F.col(c).cast("double") - float(v)) for c, v in zip(self.cols, m, strict=True)), F.lit(0.0)))
        return df.select("*", *[far(m).alias(f"d{i}") for i, m in enumerate(self.cluster_centers_)])

    def score(self, df: DataFrame) -> float:
        return -self.assign(df).agg(F.sum("squared_distance")).first()[0]


@dataclass
class DBSCAN:
    """Clusters of rows that chains of core rows connect. A border row belongs to the cluster of least number that reaches it;
    noise is -1. Clusters count by their least core id.

    Neighbours meet by grid cells of width eps in the first (at most three) columns: an equi-join, not all pairs."""

    cols: list[str]
    id_col: str
    eps: float = 0.5
    min_samples: int = 5
    metric: str = "euclidean"

    def neighbors(self, df: DataFrame) -> DataFrame:
        grid = self.cols[:3]
        cell = [F.floor(F.col(c).cast("double") / self.eps).cast("long") for c in grid]
        a = df.select(F.col(self.id_col).alias("a"), *[F.col(c).cast("double").alias(c) for c in self.cols], *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
        for i in range(len(grid)):
            a = a.withColumn(f"_c{i}", F.explode(F.array(*[F.col(f"_c{i}") + k for k in (-1, 0, 1)])))
        b = df.select(F.col(self.id_col).alias("b"), *[F.col(c).cast("double").alias(f"_t_{c}") for c in self.cols], *[c.alias(f"_c{i}") for i, c in enumerate(cell)])
        near = a.join(b, [f"_c{i}" for i in range(len(grid))]).where(distance(self.cols, self.metric) <= self.eps)
        return near.select("a", "b")

    def fit_predict(self, df: DataFrame) -> DataFrame:
        """df with label and is_core."""
        near = cut(self.neighbors(df))
        core = cut(near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= self.min_samples).select("a"))
        # A link of two core rows is needed in one direction only.
        inner = near.where("a < b").join(core, "a").join(core.select(F.col("a").alias("b")), "b").select("a", "b")
        found = components(inner)
        labels = core.join(found, core["a"] == found["id"], "left").select("a", F.coalesce("component", "a").alias("l"))
        labels = cut(labels)
        roots = labels.select("l").distinct()
        from .ordered import running

        named = running(roots, [F.col("l")], {"label": F.lit(1)}).select(F.col("l"), (F.col("label") - 1).cast("int").alias("label"))
        cores = labels.join(named, "l").select("a", "label")
        border = near.join(cores.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        out = df.join(cores, df[self.id_col] == cores["a"], "left").select(*[df[c] for c in df.columns], F.col("label").alias("_core"))
        out = out.join(border, out[self.id_col] == border["a"], "left")
        return out.select(*df.columns, F.coalesce("_core", "low", F.lit(-1)).alias("label"), F.col("_core").isNotNull().alias("is_core"))
