"""Exact decision trees, forests and boosting, grown level by level.

A level is one plan for all nodes of all trees: rows become counts by node, feature and value, running sums over the values give
every midpoint's gain, and the best split of a node is its row's maximum. Values of one node and feature are dealt to ranges where
there are many, so no task sorts them all. Only the splits come to the driver. Prediction walks all rows of a batch down a tree at
once, level by level."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from . import ordered
from .linear import with_argmax

TINY = 1e-10


def gini(counts: list[Column]) -> Column:
    n = sum(counts[1:], counts[0])
    return 1 - sum((c * c for c in counts[1:]), counts[0] * counts[0]) / (n * n)


def entropy(counts: list[Column]) -> Column:
    n = sum(counts[1:], counts[0])
    return -sum((c / n * F.log2(c / n + TINY) for c in counts[1:]), counts[0] / n * F.log2(counts[0] / n + TINY))


def variance(sums: list[Column]) -> Column:
    """Of count, sum and sum of squares."""
    n, s, ss = sums
    return F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0))


def prefix_deviations(y: np.ndarray) -> np.ndarray:
    """For each prefix of y the sum of distances to its median: two heaps hold the lower and the upper half."""
    low: list[float] = []
    high: list[float] = []
    sums, out = [0.0, 0.0], np.zeros(len(y))
    for i, v in enumerate(y.tolist()):
        if low and v < -low[0]:
            heapq.heappush(low, -v)
            sums[0] += v
        else:
            heapq.heappush(high, v)
            sums[1] += v
        if len(low) > len(high):
            v = -heapq.heappop(low)
            heapq.heappush(high, v)
            sums = [sums[0] - v, sums[1] + v]
        elif len(high) > len(low) + 1:
            v = heapq.heappop(high)
            heapq.heappush(low, -v)
            sums = [sums[0] + v, sums[1] - v]
        out[i] = sums[1] - sums[0] - high[0] * (len(high) - len(low))
    return out


class Absolute:
    """The criterion 'mae': mean distance to the median. Medians do not add up, so a node's rows of one feature meet in one task;
    more than ``max_rows`` of them are an error."""

    max_rows = 2_000_000

    def splits(self, rows: DataFrame, leaf: int) -> DataFrame:
        most = self.max_rows

        def best(g: pd.DataFrame) -> pd.DataFrame:
            if len(g) > most:
                raise ValueError(f"criterion 'mae' takes {most} rows a node at most: use 'mse'")
            g = g.sort_values(["v", "s1"])
            v, y, n = g["v"].to_numpy(), g["s1"].to_numpy(), len(g)
            left, right = prefix_deviations(y), prefix_deviations(y[::-1])[::-1]
            row = {"tree": g["tree"].iloc[0], "node": g["node"].iloc[0], "f": g["f"].iloc[0], "n": n, "median": float(np.median(y)), "gain": None, "threshold": None}
            cut_at = np.flatnonzero(v[1:] != v[:-1]) + 1
            cut_at = cut_at[(cut_at >= leaf) & (n - cut_at >= leaf)]
            if len(cut_at):
                gain = np.round(left[-1] / n - (left[cut_at - 1] + right[cut_at]) / n, 12)
                i = int(gain.argmax())
                if gain[i] > 1e-12:
                    row |= {"gain": float(gain[i]), "threshold": float((v[cut_at[i] - 1] + v[cut_at[i]]) / 2)}
            return pd.DataFrame([row])

        long = rows.select("tree", "node", "s1", F.posexplode("x").alias("f", "v"))
        found = long.groupBy("tree", "node", "f").applyInPandas(best, "tree int, node long, f int, n long, median double, gain double, threshold double")
        top = F.min(F.when(F.col("gain").isNotNull(), F.struct((-F.col("gain")).alias("g"), "f", "threshold"))).alias("b")
        each = found.groupBy("tree", "node").agg(F.max("n").alias("rows"), F.max("median").alias("median"), top)
        n = F.col("rows").cast("double")
        return each.select("tree", "node", n.alias("t0"), (n * F.col("median")).alias("t1"), F.lit(0.0).alias("t2"), "rows", (-F.col("b.g")).alias("gain"), F.col("b.f").alias("f"), F.col("b.threshold").alias("threshold"))


@dataclass
class Node:
    value: list[float]
    n: float
    impurity: float
    feature: int = -1
    threshold: float = 0.0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def walk(self):
        yield self
        if self.feature >= 0:
            yield from self.left.walk()
            yield from self.right.walk()


def scored(roots: list[Node], x: Column, leaf, weights: Column | None = None) -> Column:
    """The sum over trees of leaf(value), a list of numbers, of the leaf where each row ends: an array. weights: an array with a
    factor for each tree."""
    tables, weighted = [], weights is not None
    for root in roots:
        nodes = list(root.walk())
        at = {id(n): i for i, n in enumerate(nodes)}
        inner = [n.feature >= 0 for n in nodes]
        left = np.array([at[id(n.left)] if i else at[id(n)] for n, i in zip(nodes, inner, strict=True)])
        right = np.array([at[id(n.right)] if i else at[id(n)] for n, i in zip(nodes, inner, strict=True)])
        feature, threshold = np.array([max(n.feature, 0) for n in nodes]), np.array([n.threshold for n in nodes])
        tables.append((feature, threshold, left, right, np.array([leaf(n.value) for n in nodes], float)))

    @F.pandas_udf("array<double>")
    def value(rows: pd.Series, factors: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        v, row = np.stack(rows.to_numpy()).astype(float), np.arange(len(rows))
        total = 0
        for t, (feature, threshold, left, right, out) in enumerate(tables):
            at = np.zeros(len(rows), int)
            while True:
                # A missing value goes right, as no comparison with it holds.
                to = np.where(v[row, feature[at]] <= threshold[at], left[at], right[at])
                if (to == at).all():
                    break
                at = to
            factor = factors.str[t].to_numpy(float)[:, None] if weighted else 1.0
            total = total + out[at] * factor
        return pd.Series(list(total))

    return value(x, F.array().cast("array<double>") if weights is None else weights)


@dataclass
class Grower:
    """Growing of trees over rows with tree (int), w (weight), x (array of features) and the statistics' columns s0, s1, .."""

    n_features: int
    n_stats: int
    impurity: object
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    seed: int = 0

    def splits(self, rows: DataFrame) -> DataFrame:
        """Of each (tree, node): totals t*, and the best split's gain, f and threshold (null if there is none)."""
        if isinstance(self.impurity, Absolute):
            return self.impurity.splits(self._tried(rows), self.min_samples_leaf)
        stats = [f"s{i}" for i in range(self.n_stats)]
        long = rows.select("tree", "node", *stats, F.posexplode("x").alias("f", "v"))
        cells = long.groupBy("tree", "node", "f", "v").agg(*[F.sum(s).alias(s) for s in stats], F.count("*").alias("rows"))
        if self.max_features and self.max_features < self.n_features:
            rank = F.row_number().over(Window.partitionBy("tree", "node").orderBy(F.xxhash64(F.lit(self.seed), "tree", "node", "f")))
            tried = cells.select("tree", "node", "f").distinct().withColumn("r", rank).where(F.col("r") <= self.max_features).drop("r")
            searched = cells.join(tried, ["tree", "node", "f"])
        else:
            searched = cells
        c = self._running(searched, stats)
        left, total = [F.col(f"l_{s}") for s in stats], [F.col(f"t_{s}") for s in stats]
        right = [t - a for t, a in zip(total, left, strict=True)]
        size = (lambda s: sum(s[1:], s[0])) if self.impurity in (gini, entropy) else (lambda s: s[0])
        ok = F.col("next").isNotNull() & (F.col("lr") >= self.min_samples_leaf) & (F.col("tr") - F.col("lr") >= self.min_samples_leaf)
        gain = self.impurity(total) - (size(left) * self.impurity(left) + size(right) * self.impurity(right)) / size(total)
        found = c.where(ok).select("tree", "node", "f", ((F.col("v") + F.col("next")) / 2).alias("threshold"), gain.alias("gain"))
        # Of equal gains (to 12 digits: sums of floats differ in order) the first feature, then the lowest threshold.
        best = found.where("gain > 1e-12").groupBy("tree", "node").agg(F.min(F.struct((-F.round("gain", 12)).alias("g"), "f", "threshold")).alias("b"))
        whole = cells.where("f = 0").groupBy("tree", "node").agg(*[F.sum(s).alias(f"t{i}") for i, s in enumerate(stats)], F.sum("rows").alias("rows"))
        return whole.join(best, ["tree", "node"], "left").select(*whole.columns, (-F.col("b.g")).alias("gain"), F.col("b.f").alias("f"), F.col("b.threshold").alias("threshold"))

    def _tried(self, rows: DataFrame) -> DataFrame:
        if self.max_features and self.max_features < self.n_features:
            raise ValueError("criterion 'mae' looks at all features")
        return rows

    def _running(self, cells: DataFrame, stats: list[str]) -> DataFrame:
        """cells (tree, node, f, v, statistics, rows) with the next value, sums up to v (l_, lr) and of all values (t_, tr)."""
        keys, names = ["tree", "node", "f"], [*stats, "rows"]
        parts = math.ceil(cells.count() / ordered.ROWS)
        if parts <= 1:
            own, part = cells.withColumn("_part", F.lit(0)), []
        else:
            own = cut(cells.repartitionByRange(parts, *keys, "v").withColumn("_part", F.spark_partition_id()))
            part = ["_part"]
        w = Window.partitionBy(*keys, *part).orderBy("v")
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = own.select(*keys, "_part", "v", F.lead("v").over(w).alias("next"), *[F.sum(s).over(run).alias(f"l_{s}") for s in names], *[] if part else [F.sum(s).over(Window.partitionBy(*keys)).alias(f"t_{s}") for s in names])
        if part:
            # One row for each part of a node and feature: what its earlier parts hold, and where its next part begins.
            totals = own.groupBy(*keys, "_part").agg(F.min("v").alias("first"), *[F.sum(s).alias(s) for s in names])
            every = Window.partitionBy(*keys)
            before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            totals = totals.select(*keys, "_part", F.lead("first").over(every.orderBy("_part")).alias("then"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"b_{s}") for s in names], *[F.sum(s).over(every).alias(f"t_{s}") for s in names])
            c = c.join(totals, [*keys, "_part"]).select(*keys, "v", F.coalesce("next", "then").alias("next"), *[(F.col(f"l_{s}") + F.col(f"b_{s}")).alias(f"l_{s}") for s in names], *[f"t_{s}" for s in names])
        return c.withColumnsRenamed({"l_rows": "lr", "t_rows": "tr"})

    def grow(self, rows: DataFrame) -> dict[int, Node]:
        spark = rows.sparkSession
        rows = rows.withColumn("node", F.lit(1).cast("long"))
        trees: dict[int, Node] = {}
        by: dict[tuple[int, int], Node] = {}
        depth = 0
        while True:
            found = self.splits(rows).collect()  # one row for each node of this level
            chosen = []
            for r in found:
                stats = [float(r[f"t{i}"]) for i in range(self.n_stats)]
                node = Node(stats, sum(stats) if self.impurity in (gini, entropy) else stats[0], 0.0)
                key = (r["tree"], r["node"])
                by[key] = node
                if key[1] == 1:
                    trees[key[0]] = node
                else:
                    setattr(by[key[0], key[1] // 2], "right" if key[1] % 2 else "left", node)
                if r["f"] is not None and r["rows"] >= self.min_samples_split and (self.max_depth is None or depth < self.max_depth):
                    node.feature, node.threshold, node.gain = r["f"], r["threshold"], r["gain"]
                    chosen.append((r["tree"], r["node"], r["f"], float(r["threshold"])))
            if not chosen:
                return trees
            # As many rows as nodes split at this level.
            at = spark.createDataFrame(chosen, "tree int, node long, f int, threshold double")
            rows = rows.join(at, ["tree", "node"]).withColumn("node", 2 * F.col("node") + (F.get("x", F.col("f")) > F.col("threshold")).cast("long")).drop("f", "threshold")
            depth += 1
            if depth % 4 == 0:
                rows = cut(rows)


def feature_array(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


@dataclass
class _Tree:
    cols: list[str]
    label: str
    criterion: str = ""
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | str | None = None
    random_state: int = 0
    trees_: dict[int, Node] = field(default_factory=dict)

    classifier = True

    def _m(self) -> int | None:
        m = self.max_features
        return max(1, int({"sqrt": math.sqrt, "log2": math.log2}[m](len(self.cols)))) if isinstance(m, str) else m

    def _grower(self, k: int) -> Grower:
        impurity = {"gini": gini, "entropy": entropy, "mse": variance, "mae": Absolute()}[self.criterion or ("gini" if self.classifier else "mse")]
        return Grower(len(self.cols), k, impurity, self.max_depth, self.min_samples_split, self.min_samples_leaf, self._m(), self.random_state)

    def _stats(self, df: DataFrame, w: Column) -> tuple[list[Column], int]:
        if self.classifier:
            self.classes_ = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
            return [F.when(F.col(self.label) == F.lit(c), w).otherwise(0.0).alias(f"s{i}") for i, c in enumerate(self.classes_)], len(self.classes_)
        y = F.col(self.label).cast("double")
        return [w.alias("s0"), (w * y).alias("s1"), (w * y * y).alias("s2")], 3

    def fit(self, df: DataFrame):
        stats, k = self._stats(df, F.lit(1.0))
        self.trees_ = self._grower(k).grow(df.select(F.lit(0).alias("tree"), feature_array(self.cols).alias("x"), *stats))
        return self

    def _leaf(self, value: list[float]) -> list[float]:
        """Shares of the classes, or the mean (with 'mae': the median)."""
        return [v / sum(value) for v in value] if self.classifier else [value[1] / value[0]]

    def _means(self) -> Column:
        total = scored(list(self.trees_.values()), feature_array(self.cols), self._leaf)
        return F.transform(total, lambda v: v / float(len(self.trees_)))

    def transform(self, df: DataFrame) -> DataFrame:
        """prediction, and for classifiers probability (array in the order of classes_)."""
        if not self.classifier:
            return df.withColumn("prediction", self._means()[0])
        return with_argmax(df.withColumn("probability", self._means()), "probability", self.classes_)

    predict = transform

    @property
    def feature_importances_(self) -> list[float]:
        total = [0.0] * len(self.cols)
        for root in self.trees_.values():
            own = [0.0] * len(self.cols)
            for node in root.walk():
                if node.feature >= 0:
                    own[node.feature] += node.n * node.gain
            total = [t + v / (sum(own) + TINY) for t, v in zip(total, own, strict=True)]
        return [t / max(len(self.trees_), 1) for t in total]

    def score(self, df: DataFrame) -> float:
        from .metrics import accuracy_score, r2_score

        return self.transform(df).agg((accuracy_score if self.classifier else r2_score)(self.label, "prediction").alias("s")).first()["s"]


class DecisionTreeClassifier(_Tree):
    pass


class DecisionTreeRegressor(_Tree):
    classifier = False


@dataclass
class _Forest(_Tree):
    n_estimators: int = 100
    bootstrap: bool = True
    id_col: str | None = None

    def _weights(self, df: DataFrame) -> Column:
        """How often a tree's bootstrap holds a row: Poisson of mean 1, by a hash of row and tree (so reruns agree)."""
        if not self.bootstrap:
            return F.lit(1.0)
        row = F.xxhash64(*([self.id_col] if self.id_col else df.columns))
        u = F.pmod(F.xxhash64(F.lit(self.random_state), row, "tree"), F.lit(1 << 40)) / float(1 << 40)
        out, p, total = F.lit(0.0), math.exp(-1), 0.0
        for k in range(1, 9):
            total += p
            out, p = F.when(u >= total, float(k)).otherwise(out), p / k
        return out

    def fit(self, df: DataFrame):
        base = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1))))
        base = base.withColumn("w", self._weights(df)).where("w > 0")
        stats, k = self._stats(df, F.col("w"))
        self.trees_ = self._grower(k).grow(base.select("tree", feature_array(self.cols).alias("x"), *stats))
        return self

    def oob_score(self, df: DataFrame) -> float:
        """Accuracy of the trees that did not see a row, of rows that some tree did not see."""
        unseen = F.array(*[1.0 - self._weights_of(df, t) for t in self.trees_])
        votes = scored(list(self.trees_.values()), feature_array(self.cols), self._leaf, unseen)
        seen = with_argmax(df.withColumn("_v", votes).where(F.array_max("_v") > 0), "_v", self.classes_)
        from .metrics import accuracy_score

        return seen.agg(accuracy_score(self.label, "prediction").alias("s")).first()["s"]

    def _weights_of(self, df: DataFrame, tree: int) -> Column:
        row = F.xxhash64(*([self.id_col] if self.id_col else df.columns))
        u = F.pmod(F.xxhash64(F.lit(self.random_state), row, F.lit(tree)), F.lit(1 << 40)) / float(1 << 40)
        return F.when(u >= math.exp(-1), 1.0).otherwise(0.0)


@dataclass
class RandomForestClassifier(_Forest):
    max_features: int | str | None = "sqrt"


@dataclass
class RandomForestRegressor(_Forest):
    classifier = False


@dataclass
class GradientBoostingRegressor:
    """Trees on residuals, shrunk. train_loss_: the mean squared error before each tree."""

    cols: list[str]
    label: str
    id_col: str
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    subsample: float = 1.0
    min_samples_split: int = 2
    random_state: int = 0

    def _start(self, df: DataFrame) -> float:
        return df.agg(F.avg(F.col(self.label).cast("double"))).first()[0]

    def _residual(self) -> Column:
        return F.col("_y") - F.col("_f")

    def _boost(self, df: DataFrame, start: float) -> list[Node]:
        work = cut(df.withColumn("_f", F.lit(float(start))))
        trees, self.train_loss_ = [], []
        for t in range(self.n_estimators):
            res = work.withColumn("_r", self._residual())
            self.train_loss_.append(res.agg(F.avg(self._loss())).first()[0])
            some = res
            if self.subsample < 1:
                some = res.where(F.pmod(F.xxhash64(F.lit(self.random_state), F.lit(t), self.id_col), F.lit(1 << 40)) < int(self.subsample * (1 << 40)))
            tree = DecisionTreeRegressor(self.cols, "_r", max_depth=self.max_depth, min_samples_split=self.min_samples_split).fit(some).trees_[0]
            trees.append(tree)
            work = work.withColumn("_f", F.col("_f") + self.learning_rate * scored([tree], feature_array(self.cols), lambda v: [v[1] / v[0]])[0])
            if t % 5 == 4:
                work = cut(work)
        return trees

    def _loss(self) -> Column:
        return F.col("_r") * F.col("_r")

    def _raw(self, start: float, trees: list[Node]) -> Column:
        if not trees:
            return F.lit(float(start))
        return float(start) + self.learning_rate * scored(trees, feature_array(self.cols), lambda v: [v[1] / v[0]])[0]

    def fit(self, df: DataFrame):
        self.init_ = self._start(df)
        self.trees_ = self._boost(df.withColumn("_y", F.col(self.label).cast("double")), self.init_)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._raw(self.init_, self.trees_))

    predict = transform


@dataclass
class GradientBoostingClassifier(GradientBoostingRegressor):
    """Logistic loss; leaves are mean residuals. Several classes: one model each, softmax over their scores."""

    def _residual(self) -> Column:
        return F.col("_y") - 1 / (1 + F.exp(-F.col("_f")))

    def _loss(self) -> Column:
        return F.greatest("_f", F.lit(0.0)) - F.col("_f") * F.col("_y") + F.log1p(F.exp(-F.abs("_f")))

    def fit(self, df: DataFrame):
        self.classes_ = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
        self.models_ = []
        for c in self.classes_[1:] if len(self.classes_) == 2 else self.classes_:
            own = df.withColumn("_y", F.when(F.col(self.label) == F.lit(c), 1.0).otherwise(0.0))
            p = min(max(own.agg(F.avg("_y")).first()[0], 1e-6), 1 - 1e-6)
            start = math.log(p / (1 - p))
            self.models_.append((start, self._boost(own, start)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from ..functions.elementwise import sigmoid, softmax

        z = [self._raw(*m) for m in self.models_]
        prob = F.array(1 - sigmoid(z[0]), sigmoid(z[0])) if len(z) == 1 else softmax(F.array(*z))
        return with_argmax(df.withColumn("probability", prob), "probability", self.classes_)

    predict = transform
