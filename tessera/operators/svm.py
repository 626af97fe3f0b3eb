"""Kernel machines. Training solves the dual over all rows on the driver, by working sets: it holds the features and some numbers a
row, and kernel values only block by block, so memory grows with the rows and time with rows times support vectors. Products of many
rows with a working set are dealt to the executors, which hold the features, too. Scoring is a kernel product with the support vectors,
batch by batch on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _decay(s: np.ndarray) -> np.ndarray:
    """Exponentials in place, of 1 at most."""
    return np.exp(np.minimum(s, 0, out=s), out=s)


@dataclass
class _Kernel:
    cols: list[str]
    label: str
    C: float = 1.0
    kernel: str = "rbf"
    gamma: str | float = "scale"
    degree: int = 3
    coef0: float = 0.0
    tol: float = 1e-3
    max_iter: int = 1000
    max_rows: int | None = None

    def _data(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of all rows, in an order of their own. With max_rows, more rows are an error (never a sample)."""
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in self.cols], F.col(self.label).alias("_y"))
        got = (rows if self.max_rows is None else rows.limit(self.max_rows + 1)).toArrow()
        if self.max_rows is not None and len(got) > self.max_rows:
            raise ValueError(f"more than max_rows={self.max_rows} rows: use a linear model")
        x, y = np.empty((len(got), len(self.cols))), got["_y"].to_pandas().to_numpy()
        for k in range(len(self.cols)):
            x[:, k] = got.column(k).to_numpy()
        del got
        order = np.lexsort([np.unique(y, return_inverse=True)[1], *x.T[::-1]])
        x, y = x[order], y[order]
        self.gamma_ = {"scale": lambda: 1 / (x.shape[1] * (x.var() or 1.0)), "auto": lambda: 1 / x.shape[1]}[self.gamma]() if isinstance(self.gamma, str) else self.gamma
        return x, y

    @staticmethod
    def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows as they come from _data, with equal ones (features and label) as one, and their numbers. Their weights count only by
        their sum, so that one row with bounds as many times as wide has the same optimum."""
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1) | (y[1:] != y[:-1]))[: len(x)])
        return x[first], y[first], np.diff(np.append(first, len(x))).astype(float)

    def _gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "rbf":  # the exponent is one matrix product, of the vectors with their lengths beside them
            p = np.column_stack([a * (2 * self.gamma_), (a * a).sum(1) * -self.gamma_, np.ones(len(a))])
            s = p @ np.column_stack([b, np.ones(len(b)), (b * b).sum(1) * -self.gamma_]).T
            parts = [s[k : k + BLOCK] for k in range(0, len(s), BLOCK)]
            if len(parts) == 1:
                return _decay(s)
            with ThreadPoolExecutor(4) as pool:  # a working set's, on the driver
                list(pool.map(_decay, parts))
            return s
        s = a @ b.T
        return {"linear": lambda: s, "poly": lambda: (self.gamma_ * s + self.coef0) ** self.degree, "sigmoid": lambda: np.tanh(self.gamma_ * s + self.coef0)}[self.kernel]()

    def _product(self, rows: np.ndarray, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Kernel values of rows and vectors times the weights, by blocks of BLOCK rows and vectors."""
        out = np.zeros(len(rows))
        for a in range(0, len(rows), BLOCK):
            for b in range(0, len(vectors), BLOCK):
                out[a : a + BLOCK] += self._gram(rows[a : a + BLOCK], vectors[b : b + BLOCK]) @ weights[b : b + BLOCK]
        return out

    def _bare(self) -> _Kernel:
        """Without machines, to be sent to executors."""
        kernel = copy(self)
        for name in ("machine_", "machines_"):
            kernel.__dict__.pop(name, None)
        return kernel

    @contextmanager
    def _products(self, x: np.ndarray, spark: SparkSession | None) -> Iterator[Callable]:
        """_product of all rows with some of them, given by number. Of more than ALONE rows, each task takes a run of whole blocks, so
        that values do not depend on the number of tasks."""
        if spark is None or len(x) <= ALONE:
            yield lambda at, v: self._product(x, x[at], v)
            return
        sc, kernel, blocks = spark.sparkContext, self._bare(), -(-len(x) // BLOCK)
        shared, tasks = sc.broadcast(x), min(blocks, sc.defaultParallelism)

        def product(at: np.ndarray, v: np.ndarray) -> np.ndarray:
            def part(t: int) -> np.ndarray:
                rows = shared.value
                return kernel._product(rows[blocks * t // tasks * BLOCK : blocks * (t + 1) // tasks * BLOCK], rows[at], v)

            return np.concatenate(sc.range(tasks, numSlices=tasks).map(part).collect())

        try:
            yield product
        finally:
            shared.destroy()

    def _solve(self, x: np.ndarray, target: np.ndarray, low: np.ndarray, high: np.ndarray, epsilon: float, spark: SparkSession | None = None) -> tuple[np.ndarray, float]:
        """Weights and bias of the rows; at most max_iter pair steps a row. Without spark, on the driver alone."""
        with self._products(x, spark) as product:
            return dual(lambda at: self._gram(x[at], x[at]), product, target, low, high, epsilon, self.tol, self.max_iter * len(x))

    def _column(self, weights: np.ndarray, vectors: np.ndarray, bias: float) -> Column:
        """The machine's value for each row, in Arrow batches: kernel products block by block, so memory stays bounded."""
        kernel = self._bare()

        @F.pandas_udf("double")
        def value(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            return pd.Series(kernel._product(np.stack(x.to_numpy()).astype(float), vectors, weights) + float(bias))

        return value(F.array(*[F.col(c).cast("double") for c in self.cols]))


#: Rows and vectors of a block of kernel values (2 MB), and rows of a working set (134 MB of kernel values).
BLOCK, WORKING = 512, 4096

#: Rows whose products with a working set the driver takes on by itself.
ALONE = 8192


def _slopes(e: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """How much the dual gains by raising a weight, and loses by lowering it; -inf and inf where a bound forbids that."""
    up = np.where(w < high - 1e-12, e - np.where(w >= 0, epsilon, -epsilon), -np.inf)
    down = np.where(w > low + 1e-12, e - np.where(w > 0, epsilon, -epsilon), np.inf)
    return up, down


def _pairs(k: np.ndarray, e: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray, epsilon: float, tol: float, most: int) -> int:
    """Sequential minimal optimisation with the most violating pair, on the weights of a working set, in place. Returns the steps.

    Raising one weight and lowering another by the same amount keeps their sum. With an epsilon, a step ends at zero, where the
    slope jumps."""
    for n in range(most):
        up, down = _slopes(e, w, low, high, epsilon)
        i, j = int(up.argmax()), int(down.argmin())
        if not up[i] - down[j] >= tol:
            return n
        step = (up[i] - down[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, (0.0 if epsilon and w[i] < 0 else high[i]) - w[i], w[j] - (0.0 if epsilon and w[j] > 0 else low[j]))
        w[i] += step
        w[j] -= step
        e -= step * (k[i] - k[j])
    return most


def dual(gram: Callable, product: Callable, target: np.ndarray, low: np.ndarray, high: np.ndarray, epsilon: float, tol: float, most: int) -> tuple[np.ndarray, float]:
    """Weights of sum 0 within low and high that are best for weights . target - epsilon |weights| - weights . K weights / 2, and the
    bias; deterministic. gram(rows): their kernel values; product(rows, v): all rows' kernel values with those times v.

    Each turn solves the rows that violate optimality most, whose number is bounded, and then brings all rows up to date."""
    w, f, steps, bias = np.zeros(len(target)), np.zeros(len(target)), 0, 0.0
    while len(w):
        up, down = _slopes(target - f, w, low, high, epsilon)
        bias, gap = float(up.max() + down.min()) / 2, up.max() - down.min()
        if not gap >= tol or steps >= most:
            break
        at = np.unique(np.concatenate([np.argsort(-up, kind="stable")[: WORKING // 2], np.argsort(down, kind="stable")[: WORKING // 2]]))
        own = w[at]
        steps += _pairs(gram(at), (target - f)[at], own, low[at], high[at], epsilon, max(tol, gap / 10), most - steps)
        moved = own != w[at]
        f += product(at[moved], (own - w[at])[moved])
        w[at] = own
    return w, bias


@dataclass
class SVC(_Kernel):
    """Several classes: a machine for each pair, and a vote (ties to the first class)."""

    def fit(self, df: DataFrame):
        x, y, n = self._distinct(*self._data(df))
        self.classes_ = sorted(set(y.tolist()))
        self.machines_ = []
        for i, a in enumerate(self.classes_):
            for b in self.classes_[i + 1 :]:
                pick = (y == a) | (y == b)
                px, py, most = x[pick], np.where(y[pick] == b, 1.0, -1.0), n[pick] * self.C
                w, bias = self._solve(px, py, np.minimum(py, 0) * most, np.maximum(py, 0) * most, 0.0, df.sparkSession)
                sv = np.abs(w) > 1e-8
                self.machines_.append((a, b, w[sv], px[sv], bias))
        return self

    def decision_function(self) -> Column:
        if len(self.machines_) != 1:
            raise ValueError("decision_function is for two classes")
        return self._column(*self.machines_[0][2:])

    def transform(self, df: DataFrame) -> DataFrame:
        from .linear import with_argmax

        for n, m in enumerate(self.machines_):
            df = df.withColumn(f"_d{n}", self._column(*m[2:]))
        votes = []
        for c in self.classes_:
            won = [F.when((F.col(f"_d{n}") > 0) == F.lit(b == c), 1.0).otherwise(0.0) for n, (a, b, *_) in enumerate(self.machines_) if c in (a, b)]
            votes.append(sum(won, F.lit(0.0)))
        return with_argmax(df.withColumn("_v", F.array(*votes)), "_v", self.classes_).drop("_v", *[f"_d{n}" for n in range(len(self.machines_))])

    predict = transform


@dataclass
class SVR(_Kernel):
    """Epsilon-insensitive regression, as one dual over both signs of the error."""

    epsilon: float = 0.1

    def fit(self, df: DataFrame):
        x, y, n = self._distinct(*self._data(df))
        y, most = y.astype(float), n * self.C
        w, bias = self._solve(x, y, -most, most, self.epsilon, df.sparkSession)
        sv = np.abs(w) > 1e-10
        self.machine_ = (w[sv], x[sv], bias)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self._column(*self.machine_))

    predict = transform
