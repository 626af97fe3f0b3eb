"""Linear models from one pass over the data: the Gram matrix of centred columns is all that they need."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """Rows and means. Rows with a missing value are the caller's concern."""
    row = df.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))])


def summed(df: DataFrame, cols: list[Column], work: Callable[[np.ndarray], np.ndarray], missing: bool = False) -> np.ndarray:
    """The sum of work(x) over all batches x of the columns (rows by columns, doubles; rows with a null are left out, or with
    ``missing`` hold NaN).

    Each task adds up one vector, whatever its rows; vectors are then added up in about the square root of so many tasks, so
    that the driver gets few of them. An empty table gives work(no rows).
    """
    names = [f"c{i}" for i in range(len(cols))]
    rows = df.select(*[c.cast("double").alias(n) for c, n in zip(cols, names, strict=True)])
    rows = rows if missing else rows.dropna()

    def batches(vectors: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for v in vectors:
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    def each(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(work(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)) for b in source if b.num_rows)

    def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(v for b in source for v in b.column(0).flatten().to_numpy().reshape(b.num_rows, -1))

    parts = rows.mapInArrow(each, "v array<double>")
    few = math.ceil(math.sqrt(max(1, df.sparkSession.sparkContext.defaultParallelism)))
    got = parts.repartition(few).mapInArrow(added, "v array<double>").toArrow().column("v").to_pylist()
    return np.sum(np.array(got), axis=0) if got else work(np.zeros((0, len(cols))))


def gram(df: DataFrame, cols: list[str], center: np.ndarray | None = None, weight: Column | None = None) -> np.ndarray:
    """Sums of products of all pairs of columns, less their centres: a matrix product for each batch."""
    center = np.zeros(len(cols)) if center is None else np.asarray(center, float)

    def work(x: np.ndarray) -> np.ndarray:
        y = x[:, :-1] - center
        return ((y * x[:, -1:]).T @ y).ravel()

    return summed(df, [*map(F.col, cols), F.lit(1.0) if weight is None else weight], work).reshape(len(cols), len(cols))


def dot(cols: list[str], weights, bias: float = 0.0) -> Column:
    return sum((F.col(c).cast("double") * float(w) for c, w in zip(cols, weights, strict=True)), F.lit(float(bias)))


@dataclass
class _Linear:
    cols: list[str]
    label: str

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", dot(self.cols, self.coef_, self.intercept_))

    predict = transform

    def score(self, df: DataFrame) -> float:
        from .metrics import r2_score

        return self.transform(df).agg(r2_score(self.label, "prediction").alias("s")).first()["s"]

    def _sums(self, df: DataFrame, intercept: bool):
        cols = [*self.cols, self.label]
        n, mean = moments(df, cols)
        if not intercept:
            mean = np.zeros(len(cols))
        g = gram(df, cols, mean)
        return n, mean, g[:-1, :-1], g[:-1, -1]

    def _set(self, w: np.ndarray, mean: np.ndarray):
        self.coef_ = np.asarray(w)
        self.intercept_ = float(mean[-1] - mean[:-1] @ w)
        return self


@dataclass
class LinearRegression(_Linear):
    """Least squares; of several solutions that of least norm."""

    fit_intercept: bool = True

    def fit(self, df: DataFrame):
        _, mean, xx, xy = self._sums(df, self.fit_intercept)
        return self._set(np.linalg.pinv(xx, hermitian=True) @ xy, mean)


@dataclass
class Ridge(_Linear):
    alpha: float = 1.0
    fit_intercept: bool = True

    def fit(self, df: DataFrame):
        _, mean, xx, xy = self._sums(df, self.fit_intercept)
        return self._set(np.linalg.solve(xx + self.alpha * np.eye(len(xx)), xy), mean)


@dataclass
class ElasticNet(_Linear):
    """Cyclic coordinate descent with soft thresholds; all steps work on the Gram matrix."""

    alpha: float = 1.0
    l1_ratio: float = 0.5
    fit_intercept: bool = True
    max_iter: int = 1000
    tol: float = 1e-4

    def fit(self, df: DataFrame):
        n, mean, xx, xy = self._sums(df, self.fit_intercept)
        l1, l2 = self.alpha * self.l1_ratio * n, self.alpha * (1 - self.l1_ratio) * n
        w = np.zeros(len(xy))
        for self.n_iter_ in range(1, self.max_iter + 1):
            most = 0.0
            for j in range(len(w)):
                if xx[j, j] < 1e-10:
                    continue
                rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (xx[j, j] + l2)
                most, w[j] = max(most, abs(new - w[j])), new
            if most < self.tol:
                break
        return self._set(w, mean)


class Lasso(ElasticNet):
    def __init__(self, cols, label, alpha: float = 1.0, fit_intercept: bool = True, max_iter: int = 1000, tol: float = 1e-4):
        super().__init__(cols, label, alpha, 1.0, fit_intercept, max_iter, tol)


@dataclass
class LogisticRegression:
    """Multinomial (or one-vs-rest) logistic regression with an l2 (or l1) penalty of 1 / (C n), bias unpenalised.

    solver 'newton' reaches the optimum in a few passes, each one aggregate of weighted Gram sums; 'gd' takes the plain gradient
    steps of ``lr`` from zero, one pass each, up to max_iter. Probabilities of a one-vs-rest model are softmaxed, too.
    """

    cols: list[str]
    label: str
    C: float = 1.0
    penalty: str | None = "l2"
    multi_class: str = "multinomial"
    max_iter: int = 1000
    lr: float = 0.1
    tol: float = 1e-4
    fit_intercept: bool = True
    solver: str = "newton"

    def fit(self, df: DataFrame):
        self.classes_ = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
        k, p = len(self.classes_), len(self.cols)
        n = df.count()
        binary = k == 2
        self.coef_ = np.zeros((1 if binary else k, p + 1))
        if k < 2:
            return self
        lam = 1 / (self.C * n) if self.penalty else 0.0
        steps = self.max_iter if self.solver == "gd" or self.penalty == "l1" else 25
        newton = self.solver == "newton" and self.penalty != "l1"
        for self.n_iter_ in range(1, steps + 1):
            grad, hess = self._sums(df, n, newton)
            shrink = np.sign(self.coef_) if self.penalty == "l1" else self.coef_
            grad[:, :p] += lam * shrink[:, :p]
            if not self.fit_intercept:
                grad[:, p] = 0
            if newton:
                r = lam * np.eye(p + 1)
                r[p, p] = 1e-12 if self.fit_intercept else 1.0
                step = np.stack([np.linalg.solve(hess[c] + r + 1e-10 * np.eye(p + 1), grad[c]) for c in range(len(grad))])
            else:
                step = self.lr * grad
            self.coef_ = self.coef_ - step
            if np.abs(step[:, :p]).max() < (1e-8 if newton else self.tol):
                break
        return self

    def _sums(self, df: DataFrame, n: int, newton: bool):
        """Gradient and, for each class, curvature (for several classes an upper bound of it: the block diagonal, doubled)."""
        k, p, coef = len(self.classes_), len(self.cols) + 1, self.coef_
        rows, ovr = len(coef), self.multi_class == "ovr"

        def work(v: np.ndarray) -> np.ndarray:
            x = np.column_stack([v[:, :-1], np.ones(len(v))])
            z = x @ coef.T
            if rows == 1 or ovr:
                prob = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), 1 - 1 / (1 + np.exp(-np.abs(z))))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
                prob = e / e.sum(axis=1, keepdims=True)
            mine = v[:, -1:] == (np.array([1.0]) if rows == 1 else np.arange(k))
            out = [((prob - mine).T @ x).ravel()]
            if newton:
                out += [((x * (prob[:, c] * (1 - prob[:, c]))[:, None]).T @ x).ravel() for c in range(rows)]
            return np.concatenate(out)

        number = F.array_position(F.array(*map(F.lit, self.classes_)), F.col(self.label)) - 1
        got = summed(df, [*map(F.col, self.cols), number], work) / n
        hess = got[rows * p :].reshape(rows, p, p) * (1 if rows == 1 or ovr else 2) if newton else np.zeros((rows, p, p))
        return got[: rows * p].reshape(rows, p), hess

    def _probs(self) -> list[Column]:
        from ..functions.elementwise import sigmoid

        z = [dot(self.cols, w[:-1], w[-1]) for w in self.coef_]
        if len(z) == 1:
            return [1 - sigmoid(z[0]), sigmoid(z[0])]
        top = F.greatest(*z)
        e = [F.exp(v - top) for v in z]
        total = sum(e[1:], e[0])
        return [v / total for v in e]

    def transform(self, df: DataFrame) -> DataFrame:
        """prediction and probability (array in the order of classes_)."""
        if len(self.classes_) < 2:
            return df.withColumn("probability", F.array(F.lit(1.0))).withColumn("prediction", F.lit(self.classes_[0] if self.classes_ else None))
        return with_argmax(df.withColumn("probability", F.array(*self._probs())), "probability", self.classes_)

    predict = transform

    def score(self, df: DataFrame) -> float:
        from .metrics import accuracy_score

        return self.transform(df).agg(accuracy_score(self.label, "prediction").alias("s")).first()["s"]


def with_argmax(df: DataFrame, scores: str, classes: list) -> DataFrame:
    """prediction: the class of the greatest score, the first of several."""
    best = F.array_position(scores, F.array_max(scores))
    return df.withColumn("prediction", F.get(F.array(*map(F.lit, classes)), (best - 1).cast("int")))
