"""PCA, its incremental form and truncated SVD, from Gram sums; only a matrix of columns by columns comes to the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import dot, gram, moments


def signed(v: np.ndarray) -> np.ndarray:
    """Rows with their entry of greatest absolute value positive."""
    big = np.abs(v).argmax(axis=1)
    return v * np.where(v[np.arange(len(v)), big] < 0, -1.0, 1.0)[:, None]


@dataclass
class _Projection:
    cols: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """pc0, pc1, .."""
        scale = 1 / np.sqrt(np.maximum(self.explained_variance_, 1e-10)) if getattr(self, "whiten", False) else np.ones(len(self.components_))
        return df.select("*", *[(dot(self.cols, v * s, -float(self.mean_ @ v) * s)).alias(f"pc{i}") for i, (v, s) in enumerate(zip(self.components_, scale, strict=True))])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """From pc0, pc1, .. back to the columns."""
        scale = np.sqrt(np.maximum(self.explained_variance_, 1e-10)) if getattr(self, "whiten", False) else np.ones(len(self.components_))
        names = [f"pc{i}" for i in range(len(self.components_))]
        back = {c: dot(names, self.components_[:, j] * scale, self.mean_[j]) for j, c in enumerate(self.cols)}
        return df.select(*[c for c in df.columns if c not in back], *[v.alias(c) for c, v in back.items()])


@dataclass
class PCA(_Projection):
    """n_components: a number, a share of the variance, or None for all."""

    n_components: int | float | None = None
    whiten: bool = False

    def fit(self, df: DataFrame):
        n, mean = moments(df, self.cols)
        self._set(n, mean, gram(df, self.cols, mean))
        return self

    def _set(self, n: int, mean: np.ndarray, scatter: np.ndarray) -> None:
        value, vector = np.linalg.eigh(scatter / max(n - 1, 1))
        value, vector = np.maximum(value[::-1], 0), signed(vector.T[::-1])
        share = value / max(value.sum(), 1e-300)
        k = self.n_components
        k = min(n, len(value)) if k is None else int(np.searchsorted(np.cumsum(share), k) + 1) if isinstance(k, float) else k
        self.mean_, self.n_components_, self.n_samples_ = mean, k, n
        self.components_, self.explained_variance_, self.explained_variance_ratio_ = vector[:k], value[:k], share[:k]
        self.singular_values_ = np.sqrt(value[:k] * max(n - 1, 1))
        self.noise_variance_ = float(value[k:].mean()) if k < len(value) else 0.0

    def score(self, df: DataFrame) -> float:
        """-0.5 times the mean squared error of going there and back, by the noise variance."""
        back = self.inverse_transform(self.transform(df.select(*[F.col(c).cast("double").alias(c) for c in self.cols], *[F.col(c).cast("double").alias(f"_o_{c}") for c in self.cols])))
        e = sum(((F.col(c) - F.col(f"_o_{c}")) * (F.col(c) - F.col(f"_o_{c}")) for c in self.cols), F.lit(0.0)) / float(len(self.cols))
        return -0.5 * back.agg(F.avg(e)).first()[0] / (self.noise_variance_ + 1e-10)


@dataclass
class IncrementalPCA(PCA):
    """Mergeable state (rows, means, scatter): batches may come in any order and give what PCA gives on all of them."""

    batch_size: int | None = None

    def __post_init__(self):
        self.state_ = None

    def partial_fit(self, df: DataFrame):
        n, mean = moments(df, self.cols)
        if n:
            scatter = gram(df, self.cols, mean)
            if self.state_ is not None:
                m, other, s = self.state_
                gap = mean - other
                scatter = scatter + s + np.outer(gap, gap) * (n * m / (n + m))
                mean, n = (n * mean + m * other) / (n + m), n + m
            self.state_ = (n, mean, scatter)
            self._set(*self.state_)
        return self

    def fit(self, df: DataFrame):
        self.state_ = None
        return self.partial_fit(df)


@dataclass
class TruncatedSVD(_Projection):
    """Exact, from the Gram matrix of uncentred columns."""

    n_components: int = 2

    def fit(self, df: DataFrame):
        n, _ = moments(df, self.cols)
        value, vector = np.linalg.eigh(gram(df, self.cols))
        value, vector = np.maximum(value[::-1], 0), signed(vector.T[::-1])
        k = min(self.n_components, len(value))
        self.mean_ = np.zeros(len(self.cols))
        self.components_, self.singular_values_ = vector[:k], np.sqrt(value[:k])
        self.explained_variance_ = value[:k] / max(n - 1, 1)
        total = np.trace(gram(df, self.cols, moments(df, self.cols)[1])) / max(n - 1, 1)
        self.explained_variance_ratio_ = self.explained_variance_ / max(total, 1e-300)
        return self
