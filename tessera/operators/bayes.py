"""Naive Bayes: class aggregates in one grouped pass, scores as one expression a class."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import with_argmax


@dataclass
class _Bayes:
    cols: list[str]
    label: str

    def _joint(self) -> list[Column]:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        """prediction, log_probability and probability (arrays in the order of classes_)."""
        joint = df.withColumn("_j", F.array(*self._joint()))
        top = F.array_max("_j")
        norm = top + F.ln(F.aggregate(F.col("_j"), F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("_j"))))
        out = joint.withColumn("_n", norm).withColumn("log_probability", F.transform("_j", lambda v: v - F.col("_n")))
        out = with_argmax(out, "_j", self.classes_)
        return out.withColumn("probability", F.transform("log_probability", F.exp)).drop("_j", "_n")

    predict = transform

    def score(self, df: DataFrame) -> float:
        from .metrics import accuracy_score

        return self.transform(df).agg(accuracy_score(self.label, "prediction").alias("s")).first()["s"]

    def _classes(self, df: DataFrame, aggs: list[Column]) -> list:
        rows = df.groupBy(self.label).agg(F.count("*").alias("n"), *aggs).orderBy(self.label).collect()  # one row a class
        self.classes_ = [r[self.label] for r in rows]
        total = sum(r["n"] for r in rows)
        self.class_log_prior_ = [math.log(r["n"] / total) for r in rows]
        return rows


@dataclass
class GaussianNB(_Bayes):
    """Variances get var_smoothing times the greatest variance of any class and column."""

    var_smoothing: float = 1e-9

    def fit(self, df: DataFrame):
        v = [F.col(c).cast("double") for c in self.cols]
        rows = self._classes(df, [F.avg(x).alias(f"m{i}") for i, x in enumerate(v)] + [F.var_pop(x).alias(f"v{i}") for i, x in enumerate(v)])
        k = range(len(self.cols))
        self.theta_ = [[r[f"m{i}"] for i in k] for r in rows]
        eps = self.var_smoothing * max((r[f"v{i}"] for r in rows for i in k), default=0.0)
        self.var_ = [[r[f"v{i}"] + eps for i in k] for r in rows]
        return self

    def _joint(self):
        out = []
        for prior, mean, var in zip(self.class_log_prior_, self.theta_, self.var_, strict=True):
            fixed = prior - 0.5 * sum(math.log(2 * math.pi * max(s, 1e-300)) for s in var)
            e = sum(((F.col(c).cast("double") - m) * (F.col(c).cast("double") - m) / max(s, 1e-300) for c, m, s in zip(self.cols, mean, var, strict=True)), F.lit(0.0))
            out.append(fixed - 0.5 * e)
        return out


@dataclass
class MultinomialNB(_Bayes):
    alpha: float = 1.0

    def fit(self, df: DataFrame):
        rows = self._classes(df, [F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(self.cols)])
        self.feature_log_prob_ = []
        for r in rows:
            s = [r[f"s{i}"] + self.alpha for i in range(len(self.cols))]
            self.feature_log_prob_.append([math.log(v / sum(s)) for v in s])
        return self

    def _joint(self):
        return [sum((F.col(c).cast("double") * w for c, w in zip(self.cols, ws, strict=True)), F.lit(prior)) for prior, ws in zip(self.class_log_prior_, self.feature_log_prob_, strict=True)]


@dataclass
class BernoulliNB(_Bayes):
    """binarize: values above it are 1; None takes values as they are."""

    alpha: float = 1.0
    binarize: float | None = 0.0

    def _on(self, c: str) -> Column:
        v = F.col(c).cast("double")
        return v if self.binarize is None else F.when(v > self.binarize, 1.0).otherwise(0.0)

    def fit(self, df: DataFrame):
        rows = self._classes(df, [F.sum(self._on(c)).alias(f"s{i}") for i, c in enumerate(self.cols)])
        p = [[(r[f"s{i}"] + self.alpha) / (r["n"] + 2 * self.alpha) for i in range(len(self.cols))] for r in rows]
        self.feature_log_prob_ = [[(math.log(v), math.log(1 - v)) for v in ps] for ps in p]
        return self

    def _joint(self):
        return [sum((self._on(c) * (a - b) + b for c, (a, b) in zip(self.cols, ws, strict=True)), F.lit(prior)) for prior, ws in zip(self.class_log_prior_, self.feature_log_prob_, strict=True)]
