"""Feature transforms. fit runs aggregates and gives a model whose state is a few numbers per column; transform is a projection
over the given columns, in place (or into new columns where a transform widens them). NaN and NULL are both missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cut import cut
from .linear import summed
from .ordered import running
from .quantiles import modes, quantiles


def real(c: str) -> Column:
    """A column as a double, NaN as NULL."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new.pop(c).alias(c) if c in new else F.col(c) for c in df.columns], *[v.alias(c) for c, v in new.items()])


class Transformer:
    """fit(df) -> self; transform(df); fit_transform(df)."""

    def fit(self, df: DataFrame):
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no inverse")


@dataclass
class _Affine(Transformer):
    """x * scale + shift per column."""

    cols: list[str]

    def __post_init__(self):
        self.scale_: dict[str, float] = {}
        self.shift_: dict[str, float] = {}

    def transform(self, df: DataFrame) -> DataFrame:
        return replaced(df, {c: F.col(c).cast("double") * self.scale_[c] + self.shift_[c] for c in self.cols})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return replaced(df, {c: (F.col(c).cast("double") - self.shift_[c]) / self.scale_[c] for c in self.cols})


def _stats(df: DataFrame, cols: list[str], aggs: dict[str, Callable[[Column], Column]]) -> dict[str, dict]:
    row = df.agg(*[f(real(c)).alias(f"{name}|{c}") for c in cols for name, f in aggs.items()]).first()
    return {c: {name: row[f"{name}|{c}"] for name in aggs} for c in cols}


@dataclass
class StandardScaler(_Affine):
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""

    with_mean: bool = True
    with_std: bool = True

    def fit(self, df):
        s = _stats(df, self.cols, {"m": F.avg, "s": F.stddev_pop})
        self.mean_ = {c: s[c]["m"] or 0.0 for c in self.cols}
        self.scales_ = {c: (s[c]["s"] or 1.0) if self.with_std else 1.0 for c in self.cols}
        return self

    def transform(self, df):
        return replaced(df, {c: (F.col(c).cast("double") - (self.mean_[c] if self.with_mean else 0.0)) / self.scales_[c] for c in self.cols})

    def inverse_transform(self, df):
        return replaced(df, {c: F.col(c).cast("double") * self.scales_[c] + (self.mean_[c] if self.with_mean else 0.0) for c in self.cols})


@dataclass
class MinMaxScaler(_Affine):
    """To feature_range; a constant column goes to the range's lower end."""

    feature_range: tuple[float, float] = (0.0, 1.0)

    def fit(self, df):
        low, high = self.feature_range
        for c, s in _stats(df, self.cols, {"a": F.min, "b": F.max}).items():
            a, b = s["a"] or 0.0, s["b"] or 0.0
            self.scale_[c] = (high - low) / ((b - a) or 1.0)
            self.shift_[c] = low - a * self.scale_[c]
        return self


@dataclass
class MaxAbsScaler(_Affine):
    def fit(self, df):
        for c, s in _stats(df, self.cols, {"m": lambda v: F.max(F.abs(v))}).items():
            self.scale_[c], self.shift_[c] = 1 / (s["m"] or 1.0), 0.0
        return self


@dataclass
class RobustScaler(_Affine):
    """(x - median) / range of two percentiles, both exact."""

    with_centering: bool = True
    with_scaling: bool = True
    quantile_range: tuple[float, float] = (25.0, 75.0)

    def fit(self, df):
        q = [self.quantile_range[0] / 100, 0.5, self.quantile_range[1] / 100]
        self.center_, self.range_ = {}, {}
        for c, found in zip(self.cols, quantiles(df, [real(c) for c in self.cols], q), strict=True):
            a, m, b = (v or 0.0 for v in found)
            self.center_[c] = m if self.with_centering else 0.0
            self.range_[c] = ((b - a) or 1.0) if self.with_scaling else 1.0
        return self

    def transform(self, df):
        return replaced(df, {c: (F.col(c).cast("double") - self.center_[c]) / self.range_[c] for c in self.cols})

    def inverse_transform(self, df):
        return replaced(df, {c: F.col(c).cast("double") * self.range_[c] + self.center_[c] for c in self.cols})


@dataclass
class Normalizer(Transformer):
    """Each row by its l1, l2 or max norm; a norm of 0 counts as 1."""

    cols: list[str]
    norm: str = "l2"

    def transform(self, df):
        v = [F.col(c).cast("double") for c in self.cols]
        add = lambda parts: sum(parts[1:], parts[0])
        size = {"l1": lambda: add([F.abs(x) for x in v]), "l2": lambda: F.sqrt(add([x * x for x in v])), "max": lambda: F.array_max(F.array(*map(F.abs, v)))}[self.norm]()
        size = F.when(size == 0, 1.0).otherwise(size)
        return replaced(df, {c: F.col(c).cast("double") / size for c in self.cols})


@dataclass
class Binarizer(Transformer):
    cols: list[str]
    threshold: float = 0.0

    def transform(self, df):
        return replaced(df, {c: F.when(F.col(c).cast("double") > self.threshold, 1.0).otherwise(0.0) for c in self.cols})


@dataclass
class FunctionTransformer(Transformer):
    """func and inverse_func take and give a DataFrame; None is the identity."""

    func: Callable[[DataFrame], DataFrame] | None = None
    inverse_func: Callable[[DataFrame], DataFrame] | None = None

    def transform(self, df):
        return df.transform(self.func) if self.func else df

    def inverse_transform(self, df):
        return df.transform(self.inverse_func) if self.inverse_func else df


@dataclass
class PolynomialFeatures(Transformer):
    """Products up to a degree, by degree and then column order, into p0, p1, ..; names_ tells them."""

    cols: list[str]
    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def terms(self) -> list[tuple[str, ...]]:
        pick = combinations if self.interaction_only else combinations_with_replacement
        return [t for d in range(0 if self.include_bias else 1, self.degree + 1) for t in pick(self.cols, d)]

    @property
    def names_(self) -> dict[str, str]:
        return {f"p{i}": " ".join(t) or "1" for i, t in enumerate(self.terms())}

    def transform(self, df):
        def product(t):
            out = F.lit(1.0)
            for c in t:
                out = out * F.col(c).cast("double")
            return out

        return df.select("*", *[product(t).alias(f"p{i}") for i, t in enumerate(self.terms())])


@dataclass
class PowerTransformer(Transformer):
    """Yeo-Johnson or Box-Cox with the lambda of greatest likelihood on a grid of 100 from -2 to 2, then standardised. Two
    passes have all lambdas of all columns."""

    cols: list[str]
    method: str = "yeo-johnson"
    standardize: bool = True
    grid: int = 100

    def lambdas(self) -> list[float]:
        return [-2 + 4 * i / (self.grid - 1) for i in range(self.grid)]

    def power(self, x: Column, lam: float) -> Column:
        if self.method == "box-cox":
            return F.ln(x) if abs(lam) < 1e-10 else (F.pow(x, F.lit(lam)) - 1) / lam
        up = F.log1p(F.greatest(x, F.lit(0.0))) if abs(lam) < 1e-10 else (F.pow(F.greatest(x, F.lit(0.0)) + 1, F.lit(lam)) - 1) / lam
        down = -F.log1p(-F.least(x, F.lit(0.0))) if abs(lam - 2) < 1e-10 else -(F.pow(1 - F.least(x, F.lit(0.0)), F.lit(2 - lam)) - 1) / (2 - lam)
        return F.when(x >= 0, up).when(x.isNotNull(), down)

    def _powers(self, x: np.ndarray, lam: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            if self.method == "box-cox":
                return np.log(x) if abs(lam) < 1e-10 else (x**lam - 1) / lam
            up = np.log1p(np.maximum(x, 0)) if abs(lam) < 1e-10 else ((np.maximum(x, 0) + 1) ** lam - 1) / lam
            down = -np.log1p(-np.minimum(x, 0)) if abs(lam - 2) < 1e-10 else -((1 - np.minimum(x, 0)) ** (2 - lam) - 1) / (2 - lam)
        return np.where(x >= 0, up, down)

    def likelihoods(self, df: DataFrame) -> np.ndarray:
        """One row a column, one entry a lambda. Two passes for all of them: means, then squares about the means."""
        lams, k = self.lambdas(), len(self.cols)
        x = [real(c) for c in self.cols]

        def first(v: np.ndarray) -> np.ndarray:
            rows = []
            for c in range(k):
                y = v[~np.isnan(v[:, c]), c]
                jacobian = np.log(y) if self.method == "box-cox" else np.sign(y) * np.log1p(np.abs(y))
                rows.append([len(y), jacobian.sum(), *[self._powers(y, lam).sum() for lam in lams]])
            return np.array(rows, float).ravel()

        sums = summed(df, x, first, missing=True).reshape(k, -1)
        n = np.maximum(sums[:, :1], 1)
        mean = sums[:, 2:] / n

        def second(v: np.ndarray) -> np.ndarray:
            out = np.zeros((k, len(lams)))
            for c in range(k):
                y = v[~np.isnan(v[:, c]), c]
                out[c] = [((self._powers(y, lam) - m) ** 2).sum() for lam, m in zip(lams, mean[c], strict=True)]
            return out.ravel()

        var = summed(df, x, second, missing=True).reshape(k, -1) / n
        return -0.5 * sums[:, :1] * np.log(np.maximum(np.nan_to_num(var), 1e-300)) + (np.array(lams) - 1) * sums[:, 1:2]

    def fit(self, df):
        best = self.likelihoods(df).argmax(axis=1)
        self.lambda_ = {c: self.lambdas()[i] for c, i in zip(self.cols, best.tolist(), strict=True)}
        if self.standardize:
            self.scaler_ = StandardScaler(self.cols).fit(self._powered(df))
        return self

    def _powered(self, df):
        return replaced(df, {c: self.power(F.col(c).cast("double"), self.lambda_[c]) for c in self.cols})

    def transform(self, df):
        out = self._powered(df)
        return self.scaler_.transform(out) if self.standardize else out


#: A one-hot table has a column for each category, so these are named in the plan; more of them are an error.
MOST_CATEGORIES = 4096


def _categories(df: DataFrame, c: str) -> list:
    some = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()]
    if len(some) > MOST_CATEGORIES:
        raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories: encode it by LabelEncoder or OrdinalEncoder")
    return sorted(some)


def _numbered(df: DataFrame, c: str) -> DataFrame:
    """_value, _index: the sorted distinct values from 0, as a table on the executors."""
    values = df.select(F.col(c).alias("_value")).where("_value is not null").distinct()
    return cut(running(values, [F.col("_value")], {"_index": F.lit(1)}).select("_value", (F.col("_index") - 1).cast("long").alias("_index")))


def _unknown(c: str, known: Column, value: Column) -> Column:
    return F.when(known, value).otherwise(F.raise_error(F.concat(F.lit(f"{c}: unknown category "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))))


@dataclass
class LabelEncoder(Transformer):
    """Sorted distinct values to 0..k-1, by a join with the table of classes, whose size Spark checks before it broadcasts it."""

    col: str
    output: str = "label"

    def fit(self, df):
        self.table_ = _numbered(df, self.col)
        return self

    @property
    def classes_(self) -> list:
        """The values in order, on the driver."""
        return [r["_value"] for r in self.table_.orderBy("_index").collect()]

    def transform(self, df):
        out = df.join(self.table_, df[self.col] == self.table_["_value"], "left")
        return out.select(*[df[c] for c in df.columns], _unknown(self.col, F.col("_index").isNotNull(), F.col("_index")).cast("long").alias(self.output))

    def inverse_transform(self, df):
        names = self.table_
        return df.join(names, df[self.output] == names["_index"], "left").select(*[df[c] for c in df.columns], F.col("_value").alias(f"{self.col}_inverse"))


@dataclass
class OrdinalEncoder(Transformer):
    """Each column's value to its place among the sorted (or given) categories, by a join with the table of these."""

    cols: list[str]
    categories: str | list[list] = "auto"

    def fit(self, df):
        if self.categories == "auto":
            self.tables_ = {c: _numbered(df, c) for c in self.cols}
        else:
            kind = lambda c: df.schema[c].dataType.simpleString()
            self.tables_ = {c: df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(k)], f"_value {kind(c)}, _index long") for c, k in zip(self.cols, self.categories, strict=True)}
        return self

    @property
    def categories_(self) -> list[list]:
        """The values of each column in order, on the driver."""
        return [[r["_value"] for r in self.tables_[c].orderBy("_index").collect()] for c in self.cols]

    def _joined(self, df, key: str, value: str):
        for i, c in enumerate(self.cols):
            names = self.tables_[c].select(F.col(key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
            df = df.join(names, F.col(c).cast("long") == F.col(f"_k{i}") if key == "_index" else F.col(c) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        return df

    def transform(self, df):
        new = {c: _unknown(c, F.col(f"_v{i}").isNotNull(), F.col(f"_v{i}").cast("double")).cast("double") for i, c in enumerate(self.cols)}
        return replaced(self._joined(df, "_value", "_index"), new).select(*df.columns)

    def inverse_transform(self, df):
        return replaced(self._joined(df, "_index", "_value"), {c: F.col(f"_v{i}") for i, c in enumerate(self.cols)}).select(*df.columns)


@dataclass
class OneHotEncoder(Transformer):
    """A column of 0 and 1 for each sorted category (but the first, with drop='first'), named column_category. Unknown values are
    an error or all 0; the dropped one is all 0."""

    cols: list[str]
    drop: str | None = None
    handle_unknown: str = "error"
    categories_: list[list] = field(default_factory=list)

    def fit(self, df):
        self.categories_ = [_categories(df, c) for c in self.cols]
        return self

    def kept(self) -> list[tuple[str, object]]:
        return [(c, v) for c, k in zip(self.cols, self.categories_, strict=True) for v in (k[1:] if self.drop == "first" else k)]

    def transform(self, df):
        known = {c: F.col(c).isin(*k) for c, k in zip(self.cols, self.categories_, strict=True)}
        one = lambda c, v: F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
        new = [(one(c, v) if self.handle_unknown == "ignore" else _unknown(c, known[c], one(c, v)).cast("double")).alias(f"{c}_{v}") for c, v in self.kept()]
        return df.select(*[c for c in df.columns if c not in self.cols], *new)

    def inverse_transform(self, df):
        out = []
        for c, k in zip(self.cols, self.categories_, strict=True):
            value = F.lit(k[0] if self.drop == "first" else None)
            for v in reversed(k[1:] if self.drop == "first" else k):
                value = F.when(F.col(f"{c}_{v}") == 1, F.lit(v)).otherwise(value)
            out.append(value.alias(c))
        made = {f"{c}_{v}" for c, v in self.kept()}
        return df.select(*[c for c in df.columns if c not in made], *out)


@dataclass
class SimpleImputer(Transformer):
    """mean, median (exact), most_frequent (the smallest of several) or constant; a column without values gets 0."""

    cols: list[str]
    strategy: str = "mean"
    fill_value: float = 0.0

    def fit(self, df):
        if self.strategy == "constant":
            self.statistics_ = {c: self.fill_value for c in self.cols}
        else:
            x = [real(c) for c in self.cols]
            find = {"mean": lambda: [s["v"] for s in _stats(df, self.cols, {"v": F.avg}).values()], "median": lambda: [q[0] for q in quantiles(df, x, [0.5])], "most_frequent": lambda: modes(df, x)}
            self.statistics_ = {c: 0.0 if v is None else v for c, v in zip(self.cols, find[self.strategy](), strict=True)}
        return self

    def transform(self, df):
        return replaced(df, {c: F.coalesce(real(c), F.lit(float(self.statistics_[c]))) for c in self.cols})


@dataclass
class KNNImputer(Transformer):
    """Missing values from the k nearest training rows by the columns that both have (not rescaled); of these k, those that miss
    the value drop out. weights: uniform or distance. Without any, the column's mean.

    Only rows with something missing are compared with the training table."""

    cols: list[str]
    id_col: str
    n_neighbors: int = 5
    weights: str = "uniform"

    def fit(self, df):
        self.train_ = df.select(F.col(self.id_col).alias("_tid"), *[real(c).alias(f"_t_{c}") for c in self.cols])
        self.means_ = {c: s["m"] or 0.0 for c, s in _stats(df, self.cols, {"m": F.avg}).items()}
        return self

    def transform(self, df):
        holes = F.lit(False)
        for c in self.cols:
            holes = holes | real(c).isNull()
        asked = df.where(holes).select(F.col(self.id_col).alias("_qid"), *[real(c).alias(f"_q_{c}") for c in self.cols])
        part = lambda c: F.pow(F.col(f"_q_{c}") - F.col(f"_t_{c}"), F.lit(2.0))
        both = F.lit(0)
        for c in self.cols:
            both = both + (F.col(f"_q_{c}").isNotNull() & F.col(f"_t_{c}").isNotNull()).cast("int")
        total = sum((F.coalesce(part(c), F.lit(0.0)) for c in self.cols), F.lit(0.0))
        d = F.when(both > 0, F.sqrt(total)).otherwise(F.lit(float("inf")))
        # The k best of each task's rows meet in an array of k, so nothing larger is gathered for a row.
        pairs = asked.crossJoin(self.train_).where("_qid <> _tid").select("_qid", F.struct(d.alias("_distance"), F.col("_tid").alias("_other"), *[F.col(f"_t_{c}").alias(c) for c in self.cols]).alias("n"))
        near = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("_qid").orderBy("n._distance", "n._other"))).where(F.col("_k") <= self.n_neighbors)
        w = F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest(F.col("n._distance"), F.lit(1e-10))
        value = lambda c: F.try_divide(F.sum(F.when(F.col(f"n.{c}").isNotNull(), w * F.col(f"n.{c}"))), F.sum(F.when(F.col(f"n.{c}").isNotNull(), w)))
        found = near.groupBy("_qid").agg(*[value(c).alias(f"_v_{c}") for c in self.cols])
        out = df.join(found, F.col(self.id_col) == F.col("_qid"), "left")
        return replaced(out, {c: F.coalesce(real(c), F.col(f"_v_{c}"), F.lit(float(self.means_[c]))) for c in self.cols}).select(*df.columns)
