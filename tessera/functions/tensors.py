"""Dense arrays as coordinate rows: one column for each axis (named i0, i1, ..) and a value column v. Every operator is an
aggregate, an equi-join or index arithmetic, so an array may be larger than any one machine."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def axes(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "v"]


def named(t: DataFrame, columns: list[Column], v: Column | str = "v") -> DataFrame:
    return t.select(*[c.cast("long").alias(f"i{k}") for k, c in enumerate(columns)], (F.col(v) if isinstance(v, str) else v).alias("v"))


def from_arrays(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Rows of arrays to a two-axis tensor."""
    return df.select(F.col(id_col).cast("long").alias("i0"), F.posexplode(array_col).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v"))


def filled(spark, shape: tuple[int, ...], value: float) -> DataFrame:
    n = spark.range(prod(shape))
    return named(n, unravel(F.col("id"), shape), F.lit(float(value)))


def unravel(flat: Column, shape: tuple[int, ...]) -> list[Column]:
    out, step = [], 1
    for size in reversed(shape):
        out.append(F.pmod(F.floor(flat / step), F.lit(size)))
        step *= size
    return out[::-1]


def ravel(columns: list[Column], shape: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [c * prod(shape[k + 1 :]) for k, c in enumerate(columns)])


def reduce_axes(t: DataFrame, how: str, axis: int | tuple[int, ...] | None = None) -> DataFrame:
    """sum, mean or max over the given axes (all of them for None)."""
    gone = range(len(axes(t))) if axis is None else (axis,) if isinstance(axis, int) else axis
    rest = [f"i{k}" for k in range(len(axes(t))) if k not in {a % len(axes(t)) for a in gone}]
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]("v").alias("v")
    return named(t.groupBy(*rest).agg(agg) if rest else t.agg(agg), [F.col(c) for c in rest])


def reshape(t: DataFrame, shape: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """One entry of ``new`` may be -1."""
    new = tuple(prod(shape) // -prod(new) if n == -1 else n for n in new)
    return named(t, unravel(ravel([F.col(c) for c in axes(t)], shape), new))


def transpose(t: DataFrame, order: tuple[int, ...] | None = None) -> DataFrame:
    order = order or tuple(reversed(range(len(axes(t)))))
    return named(t, [F.col(f"i{k}") for k in order])


def take(t: DataFrame, axis: int, start: int, stop: int, step: int = 1) -> DataFrame:
    c = F.col(f"i{axis}")
    inside = t.where((c >= start) & (c < stop) & (F.pmod(c - start, F.lit(step)) == 0))
    return named(inside, [F.floor((c - start) / step) if k == axis else F.col(f"i{k}") for k in range(len(axes(t)))])


def concat(parts: list[DataFrame], sizes: list[int], axis: int = 0) -> DataFrame:
    out, begin = [], 0
    for t, n in zip(parts, sizes, strict=True):
        out.append(named(t, [F.col(c) + (begin if k == axis else 0) for k, c in enumerate(axes(t))]))
        begin += n
    return reduce(DataFrame.unionByName, out)


def stack(parts: list[DataFrame], axis: int = 0) -> DataFrame:
    def placed(n: int, t: DataFrame) -> DataFrame:
        cols = [F.col(c) for c in axes(t)]
        return named(t, [*cols[:axis], F.lit(n), *cols[axis:]])

    return reduce(DataFrame.unionByName, [placed(n, t) for n, t in enumerate(parts)])


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two-axis tensors: an equi-join on the inner axis and a sum that starts on the map side."""
    x, y = a.alias("x"), b.alias("y")
    out = x.join(y, F.col("x.i1") == F.col("y.i0")).groupBy(F.col("x.i0").alias("i0"), F.col("y.i1").alias("i1")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v"))
    return out.select("i0", "i1", "v")


def outer_gradient(a: DataFrame, b: DataFrame, g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gradients of matmul(a, b) for the gradient g of its result."""
    return matmul(g, transpose(b)), matmul(transpose(a), g)


def max_gradient(t: DataFrame, axis: int) -> DataFrame:
    """Of the maxima along an axis: equal shares for ties."""
    keys = [c for c in axes(t) if c != f"i{axis}"]
    top = t.groupBy(*keys).agg(F.max(F.struct("v")).alias("m"), F.max("v").alias("top"))
    tied = t.join(top, keys).groupBy(*keys).agg(F.sum((F.col("v") == F.col("top")).cast("int")).alias("ties"), F.first("top").alias("top"))
    share = F.when(F.col("v") == F.col("top"), 1.0 / F.col("ties")).otherwise(0.0)
    return t.join(tied, keys).select(*axes(t), share.alias("v"))


def convolve(x: DataFrame, w: DataFrame, size: tuple[int, int], kernel: tuple[int, int], stride: int = 1, padding: int = 0, bias: DataFrame | None = None) -> DataFrame:
    """Cross-correlation of images (n, c, h, w) with kernels (out, c, kh, kw): pixels meet kernel places by an equi-join on the
    channel, then each output pixel sums its products."""
    out = [(size[k] + 2 * padding - kernel[k]) // stride + 1 for k in (0, 1)]
    p, k = x.alias("p"), F.broadcast(w).alias("k")  # a layer's kernels: fixed by its shape
    at = [F.col(f"p.i{2 + a}") + padding - F.col(f"k.i{2 + a}") for a in (0, 1)]
    fits = [(v >= 0) & (F.pmod(v, F.lit(stride)) == 0) & (F.floor(v / stride) < out[a]) for a, v in enumerate(at)]
    hit = p.join(k, F.col("p.i1") == F.col("k.i1")).where(fits[0] & fits[1])
    got = hit.groupBy(F.col("p.i0").alias("i0"), F.col("k.i0").alias("i1"), *[F.floor(v / stride).cast("long").alias(f"i{2 + a}") for a, v in enumerate(at)]).agg(F.sum(F.col("p.v") * F.col("k.v")).alias("v"))
    if bias is None:
        return got
    b = F.broadcast(bias.select(F.col("i0").alias("i1"), F.col("v").alias("b")))
    return got.join(b, "i1").select("i0", "i1", "i2", "i3", (F.col("v") + F.col("b")).alias("v"))


def windows(x: DataFrame, size: tuple[int, int], kernel: tuple[int, int], stride: int, padding: int = 0) -> DataFrame:
    """Each pixel in each window that holds it: n, c, h, w, oh, ow, kh, kw, v."""
    places = F.explode(F.sequence(F.lit(0), F.lit(kernel[0] * kernel[1] - 1)))
    e = x.select("*", places.alias("k"))
    kh, kw = F.floor(F.col("k") / kernel[1]), F.pmod(F.col("k"), F.lit(kernel[1]))
    e = e.select(F.col("i0").alias("n"), F.col("i1").alias("c"), F.col("i2").alias("h"), F.col("i3").alias("w"), kh.alias("kh"), kw.alias("kw"), (F.col("i2") + padding - kh).alias("y"), (F.col("i3") + padding - kw).alias("x"), "v")
    out = [(size[k] + 2 * padding - kernel[k]) // stride + 1 for k in (0, 1)]
    e = e.where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.pmod("y", F.lit(stride)) == 0) & (F.pmod("x", F.lit(stride)) == 0))
    e = e.withColumn("oh", F.floor(F.col("y") / stride)).withColumn("ow", F.floor(F.col("x") / stride)).where((F.col("oh") < out[0]) & (F.col("ow") < out[1]))
    return e.select("n", "c", "h", "w", "oh", "ow", "kh", "kw", "v")


def max_pool(x: DataFrame, size: tuple[int, int], kernel: tuple[int, int], stride: int | None = None, padding: int = 0) -> DataFrame:
    w = windows(x, size, kernel, stride or kernel[0], padding)
    return w.groupBy(F.col("n").alias("i0"), F.col("c").alias("i1"), F.col("oh").alias("i2"), F.col("ow").alias("i3")).agg(F.max("v").alias("v"))
