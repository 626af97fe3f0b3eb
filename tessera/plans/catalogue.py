"""All queries of the library's own operators: name -> Spark function, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise as E
from ..functions import losses as L
from ..functions import tensors as T
from ..operators import bayes, cluster, decomposition, linear, metrics, neighbors, ordered, prep, resample, tree

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Without a negative zero, so that both engines write the same value."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---- element-wise functions: value and slope over events, centred so that both signs occur ----

X = "(value - 50) / 25"
_SIG = "(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END)"
_GT = "tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))"
ELEMENTWISE = {
    "add": (lambda x: E.add(x, 2.5), "x + 2.5", "1.0"),
    "subtract": (lambda x: E.subtract(x, 2.5), "x - 2.5", "1.0"),
    "multiply": (lambda x: E.multiply(x, -3.0), "x * -3.0", "-3.0"),
    "divide": (lambda x: E.divide(1.0, E.add(x, 10.0)), "1 / (x + 10.0)", "-1 / ((x + 10) * (x + 10))"),
    "negate": (E.negate, "-x", "-1.0"),
    "power": (lambda x: E.power(x, 3), "pow(x, 3)", "3 * pow(x, 2)"),
    "sqrt": (lambda x: E.sqrt(E.multiply(x, x)), "sqrt(x * x)", None),
    "exp": (E.exp, "exp(x)", "exp(x)"),
    "log": (lambda x: E.log(E.add(E.multiply(x, x), 1.0)), "ln(x * x + 1)", None),
    "abs": (E.tensor_abs, "abs(x)", "sign(x)"),
    "clip": (lambda x: E.clip(x, -1, 1), "least(greatest(x, -1), 1)", "CASE WHEN x BETWEEN -1 AND 1 THEN 1.0 ELSE 0.0 END"),
    "relu": (E.relu, "greatest(x, 0)", "CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END"),
    "leaky_relu": (E.leaky_relu, "CASE WHEN x > 0 THEN x ELSE 0.01 * x END", "CASE WHEN x > 0 THEN 1.0 ELSE 0.01 END"),
    "elu": (E.elu, "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END", "CASE WHEN x > 0 THEN 1.0 ELSE exp(x) END"),
    "sigmoid": (E.sigmoid, _SIG, f"{_SIG} * (1 - {_SIG})"),
    "tanh": (E.tanh, "tanh(x)", "1 - tanh(x) * tanh(x)"),
    "gelu": (E.gelu, f"0.5 * x * (1 + {_GT})", f"0.5 * (1 + {_GT}) + 0.5 * x * (1 - {_GT} * {_GT}) * 0.7978845608028654 * (1 + 3 * 0.044715 * x * x)"),
    "swish": (E.swish, f"x * {_SIG}", f"{_SIG} + x * {_SIG} * (1 - {_SIG})"),
    "selu": (E.selu, "1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END", "1.0507009873554805 * CASE WHEN x > 0 THEN 1.0 ELSE 1.6732632423543772 * exp(x) END"),
    "hardswish": (E.hardswish, "x * least(greatest(x + 3, 0), 6) / 6", "CASE WHEN x <= -3 THEN 0.0 WHEN x >= 3 THEN 1.0 ELSE (2 * x + 3) / 6 END"),
}


def _elementwise(name: str) -> None:
    f, value, slope = ELEMENTWISE[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        from ..nn.autograd import Tensor, column

        out = table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("x"))
        cols = [rounded(f(F.col("x"))).alias("y")]
        if slope:
            x = column("x")
            node = {"add": lambda: x + 2.5, "subtract": lambda: x - 2.5, "multiply": lambda: x * -3.0, "divide": lambda: 1.0 / (x + 10.0), "power": lambda: x**3, "clip": lambda: x.clip(-1, 1)}.get(name, lambda: Tensor("tensor_abs" if name == "abs" else name, (x,)))()
            cols.append(rounded(node.adjoints()[id(x)]).alias("dy"))
        return out.select("event_id", *cols)

    dy = f", round({slope}, 6) + 0.0 AS dy" if slope else ""
    register(f"op_fn_{name}", f"WITH t AS (SELECT event_id, {X} AS x FROM events) SELECT event_id, round({value}, 6) + 0.0 AS y{dy} FROM t")(run)


for _name in ELEMENTWISE:
    _elementwise(_name)

# ---- softmax, reductions and shapes over embeddings ----

#: Values of an embedding.
WIDE = 64

_LONG = "(SELECT vec_id AS i0, CAST(j AS BIGINT) AS i1, CAST(embedding[CAST(j AS INTEGER) + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS t(j))"


def long(spark: SparkSession, d: str) -> DataFrame:
    return T.from_arrays(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e")), "vec_id", "e")


def _array(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


@register("op_fn_softmax", f"WITH t AS {_LONG}, e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY i0)) AS x FROM t) SELECT i0 AS vec_id, i1 AS j, round(x / sum(x) OVER (PARTITION BY i0), 6) AS p FROM e")
def _softmax(spark, d):
    return _array(spark, d).select("vec_id", F.posexplode(E.softmax(F.col("e"))).alias("j", "p")).select("vec_id", F.col("j").cast("long").alias("j"), rounded("p").alias("p"))


@register("op_fn_log_softmax", f"WITH t AS {_LONG} SELECT i0 AS vec_id, i1 AS j, round(v - m - ln(sum(exp(v - m)) OVER (PARTITION BY i0)), 6) AS p FROM (SELECT *, max(v) OVER (PARTITION BY i0) AS m FROM t)")
def _log_softmax(spark, d):
    return _array(spark, d).select("vec_id", F.posexplode(E.log_softmax(F.col("e"))).alias("j", "p")).select("vec_id", F.col("j").cast("long").alias("j"), rounded("p").alias("p"))


for _how, _agg in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    for _axis, _key in ((0, "i1"), (1, "i0")):

        def _reduce(spark, d, how=_how, axis=_axis):
            return T.reduce_axes(long(spark, d), how, axis).select("i0", rounded("v").alias("v"))

        register(f"op_tensor_{_how}_axis{_axis}", f"WITH t AS {_LONG} SELECT {_key} AS i0, round({_agg}(v), 6) + 0.0 AS v FROM t GROUP BY 1")(_reduce)


@register("op_tensor_max_gradient", f"WITH t AS {_LONG}, m AS (SELECT *, max(v) OVER (PARTITION BY i0) AS top FROM t) SELECT i0, i1, CASE WHEN v = top THEN 1.0 / count(*) FILTER (v = top) OVER (PARTITION BY i0) ELSE 0.0 END AS v FROM m")
def _max_gradient(spark, d):
    return T.max_gradient(long(spark, d), 1)


@register("op_tensor_reshape", f"WITH t AS {_LONG} SELECT i0 * 16 + i1 // 4 AS i0, i1 % 4 AS i1, round(v, 6) + 0.0 AS v FROM t")
def _reshape(spark, d):
    n = table(spark, d, "embeddings").count()
    return T.reshape(long(spark, d), (n, WIDE), (-1, 4)).select("i0", "i1", rounded("v").alias("v"))


@register("op_tensor_transpose", f"WITH t AS {_LONG} SELECT i1 AS i0, i0 AS i1, round(v, 6) + 0.0 AS v FROM t")
def _transpose(spark, d):
    return T.transpose(long(spark, d)).select("i0", "i1", rounded("v").alias("v"))


@register("op_tensor_slice", f"WITH t AS {_LONG} SELECT i0, (i1 - 1) // 2 AS i1, round(v, 6) + 0.0 AS v FROM t WHERE i1 % 2 = 1")
def _slice(spark, d):
    return T.take(long(spark, d), 1, 1, WIDE, 2).select("i0", "i1", rounded("v").alias("v"))


@register("op_tensor_concat", f"WITH t AS {_LONG} SELECT i0, i1 + 64 * k AS i1, round(v, 6) + 0.0 AS v FROM t, range(2) AS r(k)")
def _concat(spark, d):
    t = long(spark, d)
    return T.concat([t, t], [WIDE, WIDE], 1).select("i0", "i1", rounded("v").alias("v"))


@register("op_tensor_stack", f"WITH t AS {_LONG} SELECT k AS i0, i0 AS i1, i1 AS i2, round(v * (1 + k), 6) + 0.0 AS v FROM t, range(2) AS r(k)")
def _stack(spark, d):
    t = long(spark, d)
    return T.stack([t, t.withColumn("v", F.col("v") * 2)]).select("i0", "i1", "i2", rounded("v").alias("v"))


@register("op_tensor_matmul", f"WITH t AS {_LONG} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM t a JOIN t b ON a.i0 = b.i0 GROUP BY 1, 2")
def _matmul(spark, d):
    t = long(spark, d)
    return T.matmul(T.transpose(t), t).select("i0", "i1", rounded("v").alias("v"))


@register("op_tensor_zeros_ones", "SELECT CAST(k // 4 AS BIGINT) AS i0, CAST(k % 4 AS BIGINT) AS i1, 0.0::DOUBLE AS z, 1.0::DOUBLE AS o FROM range(12) AS t(k)")
def _filled(spark, d):
    z, o = T.filled(spark, (3, 4), 0.0), T.filled(spark, (3, 4), 1.0)
    return z.withColumnRenamed("v", "z").join(o.withColumnRenamed("v", "o"), ["i0", "i1"])


_IMG = "(SELECT vec_id AS n, CAST(j // 8 AS BIGINT) AS h, CAST(j % 8 AS BIGINT) AS w, CAST(embedding[CAST(j AS INTEGER) + 1] AS DOUBLE) AS v FROM embeddings, range(64) AS t(j))"


def _images(spark, d):
    t = T.from_arrays(table(spark, d, "embeddings"), "vec_id", "embedding")
    return t.select("i0", F.lit(0).cast("long").alias("i1"), F.floor(F.col("i1") / 8).alias("i2"), F.pmod("i1", F.lit(8)).alias("i3"), "v")


@register("op_nn_conv2d", f"WITH x AS {_IMG}, k AS (SELECT CAST(o AS BIGINT) AS o, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, (o + 1) * (a - 1) + 0.5 * b AS wt FROM range(2) AS q(o), range(3) AS r(a), range(3) AS s(b)) SELECT n, o, h - a + 1 AS oh, w - b + 1 AS ow, round(sum(v * wt) + o, 6) + 0.0 AS v FROM x, k WHERE h - a + 1 BETWEEN 0 AND 7 AND w - b + 1 BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4")
def _conv(spark, d):
    k = spark.range(18).select(*[c.alias(f"i{n}") for n, c in enumerate(T.unravel(F.col("id"), (2, 1, 3, 3)))])
    k = k.withColumn("v", (F.col("i0") + 1) * (F.col("i2") - 1) + 0.5 * F.col("i3"))
    bias = spark.range(2).select(F.col("id").alias("i0"), F.col("id").cast("double").alias("v"))
    out = T.convolve(_images(spark, d), k, (8, 8), (3, 3), 1, 1, bias)
    return out.select(F.col("i0").alias("n"), F.col("i1").alias("o"), F.col("i2").alias("oh"), F.col("i3").alias("ow"), rounded("v").alias("v"))


@register("op_nn_max_pool2d", f"WITH x AS {_IMG} SELECT n, h // 2 AS oh, w // 2 AS ow, round(max(v), 6) + 0.0 AS v FROM x GROUP BY 1, 2, 3")
def _pool(spark, d):
    return T.max_pool(_images(spark, d), (8, 8), (2, 2)).select(F.col("i0").alias("n"), F.col("i2").alias("oh"), F.col("i3").alias("ow"), rounded("v").alias("v"))


@register("op_nn_im2col", f"WITH x AS {_IMG} SELECT n, h, w, h - a AS oh, w - b AS ow, CAST(a AS BIGINT) AS kh, CAST(b AS BIGINT) AS kw, round(v, 6) + 0.0 AS v FROM x, range(3) AS r(a), range(3) AS s(b) WHERE h - a BETWEEN 0 AND 5 AND w - b BETWEEN 0 AND 5")
def _im2col(spark, d):
    w = T.windows(_images(spark, d), (8, 8), (3, 3), 1)
    return w.select("n", "h", "w", "oh", "ow", F.col("kh").cast("long").alias("kh"), F.col("kw").cast("long").alias("kw"), rounded("v").alias("v"))


# ---- losses ----

_P, _Q = "value / (value + 50)", "(event_type = 'purchase')::INT::DOUBLE"
LOSSES = {
    "mse": (lambda: L.mse_loss(F.col("p"), F.col("t")), "avg((p - t) * (p - t))"),
    "mae": (lambda: L.mae_loss(F.col("p"), F.col("t")), "avg(abs(p - t))"),
    "bce": (lambda: L.bce_loss(F.col("p"), F.col("t")), "avg(-(t * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - t) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7))))"),
    "bce_with_logits": (lambda: L.bce_with_logits(F.col("x"), F.col("t"), pos_weight=2.0), "avg((greatest(x, 0) - x * t + ln(1 + exp(-abs(x)))) * (1 + t))"),
    "huber": (lambda: L.huber_loss(F.col("x"), F.col("t")), "avg(CASE WHEN abs(x - t) <= 1 THEN 0.5 * (x - t) * (x - t) ELSE abs(x - t) - 0.5 END)"),
    "kl_div": (lambda: L.kl_div(E.log(F.col("p")), F.col("t")), "avg(t * (ln(greatest(t, 1e-8)) - ln(p)))"),
}
for _name, (_f, _sql) in LOSSES.items():

    def _loss(spark, d, f=_f):
        e = table(spark, d, "events").select((F.col("value") / (F.col("value") + 50)).alias("p"), ((F.col("value") - 50) / 25).alias("x"), (F.col("event_type") == "purchase").cast("double").alias("t"))
        return e.agg(rounded(f()).alias("loss"))

    register(f"op_loss_{_name}", f"WITH t AS (SELECT {_P} AS p, {X} AS x, {_Q} AS t FROM events) SELECT round({_sql}, 6) + 0.0 AS loss FROM t")(_loss)

_CE = f"WITH t AS {_LONG}, l AS (SELECT i0, i1, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY i0)) AS lp FROM (SELECT *, max(v) OVER (PARTITION BY i0) AS m FROM t)), y AS (SELECT vec_id, label % 8 AS y FROM embeddings)"


def _logits(spark, d):
    return table(spark, d, "embeddings").select(F.transform("embedding", lambda v: v.cast("double")).alias("e"), F.pmod("label", F.lit(8)).alias("y"))


@register("op_loss_cross_entropy", f"{_CE} SELECT round(avg(-lp), 6) AS loss FROM l JOIN y ON i0 = vec_id AND i1 = y")
def _ce(spark, d):
    return _logits(spark, d).agg(rounded(L.cross_entropy(F.col("e"), F.col("y"))).alias("loss"))


@register("op_loss_cross_entropy_smoothed", f"{_CE} SELECT round(sum(-lp * (CASE WHEN i1 = y THEN 0.9 ELSE 0 END + 0.0015625)) / count(DISTINCT i0), 6) AS loss FROM l JOIN y ON i0 = vec_id")
def _ces(spark, d):
    return _logits(spark, d).agg(rounded(L.cross_entropy(F.col("e"), F.col("y"), label_smoothing=0.1)).alias("loss"))


@register("op_loss_nll", f"{_CE} SELECT round(sum(-lp), 4) AS loss FROM l JOIN y ON i0 = vec_id AND i1 = y")
def _nll(spark, d):
    return _logits(spark, d).withColumn("lp", E.log_softmax(F.col("e"))).agg(rounded(L.nll_loss(F.col("lp"), F.col("y"), "sum"), 4).alias("loss"))


# ---- preprocessing over lineitem's numbers, keyed by all that identifies a row ----

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark, d, *more):
    return table(spark, d, "lineitem").select(*_KEY.split(", "), *NUM, *more)


def _scaled(name: str, make: Callable, sql: str, stats: str) -> None:
    def run(spark, d):
        df = _lines(spark, d)
        return make().fit(df).transform(df).select(*_KEY.split(", "), *[rounded(c, 5).alias(c) for c in NUM])

    one = ", ".join(f"round({sql.replace('@', c)}, 5) + 0.0 AS {c}" for c in NUM)
    register(name, f"WITH s AS (SELECT {', '.join(stats.replace('@', c) for c in NUM)} FROM lineitem) SELECT {_KEY}, {one} FROM lineitem, s")(run)


_scaled("op_prep_standard_scaler", lambda: prep.StandardScaler(NUM), "(@ - m_@) / s_@", "avg(@) AS m_@, stddev_pop(@) AS s_@")
_scaled("op_prep_min_max_scaler", lambda: prep.MinMaxScaler(NUM, feature_range=(-1, 1)), "(@ - a_@) / (b_@ - a_@) * 2 - 1", "min(@) AS a_@, max(@) AS b_@")
_scaled("op_prep_max_abs_scaler", lambda: prep.MaxAbsScaler(NUM), "@ / m_@", "max(abs(@)) AS m_@")
_scaled("op_prep_robust_scaler", lambda: prep.RobustScaler(NUM), "(@ - m_@) / (b_@ - a_@)", "quantile_cont(@, 0.25) AS a_@, median(@) AS m_@, quantile_cont(@, 0.75) AS b_@")
for _norm, _sql in (("l1", "({0})"), ("l2", "sqrt({1})"), ("max", "greatest({2})")):
    _size = _sql.format(" + ".join(f"abs({c})" for c in NUM), " + ".join(f"{c} * {c}" for c in NUM), ", ".join(f"abs({c})" for c in NUM))
    _scaled(f"op_prep_normalizer_{_norm}", lambda n=_norm: prep.Normalizer(NUM, n), f"@ / {_size}", "min(1) AS one_@")
_scaled("op_prep_binarizer", lambda: prep.Binarizer(NUM, 0.05), "CASE WHEN @ > 0.05 THEN 1.0 ELSE 0.0 END", "min(1) AS one_@")


@register("op_prep_scaler_inverse", f"SELECT {_KEY}, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in NUM)} FROM lineitem")
def _inverse(spark, d):
    df = _lines(spark, d)
    for s in (prep.StandardScaler(NUM), prep.MinMaxScaler(NUM), prep.RobustScaler(NUM), prep.MaxAbsScaler(NUM)):
        df = s.fit(df).inverse_transform(s.transform(df))
    return df.select(*_KEY.split(", "), *[rounded(c, 4).alias(c) for c in NUM])


@register("op_prep_polynomial", f"SELECT {_KEY}, 1.0::DOUBLE AS p0, l_quantity AS p1, l_discount AS p2, l_quantity * l_quantity AS p3, round(l_quantity * l_discount, 6) AS p4, round(l_discount * l_discount, 6) AS p5 FROM lineitem")
def _poly(spark, d):
    out = prep.PolynomialFeatures(["l_quantity", "l_discount"]).transform(_lines(spark, d))
    return out.select(*_KEY.split(", "), "p0", "p1", "p2", "p3", rounded("p4").alias("p4"), rounded("p5").alias("p5"))


@register("op_prep_function_transformer", f"SELECT {_KEY}, round(ln(1 + l_extendedprice), 6) AS y FROM lineitem")
def _function(spark, d):
    f = prep.FunctionTransformer(lambda df: df.withColumn("y", F.log1p("l_extendedprice")))
    return f.fit_transform(_lines(spark, d)).select(*_KEY.split(", "), rounded("y").alias("y"))


@register("op_prep_label_encoder", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS label FROM orders")
def _label(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return prep.LabelEncoder("o_orderpriority").fit(df).transform(df).select("o_orderkey", "label")


@register("op_prep_ordinal_encoder", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS seg, CAST(dense_rank() OVER (ORDER BY c_nationkey) - 1 AS DOUBLE) AS nat FROM customer")
def _ordinal(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    return prep.OrdinalEncoder(["seg", "nat"]).fit(df).transform(df)


@register("op_prep_one_hot_encoder", "WITH k AS (SELECT DISTINCT p_type FROM part) SELECT p_partkey, k.p_type AS category, CASE WHEN part.p_type = k.p_type THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM part, k")
def _one_hot(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_type")
    e = prep.OneHotEncoder(["p_type"]).fit(df)
    pairs = F.array(*[F.struct(F.lit(v).alias("category"), F.col(f"`p_type_{v}`").alias("v")) for _, v in e.kept()])
    return e.transform(df).select("p_partkey", F.inline(pairs))


@register("op_prep_one_hot_drop_first", "WITH k AS (SELECT DISTINCT o_orderstatus AS s FROM orders) SELECT o_orderkey, k.s AS category, CASE WHEN o_orderstatus = k.s THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM orders, k WHERE k.s <> (SELECT min(s) FROM k)")
def _one_hot_drop(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    e = prep.OneHotEncoder(["o_orderstatus"], drop="first").fit(df)
    pairs = F.array(*[F.struct(F.lit(v).alias("category"), F.col(f"o_orderstatus_{v}").alias("v")) for _, v in e.kept()])
    return e.transform(df).select("o_orderkey", F.inline(pairs))


_HOLES = "CASE WHEN l_quantity IN (7, 13) THEN NULL ELSE l_quantity END"
for _strategy, _sql in (("mean", "avg(q)"), ("median", "median(q)"), ("most_frequent", "(SELECT q FROM h WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)"), ("constant", "-1.0")):

    def _impute(spark, d, strategy=_strategy):
        df = _lines(spark, d).withColumn("q", F.when(~F.col("l_quantity").isin(7, 13), F.col("l_quantity")))
        return prep.SimpleImputer(["q"], strategy, -1.0).fit(df).transform(df).select(*_KEY.split(", "), rounded("q").alias("q"))

    register(f"op_prep_imputer_{_strategy}", f"WITH h AS (SELECT {_KEY}, {_HOLES} AS q FROM lineitem), s AS (SELECT {_sql} AS m FROM h LIMIT 1) SELECT {_KEY}, round(coalesce(q, m), 6) + 0.0 AS q FROM h, s")(_impute)


@register("op_prep_knn_imputer", """WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS a, c_nationkey::DOUBLE AS b, c_custkey::DOUBLE / 100 AS c FROM customer),
d AS (SELECT q.c_custkey, t.a, row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt((q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)), t.c_custkey) AS k FROM t q, t WHERE q.a IS NULL AND q.c_custkey <> t.c_custkey)
SELECT t.c_custkey, round(coalesce(t.a, m.v, (SELECT avg(a) FROM t)), 4) AS a FROM t LEFT JOIN (SELECT c_custkey, avg(a) AS v FROM d WHERE k <= 5 GROUP BY 1) m ON m.c_custkey = t.c_custkey""")
def _knn_impute(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.when(F.pmod("c_custkey", F.lit(10)) != 3, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"), (F.col("c_custkey") / 100).alias("c"))
    return prep.KNNImputer(["a", "b", "c"], "c_custkey").fit(df).transform(df).select("c_custkey", rounded("a", 4).alias("a"))


@register("op_prep_power_transformer", """WITH x AS (SELECT event_id, value AS x FROM events), l AS (SELECT i, -2 + 4 * i / 99.0::DOUBLE AS lam FROM range(100) AS t(i)),
y AS (SELECT event_id, i, x, CASE WHEN abs(lam) < 1e-10 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END AS y FROM x, l),
ll AS (SELECT i, -0.5 * count(*) * ln(var_pop(y)) + (max(lam) - 1) * sum(ln(1 + x)) AS ll FROM y JOIN l USING (i) GROUP BY i),
best AS (SELECT i FROM ll ORDER BY ll DESC, i LIMIT 1)
SELECT event_id, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 5) + 0.0 AS y FROM y JOIN best USING (i)""")
def _power(spark, d):
    df = table(spark, d, "events").select("event_id", F.col("value").alias("y"))
    return prep.PowerTransformer(["y"]).fit(df).transform(df).select("event_id", rounded("y", 5).alias("y"))


# ---- resampling ----

_MD5 = "row_number() OVER (ORDER BY md5('7-' || o_orderkey)) - 1"


@register("op_data_train_test_split", f"WITH t AS (SELECT o_orderkey, {_MD5} AS k FROM orders) SELECT o_orderkey, k < greatest(1, floor((SELECT count(*) FROM orders) * 0.2)) AS is_test FROM t")
def _split(spark, d):
    return resample.train_test_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", random_state=7)


@register("op_data_train_test_split_stratified", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7-' || o_orderkey)) <= greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2)) AS is_test FROM orders")
def _split_strat(spark, d):
    return resample.train_test_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", random_state=7, stratify="o_orderstatus").drop("o_orderstatus")


@register("op_data_kfold", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def _kfold(spark, d):
    return resample.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@register("op_data_kfold_shuffled", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY md5('3-' || o_orderkey)) - 1 AS INTEGER) AS fold FROM orders")
def _kfold_s(spark, d):
    return resample.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, True, 3)


@register("op_data_stratified_kfold", "SELECT o_orderkey, CAST(ntile(5) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders")
def _skfold(spark, d):
    return resample.stratified_kfold(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority").drop("o_orderpriority")


@register("op_data_leave_one_out", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders")
def _loo(spark, d):
    return resample.leave_one_out(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@register("op_data_loader", f"WITH t AS (SELECT o_orderkey, o_totalprice, {_MD5} AS k FROM orders) SELECT k // 32 AS batch_id, count(*) AS n, round(sum(o_totalprice), 2) AS total, arg_min(o_orderkey, k) AS head FROM t WHERE k // 32 < (SELECT count(*) // 32 FROM orders) GROUP BY 1")
def _loader(spark, d):
    b = resample.batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 32, True, True, 7)
    return b.groupBy("batch_id").agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"), F.min_by("o_orderkey", "place").alias("head"))


@register("op_data_collate", "WITH t AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) SELECT k // 64 AS batch_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) AS ids FROM t GROUP BY 1")
def _collate(spark, d):
    b = resample.collate(resample.batches(table(spark, d, "events").select("event_id"), "event_id", 64), ["event_id"])
    return b.select("batch_id", F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@register("op_data_subset", "WITH i AS (SELECT p AS pos, (p * 37) % 1000 AS row_id FROM range(50) AS t(p)) SELECT pos, o_orderkey, o_totalprice FROM i JOIN orders ON row_id = o_orderkey")
def _subset(spark, d):
    i = spark.range(50).select(F.col("id").alias("pos"), F.pmod(F.col("id") * 37, F.lit(1000)).alias("row_id"))
    return resample.subset(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", i)


@register("op_data_concat", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey + (SELECT count(*) FROM orders), o_totalprice FROM orders")
def _concat_ds(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return resample.concat_datasets([df, df], "o_orderkey")


@register("op_data_array_dataset", "SELECT o_orderkey AS row_id, o_totalprice AS a, o_orderstatus AS b FROM orders")
def _array_ds(spark, d):
    from ..sources.datasets import array_dataset

    o = table(spark, d, "orders")
    return array_dataset(o.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("a")), o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("b")))


# ---- metrics ----

REGRESSION = {
    "mean_squared_error": (metrics.mean_squared_error, "avg((y - p) * (y - p))", 0),
    "root_mean_squared_error": (lambda y, p: metrics.mean_squared_error(y, p, False), "sqrt(avg((y - p) * (y - p)))", 4),
    "mean_absolute_error": (metrics.mean_absolute_error, "avg(abs(y - p))", 4),
    "r2_score": (metrics.r2_score, "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y) + 1e-10)", 6),
    "mean_absolute_percentage_error": (metrics.mean_absolute_percentage_error, "100 * avg(abs((y - p) / y))", 5),
    "explained_variance_score": (metrics.explained_variance_score, "1 - var_pop(y - p) / (var_pop(y) + 1e-10)", 6),
    "max_error": (metrics.max_error, "max(abs(y - p))", 4),
    "median_absolute_error": (metrics.median_absolute_error, "median(abs(y - p))", 4),
    "mean_squared_log_error": (metrics.mean_squared_log_error, "avg((ln(1 + y) - ln(1 + p)) * (ln(1 + y) - ln(1 + p)))", 6),
    "huber_loss": (metrics.huber_loss, "avg(CASE WHEN abs(y - p) <= 1 THEN 0.5 * (y - p) * (y - p) ELSE abs(y - p) - 0.5 END)", 4),
}
for _name, (_f, _sql, _digits) in REGRESSION.items():

    def _regression(spark, d, f=_f, digits=_digits):
        df = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100).alias("p"))
        return df.agg(rounded(f("y", "p"), digits).alias("score"))

    register(f"op_metric_{_name}", f"WITH t AS (SELECT l_extendedprice AS y, l_quantity * 2100 AS p FROM lineitem) SELECT round({_sql}, {_digits}) + 0.0 AS score FROM t")(_regression)

_CLS = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, CAST(o_orderkey % 7 AS INTEGER) % 3 AS p FROM orders)"


def _classes(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(s == "F", 0).when(s == "O", 1).otherwise(2).alias("y"), (F.pmod("o_orderkey", F.lit(7)).cast("int") % 3).alias("p"))


_PER = f"c AS (SELECT l, sum((y = l AND p = l)::INT) AS tp, sum((y <> l AND p = l)::INT) AS fp, sum((y = l AND p <> l)::INT) AS fn, sum((y = l)::INT) AS n FROM {_CLS}, (SELECT DISTINCT y AS l FROM {_CLS}) GROUP BY l), r AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / (tp + fn)::DOUBLE AS re FROM c), f AS (SELECT *, 2 * pr * re / (pr + re) AS f1 FROM r)"


@register("op_metric_accuracy", f"SELECT round(avg((y = p)::INT), 6) AS score FROM {_CLS}")
def _accuracy(spark, d):
    return _classes(spark, d).agg(rounded(metrics.accuracy_score("y", "p")).alias("score"))


@register("op_metric_confusion_matrix", f"WITH k AS (SELECT DISTINCT y AS l FROM {_CLS} UNION SELECT DISTINCT p FROM {_CLS}) SELECT a.l AS y_true, b.l AS y_pred, count(id) AS n FROM k a CROSS JOIN k b LEFT JOIN {_CLS} t ON t.y = a.l AND t.p = b.l GROUP BY 1, 2")
def _confusion(spark, d):
    return metrics.confusion_matrix(_classes(spark, d), "y", "p")


for _avg, _sql in (("binary", "arg_max(@, l)"), ("macro", "avg(@)"), ("weighted", "sum(@ * n) / sum(n)")):

    def _prf(spark, d, average=_avg):
        out = metrics.precision_recall_fscore(_classes(spark, d), "y", "p", average)
        return out.select(*[rounded(c).alias(c) for c in ("precision", "recall", "f1")])

    register(f"op_metric_precision_recall_{_avg}", f"WITH {_PER} SELECT " + ", ".join(f"round({_sql.replace('@', a)}, 6) AS {b}" for a, b in (("pr", "precision"), ("re", "recall"), ("f1", "f1"))) + " FROM f")(_prf)


@register("op_metric_precision_recall_micro", f"WITH {_PER} SELECT round(sum(tp) / (sum(tp) + sum(fp))::DOUBLE, 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn))::DOUBLE, 6) AS recall, round(sum(tp) / (sum(tp) + sum(fp))::DOUBLE, 6) AS f1 FROM f")
def _prf_micro(spark, d):
    out = metrics.precision_recall_fscore(_classes(spark, d), "y", "p", "micro")
    return out.select(*[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


@register("op_metric_precision_recall_per_class", f"WITH {_PER} SELECT l AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _prf_each(spark, d):
    out = metrics.precision_recall_fscore(_classes(spark, d), "y", "p", None)
    return out.select("label", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


@register("op_metric_balanced_accuracy", f"WITH {_PER} SELECT round(avg(re), 6) AS balanced_accuracy FROM f")
def _balanced(spark, d):
    return metrics.balanced_accuracy_score(_classes(spark, d), "y", "p").select(rounded("balanced_accuracy").alias("balanced_accuracy"))


@register("op_metric_cohen_kappa", f"WITH {_PER}, t AS (SELECT sum(tp) / sum(n)::DOUBLE AS po, sum(n * (tp + fp)) / (sum(n) * sum(n))::DOUBLE AS pe FROM f) SELECT round((po - pe) / (1 - pe + 1e-10), 6) AS kappa FROM t")
def _kappa(spark, d):
    return metrics.cohen_kappa_score(_classes(spark, d), "y", "p").select(rounded("kappa").alias("kappa"))


_REPORT_SQL = """, c AS (SELECT l AS label, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS named FROM t, (SELECT y AS l FROM t UNION SELECT p FROM t) GROUP BY 1),
r AS (SELECT label, support, tp, CASE WHEN named > 0 THEN tp / named::DOUBLE ELSE 0 END AS a, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS b FROM c),
f AS (SELECT *, CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END AS f FROM r), n AS (SELECT sum(support) AS n, sum(tp) AS tp FROM c),
line AS (
  SELECT CAST(label AS VARCHAR) AS name, printf('%.4f', a) AS a, printf('%.4f', b) AS b, printf('%.4f', f) AS f, CAST(support AS VARCHAR) AS k FROM f
  UNION ALL SELECT 'accuracy', '', '', printf('%.4f', tp / n::DOUBLE), CAST(n AS VARCHAR) FROM n
  UNION ALL SELECT 'macro avg', printf('%.4f', avg(a)), printf('%.4f', avg(b)), printf('%.4f', avg(f)), CAST(max(n) AS VARCHAR) FROM f, n
  UNION ALL SELECT 'weighted avg', printf('%.4f', sum(a * support / n)), printf('%.4f', sum(b * support / n)), printf('%.4f', sum(f * support / n)), CAST(max(n) AS VARCHAR) FROM f, n)
SELECT name, a AS precision, b AS recall, f AS f1, k AS support FROM line"""


@register("op_metric_classification_report", f"WITH t AS {_CLS}{_REPORT_SQL}")
def _report(spark, d):
    """The report's lines, read back by its fixed widths."""
    text = metrics.classification_report(_classes(spark, d), "y", "p")
    lines = [x for x in text.split("\n")[1:] if x]
    rows = [tuple(x.strip() for x in (x[:-44], x[-42:-33], x[-31:-22], x[-20:-11], x[-9:])) for x in lines]
    return spark.createDataFrame(rows, "name string, precision string, recall string, f1 string, support string")


_ROC = "(SELECT event_id AS id, (event_type = 'purchase')::INT AS y, round(value, 0) AS s FROM events)"
_RUN = f"r AS (SELECT id, y, s, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(y) OVER () AS p, count(*) OVER () AS n FROM {_ROC} WINDOW w AS (ORDER BY s DESC, id))"


def _scores(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("y"), F.round("value", 0).alias("s"))


@register("op_metric_roc_curve", f"WITH {_RUN} SELECT k AS rank, round((k - tp) / (n - p)::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr, s AS threshold FROM r UNION ALL SELECT 0, 0, 0, max(s) + 1 FROM r")
def _roc(spark, d):
    return metrics.roc_curve(_scores(spark, d), "y", "s", "id").select("rank", rounded("fpr").alias("fpr"), rounded("tpr").alias("tpr"), "threshold")


@register("op_metric_roc_auc", f"WITH {_RUN} SELECT round(sum((1 - y) * tp) / (max(p) * (max(n) - max(p)))::DOUBLE, 6) AS auc FROM r")
def _auc(spark, d):
    return metrics.roc_auc_score(_scores(spark, d), "y", "s", "id").select(rounded("auc").alias("auc"))


@register("op_metric_average_precision", f"WITH {_RUN}, a AS (SELECT tp / p::DOUBLE AS re, tp / k::DOUBLE AS pr, k FROM r UNION ALL SELECT 0, 1, 0), b AS (SELECT (re - lag(re) OVER (ORDER BY k)) * (pr + lag(pr) OVER (ORDER BY k)) / 2 AS t FROM a) SELECT round(sum(t), 6) AS average_precision FROM b")
def _ap(spark, d):
    return metrics.average_precision_score(_scores(spark, d), "y", "s", "id").select(rounded("average_precision").alias("average_precision"))


@register("op_metric_log_loss", f"WITH t AS (SELECT {_Q} AS y, least(greatest({_P}, 1e-7), 1 - 1e-7) AS p FROM events) SELECT round(avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS score FROM t")
def _log_loss(spark, d):
    p = F.col("value") / (F.col("value") + 50)
    df = table(spark, d, "events").select((F.col("event_type") == "purchase").cast("int").alias("y"), F.array(1 - p, p).alias("p"))
    return df.agg(rounded(metrics.log_loss("y", "p")).alias("score"))


_PART = "(SELECT vec_id, label AS a, CAST(CASE WHEN embedding[1] > 0 THEN label % 4 ELSE label % 3 END AS INTEGER) AS b FROM embeddings)"


def _partitions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("a"), F.when(F.col("embedding")[0] > 0, F.col("label") % 4).otherwise(F.col("label") % 3).alias("b"))


@register("op_metric_adjusted_rand", f"WITH t AS {_PART}, c AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM t GROUP BY a, b)), x AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*)::DOUBLE AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT count(*)::DOUBLE AS n FROM t GROUP BY b)) SELECT round((c.s - x.s * y.s / (c.t * (c.t - 1) / 2)) / ((x.s + y.s) / 2 - x.s * y.s / (c.t * (c.t - 1) / 2)), 6) AS ari FROM c, x, y")
def _ari(spark, d):
    return metrics.adjusted_rand_score(_partitions(spark, d), "a", "b").select(rounded("ari").alias("ari"))


@register("op_metric_normalized_mutual_info", f"WITH t AS {_PART}, n AS (SELECT count(*)::DOUBLE AS n FROM t), ab AS (SELECT a, b, count(*) AS c FROM t GROUP BY 1, 2), x AS (SELECT a, count(*) AS c FROM t GROUP BY 1), y AS (SELECT b, count(*) AS c FROM t GROUP BY 1), mi AS (SELECT sum(ab.c / n * ln(ab.c * n / (x.c * y.c))) AS m FROM ab JOIN x USING (a) JOIN y USING (b), n), h AS (SELECT (SELECT -sum(c / n * ln(c / n)) FROM x, n) AS p, (SELECT -sum(c / n * ln(c / n)) FROM y, n) AS q) SELECT round(m / ((p + q) / 2), 6) AS nmi FROM mi, h")
def _nmi(spark, d):
    return metrics.normalized_mutual_info_score(_partitions(spark, d), "a", "b").select(rounded("nmi").alias("nmi"))


DIMS = [f"e{k}" for k in range(WIDE)]
_WIDE = "(SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(WIDE)) + " FROM embeddings)"


def wide(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(WIDE)])


def _far(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.e{k} - {b}.e{k}) * ({a}.e{k} - {b}.e{k})" for k in range(WIDE)) + ")"


@register("op_metric_silhouette", f"WITH t AS {_WIDE}, d AS (SELECT p.vec_id, p.label, q.label AS o, avg({_far('p', 'q')}) AS d FROM t p, t q WHERE p.vec_id <> q.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, max(d) FILTER (label = o) AS a, min(d) FILTER (label <> o) AS b FROM d GROUP BY 1) SELECT vec_id AS id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) + 0.0 AS silhouette FROM s")
def _silhouette(spark, d):
    return metrics.silhouette_samples(wide(spark, d), DIMS, "label", "vec_id").select("id", rounded("silhouette").alias("silhouette"))


_MEANS = ", ".join(f"avg(e{k}) AS e{k}" for k in range(WIDE))


@register("op_metric_davies_bouldin", f"WITH t AS {_WIDE}, m AS (SELECT label, {_MEANS} FROM t GROUP BY 1), s AS (SELECT m.label, avg({_far('t', 'm')}) AS s FROM t JOIN m USING (label) GROUP BY 1), r AS (SELECT p.label, max((a.s + b.s) / {_far('p', 'q')}) AS r FROM m p JOIN s a ON a.label = p.label, m q JOIN s b ON b.label = q.label WHERE p.label <> q.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def _db(spark, d):
    return metrics.davies_bouldin_score(wide(spark, d), DIMS, "label").select(rounded("davies_bouldin").alias("davies_bouldin"))


@register("op_metric_calinski_harabasz", f"WITH t AS {_WIDE}, m AS (SELECT label, count(*) AS n, {_MEANS} FROM t GROUP BY 1), g AS (SELECT {_MEANS} FROM t), b AS (SELECT sum(n * pow({_far('m', 'g')}, 2)) AS b, count(*) AS k FROM m, g), w AS (SELECT sum(pow({_far('t', 'm')}, 2)) AS w, count(*) AS n FROM t JOIN m USING (label)) SELECT round(b / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w")
def _ch(spark, d):
    return metrics.calinski_harabasz_score(wide(spark, d), DIMS, "label").select(rounded("calinski_harabasz").alias("calinski_harabasz"))


# ---- estimators ----


@register("op_model_linear_regression", "WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 2) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM t")
def _ols(spark, d):
    df = table(spark, d, "lineitem")
    m = linear.LinearRegression(["l_quantity"], "l_extendedprice").fit(df)
    scored = m.transform(df).agg(metrics.r2_score("l_extendedprice", "prediction").alias("r2"))
    return scored.select(rounded(F.lit(float(m.coef_[0])), 4).alias("slope"), rounded(F.lit(m.intercept_), 2).alias("intercept"), rounded("r2").alias("r2"))


_R2 = "WITH t AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t), s AS (SELECT sum((a - ma) * (a - ma)) + {0} AS aa, sum((a - ma) * (b - mb)) AS ab, sum((b - mb) * (b - mb)) + {0} AS bb, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS byy, max(ma) AS ma, max(mb) AS mb, max(my) AS my FROM t, m), w AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, * FROM s) SELECT round(wa, 6) AS wa, round(wb, 6) AS wb, round(my - wa * ma - wb * mb, 5) AS bias FROM w"


def _two(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))


def _weights(spark, m):
    return spark.createDataFrame([(float(m.coef_[0]), float(m.coef_[1]), float(m.intercept_))], "wa double, wb double, bias double").select(rounded("wa").alias("wa"), rounded("wb").alias("wb"), rounded("bias", 5).alias("bias"))


@register("op_model_linear_regression_2d", _R2.format(0))
def _ols2(spark, d):
    return _weights(spark, linear.LinearRegression(["a", "b"], "y").fit(_two(spark, d)))


@register("op_model_ridge", _R2.format(1000))
def _ridge(spark, d):
    return _weights(spark, linear.Ridge(["a", "b"], "y", alpha=1000.0).fit(_two(spark, d)))


#: Coordinate descent in turns over both weights, for the same sums as above: soft thresholds l1, ridge l2 (per row).
_DESCENT = (
    "WITH RECURSIVE " + _R2.format(0).removeprefix("WITH ").split(", w AS")[0] + ", n AS (SELECT count(*) AS n FROM t), "
    "r AS (SELECT 0 AS i, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb UNION ALL SELECT i + 1, na, sign(byy - ab * na) * greatest(abs(byy - ab * na) - {0} * n, 0) / (bb + {1} * n) "
    "FROM (SELECT i, s.*, n, sign(ay - ab * wb) * greatest(abs(ay - ab * wb) - {0} * n, 0) / (aa + {1} * n) AS na FROM r, s, n WHERE i < 200)) "
    "SELECT round(wa, 6) + 0.0 AS wa, round(wb, 6) + 0.0 AS wb, round(my - wa * ma - wb * mb, 5) AS bias FROM r, s WHERE i = 200"
)


@register("op_model_lasso", _DESCENT.format(0.5, 0.0))
def _lasso(spark, d):
    return _weights(spark, linear.Lasso(["a", "b"], "y", alpha=0.5, tol=1e-12).fit(_two(spark, d)))


@register("op_model_elastic_net", _DESCENT.format(0.25, 0.25))
def _enet(spark, d):
    return _weights(spark, linear.ElasticNet(["a", "b"], "y", alpha=0.5, tol=1e-12).fit(_two(spark, d)))


def _logit(spark, d):
    df = wide(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return df, linear.LogisticRegression(DIMS, "y").fit(df)


@register("op_model_logistic_regression")
def _logistic(spark, d):
    df, m = _logit(spark, d)
    return m.transform(df).select("vec_id", "prediction", rounded(F.col("probability")[1]).alias("p"))


@register("op_model_logistic_regression_optimum", f"SELECT CAST(k AS INTEGER) AS param, 0.0::DOUBLE AS gradient FROM range({WIDE + 1}) AS t(k)")
def _logistic_optimum(spark, d):
    """The penalised loss has a gradient of zero at the weights (the bias is the last), by the predicted probabilities."""
    df, m = _logit(spark, d)
    miss = F.col("probability")[1] - F.col("y")
    sums = m.transform(df).agg(*[F.avg(miss * F.col(c)).alias(c) for c in DIMS], F.avg(miss).alias("bias"), F.count("*").alias("n"))
    pull = [float(w) for w in m.coef_[0][:-1]]
    each = [F.struct(F.lit(k).alias("param"), rounded(F.col(c) + w / (m.C * F.col("n"))).alias("gradient")) for k, (c, w) in enumerate(zip([*DIMS, "bias"], [*pull, 0.0], strict=True))]
    return sums.select(F.inline(F.array(*each)))


_NB = f"t AS {_WIDE}, m AS (SELECT label, count(*) / (SELECT count(*) FROM t)::DOUBLE AS prior, " + ", ".join(f"avg(e{k}) AS m{k}, var_pop(e{k}) AS v{k}" for k in range(WIDE)) + " FROM t GROUP BY 1), e AS (SELECT 1e-9 * max(greatest(" + ", ".join(f"v{k}" for k in range(WIDE)) + ")) AS eps FROM m)"


@register("op_model_gaussian_nb", f"WITH {_NB}, j AS (SELECT t.vec_id, m.label, ln(prior) " + " ".join(f"- 0.5 * (ln(2 * pi() * (v{k} + eps)) + (e{k} - m{k}) * (e{k} - m{k}) / (v{k} + eps))" for k in range(WIDE)) + " AS j FROM t, m, e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY j DESC, label) AS k, max(j) OVER (PARTITION BY vec_id) + ln(sum(exp(j - (SELECT max(j) FROM j))) OVER (PARTITION BY vec_id)) + (SELECT max(j) FROM j) - max(j) OVER (PARTITION BY vec_id) AS norm FROM j) SELECT vec_id, label AS prediction, round(j - norm, 5) + 0.0 AS log_p FROM r WHERE k = 1")
def _gnb(spark, d):
    df = wide(spark, d)
    out = bayes.GaussianNB(DIMS, "label").fit(df).transform(df)
    return out.select("vec_id", "prediction", rounded(F.array_max("log_probability"), 5).alias("log_p"))


_WORDS = ["the", "and", "que", "der", "of"]


def _bag(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    count = lambda w: F.coalesce(F.regexp_count(F.lower("text"), F.lit(w)), F.lit(0)).cast("long")
    return t.select("doc_id", "quality", *[count(w).alias(w) for w in _WORDS])


_BAG = "(SELECT doc_id, quality, " + ", ".join(f"len(regexp_extract_all(lower(text), '{w}')) AS w{i}" for i, w in enumerate(_WORDS)) + " FROM documents JOIN labels USING (doc_id))"


@register("op_model_multinomial_nb", f"WITH t AS {_BAG}, s AS (SELECT quality, count(*) / (SELECT count(*) FROM t)::DOUBLE AS prior, " + ", ".join(f"sum(w{i}) + 1 AS s{i}" for i in range(5)) + " FROM t GROUP BY 1), j AS (SELECT doc_id, s.quality, ln(prior) " + " ".join(f"+ w{i} * ln(s{i} / (s0 + s1 + s2 + s3 + s4)::DOUBLE)" for i in range(5)) + " AS j FROM t, s) SELECT doc_id, quality AS prediction, round(j, 4) + 0.0 AS j FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, quality) = 1")
def _mnb(spark, d):
    df = _bag(spark, d)
    m = bayes.MultinomialNB(_WORDS, "quality").fit(df)
    return m.transform(df).select("doc_id", "prediction", rounded(F.greatest(*m._joint()), 4).alias("j"))


@register("op_model_bernoulli_nb", f"WITH t AS {_BAG}, s AS (SELECT quality, count(*) / (SELECT count(*) FROM t)::DOUBLE AS prior, " + ", ".join(f"(sum((w{i} > 0)::INT) + 1) / (count(*) + 2)::DOUBLE AS p{i}" for i in range(5)) + " FROM t GROUP BY 1), j AS (SELECT doc_id, s.quality, ln(prior) " + " ".join(f"+ CASE WHEN w{i} > 0 THEN ln(p{i}) ELSE ln(1 - p{i}) END" for i in range(5)) + " AS j FROM t, s) SELECT doc_id, quality AS prediction, round(j, 5) + 0.0 AS j FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, quality) = 1")
def _bnb(spark, d):
    df = _bag(spark, d)
    m = bayes.BernoulliNB(_WORDS, "quality").fit(df)
    return m.transform(df).select("doc_id", "prediction", rounded(F.greatest(*m._joint()), 5).alias("j"))


_NEAR = f"t AS {_WIDE}, n AS (SELECT q.vec_id, t.vec_id AS other, t.label, {_far('q', 't')} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_far('q', 't')}, t.vec_id) AS k FROM t q, t WHERE q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id)"


def _knn(spark, d, cls, **options):
    df = wide(spark, d)
    asked = F.pmod("vec_id", F.lit(20)) == 0
    return cls(DIMS, "label", "vec_id", others_only=True, **options).fit(df), df.where(asked)


@register("op_model_knn_neighbors", f"WITH {_NEAR} SELECT vec_id, other AS neighbor, label AS y, round(d, 6) AS distance, CAST(k AS INTEGER) AS rank FROM n WHERE k <= 5")
def _knn_near(spark, d):
    m, q = _knn(spark, d, neighbors.KNNClassifier)
    return m.kneighbors(q).withColumn("distance", rounded("distance"))


@register("op_model_knn_classifier", f"WITH {_NEAR}, v AS (SELECT vec_id, label, count(*) AS c FROM n WHERE k <= 5 GROUP BY 1, 2) SELECT vec_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1")
def _knn_class(spark, d):
    m, q = _knn(spark, d, neighbors.KNNClassifier)
    return m.transform(q).select("vec_id", "prediction")


@register("op_model_knn_regressor", f"WITH {_NEAR} SELECT vec_id, round(sum(label / greatest(d, 1e-10)) / sum(1 / greatest(d, 1e-10)), 5) AS prediction FROM n WHERE k <= 5 GROUP BY 1")
def _knn_reg(spark, d):
    m, q = _knn(spark, d, neighbors.KNNRegressor, weights="distance")
    return m.transform(q).select("vec_id", rounded("prediction", 5).alias("prediction"))


_SQ = lambda a, b: " + ".join(f"({a}.e{k} - {b}.e{k}) * ({a}.e{k} - {b}.e{k})" for k in range(WIDE))
_STEP = "a{0} AS (SELECT t.vec_id, c.c, row_number() OVER (PARTITION BY t.vec_id ORDER BY " + _SQ("t", "c") + ", c.c) AS k, " + _SQ("t", "c") + " AS d, t.* EXCLUDE (vec_id, label) FROM t, c{0} c), b{0} AS (SELECT * FROM a{0} WHERE k = 1)"


@register("op_model_kmeans", f"WITH t AS {_WIDE}, c0 AS (SELECT vec_id AS c, t.* EXCLUDE (vec_id, label) FROM t WHERE vec_id < 3), {_STEP.format(0)}, c1 AS (SELECT c, {_MEANS} FROM b0 GROUP BY 1), {_STEP.format(1)}, c2 AS (SELECT c, {_MEANS} FROM b1 GROUP BY 1), {_STEP.format(2)} SELECT vec_id, CAST(c AS INTEGER) AS label, round(d, 6) AS d FROM b2")
def _kmeans(spark, d):
    df = wide(spark, d)
    start = [[r[c] for c in DIMS] for r in df.where("vec_id < 3").orderBy("vec_id").collect()]
    m = cluster.KMeans(DIMS, "vec_id", 3, start, max_iter=2, tol=0.0).fit(df)
    return m.assign(df).select("vec_id", "label", rounded("squared_distance").alias("d"))


@register("op_model_kmeans_plus_plus")
def _kmeanspp(spark, d):
    df = wide(spark, d)
    return cluster.KMeans(DIMS, "vec_id", 4, n_init=2, max_iter=10).fit(df).predict(df).select("vec_id", "label")


_DB = "(SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey::DOUBLE AS y FROM customer)"


@register("op_model_dbscan", f"WITH RECURSIVE t AS {_DB}, n AS (SELECT a.id AS a, b.id AS b FROM t a, t b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.1), core AS (SELECT a FROM n GROUP BY 1 HAVING count(*) >= 6), e AS (SELECT n.a, n.b FROM n JOIN core p ON p.a = n.a JOIN core q ON q.a = n.b), r AS (SELECT a, a AS l FROM core UNION SELECT e.a, r.l FROM r JOIN e ON e.b = r.a WHERE r.l < e.a), l AS (SELECT a, min(l) AS l FROM r GROUP BY 1), c AS (SELECT a, dense_rank() OVER (ORDER BY l) - 1 AS c FROM l), o AS (SELECT n.a, min(c.c) AS c FROM n JOIN c ON c.a = n.b GROUP BY 1) SELECT id, CAST(coalesce(c.c, o.c, -1) AS INTEGER) AS label, c.c IS NOT NULL AS is_core FROM t LEFT JOIN c ON c.a = id LEFT JOIN o ON o.a = id")
def _dbscan(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return cluster.DBSCAN(["x", "y"], "id", 1.1, 6).fit_predict(df).select("id", "label", "is_core")


_ZEROS = f"SELECT CAST(k AS INTEGER) AS component, 0.0::DOUBLE AS off FROM range({WIDE}) AS t(k)"
_TOTAL = f"WITH t AS {_WIDE} SELECT round(" + " + ".join(f"var_samp(e{k})" for k in range(WIDE)) + ", 8) AS total FROM t"


def _covariances(spark, d):
    """By products of coordinate rows, apart from what the estimators use."""
    import numpy as np

    t, n = long(spark, d), table(spark, d, "embeddings").count()
    out = np.zeros((WIDE, WIDE))
    for r in T.matmul(T.transpose(t), t).collect():  # as many rows as pairs of columns
        out[r["i0"], r["i1"]] = r["v"]
    mean = np.array([r["v"] for r in T.reduce_axes(t, "mean", 0).orderBy("i0").collect()])
    return (out - n * np.outer(mean, mean)) / (n - 1), out


def _off(spark, matrix, vectors, values):
    """How far each pair is from an eigenvector of length 1 and its value: the greatest of all conditions' errors."""
    import numpy as np

    m, v = np.array(matrix), np.array(vectors)
    errors = np.maximum(np.abs(m @ v.T - v.T * np.array(values)).max(axis=0), np.abs(v @ v.T - np.eye(len(v))).max(axis=0))
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(errors)], "component int, off double").select("component", rounded("off").alias("off"))


@register("op_model_pca_variance", _TOTAL)
def _pca(spark, d):
    m = decomposition.PCA(DIMS).fit(wide(spark, d))
    return spark.createDataFrame([(float(m.explained_variance_.sum()),)], "total double").select(rounded("total", 8).alias("total"))


@register("op_model_pca_components", _ZEROS)
def _pca_components(spark, d):
    """Components and variances are the eigenvectors and eigenvalues of the covariance matrix."""
    df = wide(spark, d)
    m = decomposition.PCA(DIMS).fit(df)
    return _off(spark, _covariances(spark, d)[0], m.components_, m.explained_variance_)


@register("op_model_pca_2d", "WITH s AS (SELECT var_samp(embedding[1]::DOUBLE) AS a, var_samp(embedding[2]::DOUBLE) AS b, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS c FROM embeddings) SELECT round((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 8) AS first, round((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 8) AS second FROM s")
def _pca2(spark, d):
    m = decomposition.PCA(["e0", "e1"]).fit(wide(spark, d))
    return spark.createDataFrame([tuple(map(float, m.explained_variance_))], "first double, second double").select(rounded("first", 8).alias("first"), rounded("second", 8).alias("second"))


@register("op_model_pca_transform", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS c FROM range(3) AS a(i), range(3) AS b(j)")
def _pca_t(spark, d):
    """Covariances of the whitened scores: one on the diagonal, zero beside it."""
    df = wide(spark, d)
    scores = decomposition.PCA(DIMS, 3, whiten=True).fit(df).transform(df)
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), rounded(F.col(f"c{i}{j}"), 5).alias("c")) for i in range(3) for j in range(3)]
    return scores.agg(*[F.covar_samp(f"pc{i}", f"pc{j}").alias(f"c{i}{j}") for i in range(3) for j in range(3)]).select(F.inline(F.array(*pairs)))


@register("op_model_incremental_pca", _ZEROS)
def _ipca(spark, d):
    df, m = wide(spark, d), decomposition.IncrementalPCA(DIMS)
    for k in range(3):
        m.partial_fit(df.where(F.pmod("vec_id", F.lit(3)) == k))
    return _off(spark, _covariances(spark, d)[0], m.components_, m.explained_variance_)


@register("op_model_truncated_svd", _ZEROS)
def _svd(spark, d):
    """Components and squared singular values are the eigenvectors and eigenvalues of the products' sums; relative to the first."""
    df = wide(spark, d)
    m = decomposition.TruncatedSVD(DIMS, WIDE).fit(df)
    first = float(m.singular_values_[0] ** 2)
    products = _covariances(spark, d)[1] / first
    return _off(spark, products, m.components_, m.singular_values_**2 / first)


_GINI = "1 - (a / n) * (a / n) - (b / n) * (b / n) - (c / n) * (c / n)"


@register("op_model_tree_stump", """WITH t AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_returnflag AS y FROM lineitem), l AS (SELECT f, CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS v, y FROM t, range(3) AS r(f)),
c AS (SELECT f, v, sum((y = 'A')::INT)::DOUBLE AS a, sum((y = 'N')::INT)::DOUBLE AS b, sum((y = 'R')::INT)::DOUBLE AS c FROM l GROUP BY 1, 2),
w AS (SELECT f, v, lead(v) OVER (PARTITION BY f ORDER BY v) AS nx, sum(a) OVER q AS a, sum(b) OVER q AS b, sum(c) OVER q AS c, sum(a) OVER (PARTITION BY f) AS ta, sum(b) OVER (PARTITION BY f) AS tb, sum(c) OVER (PARTITION BY f) AS tc FROM c WINDOW q AS (PARTITION BY f ORDER BY v)),
g AS (SELECT f, (v + nx) / 2 AS thr, ta + tb + tc AS t, a + b + c AS l, 1 - (ta * ta + tb * tb + tc * tc) / pow(ta + tb + tc, 2) AS gt, 1 - (a * a + b * b + c * c) / pow(a + b + c, 2) AS gl, 1 - (pow(ta - a, 2) + pow(tb - b, 2) + pow(tc - c, 2)) / pow(ta + tb + tc - a - b - c, 2) AS gr FROM w WHERE nx IS NOT NULL)
SELECT CAST(f AS INTEGER) AS feature, round(thr, 6) AS threshold, round(gt - (l * gl + (t - l) * gr) / t, 9) AS gain FROM g ORDER BY round(gt - (l * gl + (t - l) * gr) / t, 12) DESC, f, thr LIMIT 1""")
def _stump(spark, d):
    m = tree.DecisionTreeClassifier(["l_quantity", "l_discount", "l_tax"], "l_returnflag", max_depth=1).fit(table(spark, d, "lineitem"))
    r = m.trees_[0]
    return spark.createDataFrame([(r.feature, r.threshold, r.gain)], "feature int, threshold double, gain double").select("feature", rounded("threshold").alias("threshold"), rounded("gain", 9).alias("gain"))


@register("op_model_decision_tree_classifier")
def _tree_c(spark, d):
    df = wide(spark, d)
    return tree.DecisionTreeClassifier(DIMS, "label", max_depth=4).fit(df).transform(df).select("vec_id", "prediction")


@register("op_model_decision_tree_regressor", """WITH t AS (SELECT value AS y, (event_id * 7919 % 1000)::DOUBLE AS x FROM events), c AS (SELECT x, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM t GROUP BY 1),
w AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS n, sum(s) OVER (ORDER BY x) AS s, sum(q) OVER (ORDER BY x) AS q, sum(n) OVER () AS tn, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM c),
g AS (SELECT (x + nx) / 2 AS thr, (tq / tn - pow(ts / tn, 2)) - ((q - s * s / n) + (tq - q - pow(ts - s, 2) / (tn - n))) / tn AS gain FROM w WHERE nx IS NOT NULL) SELECT round(thr, 6) AS threshold, round(gain, 4) AS gain FROM g ORDER BY gain DESC, thr LIMIT 1""")
def _tree_r(spark, d):
    df = table(spark, d, "events").select(F.col("value").alias("y"), F.pmod(F.col("event_id") * 7919, F.lit(1000)).cast("double").alias("x"))
    r = tree.DecisionTreeRegressor(["x"], "y", max_depth=1).fit(df).trees_[0]
    return spark.createDataFrame([(r.threshold, r.gain)], "threshold double, gain double").select(rounded("threshold").alias("threshold"), rounded("gain", 4).alias("gain"))


@register("op_model_random_forest_classifier")
def _forest(spark, d):
    df = wide(spark, d)
    return tree.RandomForestClassifier(DIMS, "label", max_depth=4, n_estimators=8, id_col="vec_id").fit(df).transform(df).select("vec_id", "prediction")


@register("op_model_random_forest_regressor")
def _forest_r(spark, d):
    df = wide(spark, d).withColumn("y", F.col("label").cast("double"))
    return tree.RandomForestRegressor(DIMS, "y", max_depth=4, n_estimators=5, id_col="vec_id").fit(df).transform(df).select("vec_id", rounded("prediction").alias("prediction"))


@register("op_model_gradient_boosting_regressor")
def _gbr(spark, d):
    df = wide(spark, d).withColumn("y", F.col("label").cast("double"))
    return tree.GradientBoostingRegressor(DIMS, "y", "vec_id", n_estimators=5).fit(df).transform(df).select("vec_id", rounded("prediction").alias("prediction"))


@register("op_model_gradient_boosting_classifier")
def _gbc(spark, d):
    df = wide(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return tree.GradientBoostingClassifier(DIMS, "y", "vec_id", n_estimators=5).fit(df).transform(df).select("vec_id", "prediction")


@register("op_model_svc")
def _svc(spark, d):
    from ..operators import svm

    df = wide(spark, d).withColumn("y", (F.col("label") < 5).cast("int"))
    return svm.SVC(DIMS, "y").fit(df).transform(df).select("vec_id", "prediction")


@register("op_model_svr")
def _svr(spark, d):
    from ..operators import svm

    df = wide(spark, d).withColumn("y", F.col("label").cast("double"))
    return svm.SVR(DIMS, "y").fit(df).transform(df).select("vec_id", rounded("prediction", 4).alias("prediction"))


# ---- networks, optimizers, schedules ----


_DENSE = [[(k % 5 - 2) * 0.25, (k % 3 - 1) * 0.5] for k in range(WIDE)]


def _weighted(j: int) -> str:
    return " + ".join(f"({w[j]}) * e{k}" for k, w in enumerate(_DENSE))


@register("op_nn_dense", f"WITH t AS {_WIDE} SELECT vec_id, round({_weighted(0)} + 1, 6) + 0.0 AS y0, round({_weighted(1)} - 1, 6) + 0.0 AS y1 FROM t")
def _dense(spark, d):
    from ..nn.layers import Dense, predict

    layer = Dense(WIDE, 2)
    layer.load({"weight": _DENSE, "bias": [1, -1]})
    out = predict(layer, _arrays(spark, d), "e")
    return out.select("vec_id", rounded(F.col("output")[0]).alias("y0"), rounded(F.col("output")[1]).alias("y1"))


def _arrays(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("e"))


_HALVES = [" + ".join(f"e{k}" for k in r) for r in (range(WIDE // 2), range(WIDE // 2, WIDE))]


@register("op_nn_autograd_gradient", f"WITH t AS (SELECT label, {_HALVES[0]} AS a, {_HALVES[1]} AS b FROM {_WIDE}), g AS (SELECT label / 10.0::DOUBLE - (0.3 * a - 0.2 * b + 0.1) AS r, * FROM t) SELECT round(avg(r * r), 8) AS loss, round(avg(-2 * r * a), 8) AS w0, round(avg(-2 * r * b), 8) AS w1, round(avg(-2 * r), 8) AS b FROM g")
def _autograd(spark, d):
    from ..nn.autograd import column, gradients, param

    df = wide(spark, d).select("label", F.expr(_HALVES[0]).alias("a"), F.expr(_HALVES[1]).alias("b"))
    e = column("label") / 10.0 - (param("w0") * column("a") + param("w1") * column("b") + param("b"))
    loss, g = gradients(e * e, df, {"w0": 0.3, "w1": -0.2, "b": 0.1})
    return spark.createDataFrame([(loss, g["w0"], g["w1"], g["b"])], "loss double, w0 double, w1 double, b double").select(*[rounded(c, 8).alias(c) for c in ("loss", "w0", "w1", "b")])


@register("op_nn_batch_norm", f"WITH t AS {_WIDE} SELECT vec_id, " + ", ".join(f"round((e{k} - avg(e{k}) OVER ()) / sqrt(var_pop(e{k}) OVER () + 1e-5), 6) + 0.0 AS e{k}" for k in range(WIDE)) + " FROM t")
def _batch_norm(spark, d):
    """One training step with a momentum of 1 makes the layer's statistics those of the table; then it scores."""
    from ..nn import layers

    df, layer = _arrays(spark, d), layers.BatchNorm1d(WIDE, momentum=1.0)
    layers.gradient_step(layer, df.withColumn("y", F.col("e")), "e", "y", layers.squared_error)
    out = layers.predict(layer, df, "e")
    return out.select("vec_id", *[rounded(F.col("output")[k]).alias(c) for k, c in enumerate(DIMS)])


@register("op_nn_embedding", "WITH w AS (SELECT CAST(j AS INTEGER) AS label, j * 0.5 AS a, 1 - j * 0.25 AS b FROM range(10) AS t(j)) SELECT vec_id, a::DOUBLE AS a, b::DOUBLE AS b FROM embeddings JOIN w USING (label)")
def _embedding(spark, d):
    from ..nn import layers

    layer = layers.Embedding(10, 2)
    layer.load({"weight": [[0.5 * j, 1 - 0.25 * j] for j in range(10)]})
    out = layers.predict(layer, table(spark, d, "embeddings").select("vec_id", F.array("label").alias("x")), "x")
    return out.select("vec_id", F.col("output")[0].alias("a"), F.col("output")[1].alias("b"))


def _regression_gradients(spark, d):
    """A dense layer with weights of the first column above and a squared error, after one step over the table."""
    from ..nn import layers

    layer = layers.Dense(WIDE, 1)
    layer.load({"weight": [[w[0]] for w in _DENSE], "bias": [1]})
    _, grads = layers.gradient_step(layer, _arrays(spark, d), "e", "label", layers.squared_error)
    return layer, grads


_GRADS = f"WITH t AS {_WIDE}, z AS (SELECT *, 2 * ({_weighted(0)} + 1 - label) AS r FROM t), g AS (" + " UNION ALL ".join([f"SELECT {k} AS k, avg(r * e{k}) AS g FROM z" for k in range(WIDE)] + [f"SELECT {WIDE}, avg(r) FROM z"]) + ")"


@register("op_nn_gradient_norms", f"{_GRADS} SELECT 'weight' AS param, round(sqrt(sum(g * g) FILTER (k < {WIDE})), 6) AS norm FROM g UNION ALL SELECT 'bias', round(abs(max(g) FILTER (k = {WIDE})), 6) FROM g")
def _norms(spark, d):
    layer, _ = _regression_gradients(spark, d)
    return spark.createDataFrame(list(layer.gradient_norms().items()), "param string, norm double").select("param", rounded("norm").alias("norm"))


@register("op_nn_parameter_norms", "SELECT 'weight' AS param, round(sqrt(" + " + ".join(f"{w[0] ** 2}" for w in _DENSE) + "), 6) AS norm UNION ALL SELECT 'bias', 1.0::DOUBLE")
def _parameter_norms(spark, d):
    layer, _ = _regression_gradients(spark, d)
    return spark.createDataFrame(list(layer.parameter_norms().items()), "param string, norm double").select("param", rounded("norm").alias("norm"))


@register("op_nn_clip_grad_norm", f"{_GRADS}, n AS (SELECT sqrt(sum(g * g)) AS n FROM g) SELECT CAST(k AS INTEGER) AS k, round(g * least(1, 0.5 / (n + 1e-6)), 8) + 0.0 AS g, round(n, 6) AS before FROM g, n")
def _clip_norm(spark, d):
    from ..nn import optim

    _, grads = _regression_gradients(spark, d)
    before = optim.clip_grad_norm(grads, 0.5)
    flat = [*grads["weight"].ravel().tolist(), *grads["bias"].ravel().tolist()]
    return spark.createDataFrame([(k, g, before) for k, g in enumerate(flat)], "k int, g double, before double").select("k", rounded("g", 8).alias("g"), rounded("before").alias("before"))


@register("op_nn_clip_grad_value", f"{_GRADS} SELECT CAST(k AS INTEGER) AS k, round(least(greatest(g, -0.05), 0.05), 8) + 0.0 AS g FROM g")
def _clip_value(spark, d):
    from ..nn import optim

    _, grads = _regression_gradients(spark, d)
    optim.clip_grad_value(grads, 0.05)
    flat = [*grads["weight"].ravel().tolist(), *grads["bias"].ravel().tolist()]
    return spark.createDataFrame(list(enumerate(flat)), "k int, g double").select("k", rounded("g", 8).alias("g"))


def _track(make: Callable, steps: int = 20):
    def run(spark, d):
        from ..nn import optim

        params = {"w": 5.0}
        o = make(optim, params)
        rows = []
        for t in range(1, steps + 1):
            o.step({"w": 2 * o.params["w"]})
            rows.append((t, float(o.params["w"])))
        return spark.createDataFrame(rows, "step long, w double").select("step", rounded("w", 9).alias("w"))

    return run


_REC = "WITH RECURSIVE r AS ({0} UNION ALL SELECT {1} FROM r WHERE t < 20) SELECT t AS step, round(w, 9) AS w FROM r WHERE t > 0"
register("op_optim_sgd", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w", "t + 1, w - 0.05 * 2 * w"))(_track(lambda o, p: o.SGD(p, 0.05)))
register("op_optim_sgd_momentum", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w, 0.0::DOUBLE AS v", "t + 1, w - 0.05 * (0.9 * v + 2 * w), 0.9 * v + 2 * w"))(_track(lambda o, p: o.SGD(p, 0.05, momentum=0.9)))
register("op_optim_adam", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v", "t + 1, w - 0.1 * ((0.9 * m + 0.1 * 2 * w) / (1 - pow(0.9, t + 1))) / (sqrt((0.999 * v + 0.001 * 4 * w * w) / (1 - pow(0.999, t + 1))) + 1e-8), 0.9 * m + 0.1 * 2 * w, 0.999 * v + 0.001 * 4 * w * w"))(_track(lambda o, p: o.Adam(p, 0.1)))
register("op_optim_adamw", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v", "t + 1, w * (1 - 0.1 * 0.01) - 0.1 * ((0.9 * m + 0.1 * 2 * w) / (1 - pow(0.9, t + 1))) / (sqrt((0.999 * v + 0.001 * 4 * w * w) / (1 - pow(0.999, t + 1))) + 1e-8), 0.9 * m + 0.1 * 2 * w, 0.999 * v + 0.001 * 4 * w * w"))(_track(lambda o, p: o.AdamW(p, 0.1)))
register("op_optim_rmsprop", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w, 0.0::DOUBLE AS v", "t + 1, w - 0.05 * 2 * w / sqrt(0.99 * v + 0.01 * 4 * w * w + 1e-8), 0.99 * v + 0.01 * 4 * w * w"))(_track(lambda o, p: o.RMSProp(p, 0.05)))
register("op_optim_adagrad", _REC.format("SELECT 0::BIGINT AS t, 5.0::DOUBLE AS w, 0.0::DOUBLE AS v", "t + 1, w - 0.5 * 2 * w / (sqrt(v + 4 * w * w) + 1e-10), v + 4 * w * w"))(_track(lambda o, p: o.Adagrad(p, 0.5)))


def _rates(make: Callable, steps: int = 20):
    def run(spark, d):
        from ..nn import optim

        o = optim.SGD({"w": 0.0}, 1.0)
        s = make(optim, o)
        rows = [(0, o.lr)]
        for t in range(1, steps):
            s.step()
            rows.append((t, o.lr))
        return spark.createDataFrame(rows, "epoch long, lr double").select("epoch", rounded("lr", 9).alias("lr"))

    return run


for _name, _make, _sql in (
    ("step", lambda m, o: m.StepLR(o, 5, 0.5), "pow(0.5, t // 5)"),
    ("multi_step", lambda m, o: m.MultiStepLR(o, [3, 8]), "pow(0.1, (t >= 3)::INT + (t >= 8)::INT)"),
    ("exponential", lambda m, o: m.ExponentialLR(o, 0.9), "pow(0.9, t)"),
    ("cosine", lambda m, o: m.CosineAnnealingLR(o, 10, 0.1), "0.1 + 0.9 * (1 + cos(pi() * t / 10)) / 2"),
    ("warm_restarts", lambda m, o: m.CosineAnnealingWarmRestarts(o, 6), "(1 + cos(pi() * ((t + 1) % 6) / 6)) / 2"),
    ("linear", lambda m, o: m.LinearLR(o, 0.5, 1.0, 8), "0.5 + 0.5 * least(t, 8) / 8"),
    ("warmup", lambda m, o: m.WarmupScheduler(o, 4), "least((t + 1) / 4.0, 1)"),
):
    register(f"op_schedule_{_name}", f"SELECT t AS epoch, round(CAST({_sql} AS DOUBLE), 9) AS lr FROM range(20) AS r(t)")(_rates(_make))


# ---- recurrent layers: a step for each value of an embedding, with fixed weights ----

CELLS = {
    "rnn": ([0.5], [0.3], [0.1]),
    "lstm": ([0.5, -0.3, 0.8, 0.2], [0.1, 0.2, -0.4, 0.3], [0.0, 0.5, 0.0, -0.1]),
    "gru": ([0.5, -0.3, 0.8], [0.1, 0.2, -0.4], [0.0, 0.5, 0.0]),
}


def _recurrent(name: str):
    def run(spark, d):
        import numpy as np
        import pandas as pd

        from ..nn import layers

        net = {"rnn": layers.RNN, "lstm": layers.LSTM, "gru": layers.GRU}[name](1, 1, batch_first=True)
        net.load({f"cell0_0.{k}": np.reshape(v, (1, -1)) if k != "bias" else v for k, v in zip(("w_ih", "w_hh", "bias"), CELLS[name], strict=True)})

        def score(batches):
            for b in batches:
                out = net.forward(np.stack(b["e"].to_numpy()).astype(float)[:, :, None])[0][:, -1, 0] if len(b) else []
                yield pd.DataFrame({"vec_id": b["vec_id"], "h": out})

        return _array(spark, d).mapInPandas(score, "vec_id long, h double").select("vec_id", rounded("h").alias("h"))

    return run


def _gate(name: str, k: int, h: str = "h") -> str:
    w, u, b = CELLS[name]
    return f"({w[k]} * x + {u[k]} * {h} + {b[k]})"


_SEQ = "WITH RECURSIVE e AS (SELECT vec_id, CAST(j AS INTEGER) AS t, embedding[CAST(j AS INTEGER) + 1]::DOUBLE AS x FROM embeddings, range(64) AS q(j)), r AS (SELECT vec_id, -1 AS t, 0.0::DOUBLE AS h, 0.0::DOUBLE AS c FROM embeddings UNION ALL SELECT vec_id, t, {0} FROM (SELECT vec_id, t, h, {1} FROM (SELECT r.vec_id, e.t, r.h, r.c, e.x FROM r JOIN e ON e.vec_id = r.vec_id AND e.t = r.t + 1))) SELECT vec_id, round(h, 6) + 0.0 AS h FROM r WHERE t = 63"
_S = "(1 / (1 + exp(-{0})))".format
register("op_nn_rnn", _SEQ.format("n, c", f"c, tanh({_gate('rnn', 0)}) AS n"))(_recurrent("rnn"))
register("op_nn_lstm", _SEQ.format("o * tanh(n), n", f"{_S(_gate('lstm', 3))} AS o, {_S(_gate('lstm', 1))} * c + {_S(_gate('lstm', 0))} * tanh({_gate('lstm', 2)}) AS n"))(_recurrent("lstm"))
register("op_nn_gru", _SEQ.format("(1 - z) * n + z * h, 0.0", f"{_S(_gate('gru', 1))} AS z, tanh({CELLS['gru'][0][2]} * x + {CELLS['gru'][2][2]} + {_S(_gate('gru', 0))} * ({CELLS['gru'][1][2]} * h)) AS n"))(_recurrent("gru"))


@register("op_nn_dropout", f"SELECT vec_id, {WIDE}::BIGINT AS scaled_or_dropped, true AS about_half FROM embeddings")
def _dropout(spark, d):
    """With probability 0.5 a value is 0, otherwise it is twice itself; about half of all values are dropped."""
    from ..nn import layers

    out = layers.predict(layers.Dropout(0.5, seed=3), _arrays(spark, d), "e", training=True, key="vec_id")
    hit = F.arrays_zip(F.col("e").alias("x"), F.col("output").alias("y"))
    fine = F.size(F.filter(hit, lambda v: (v["y"] == 0) | (v["y"] == 2 * v["x"]))).cast("long")
    rows = out.select("vec_id", fine.alias("scaled_or_dropped"), F.size(F.filter("output", lambda v: v == 0)).alias("gone"))
    share = rows.agg((F.sum("gone") / (F.count("*") * WIDE)).between(0.48, 0.52).alias("about_half"))
    return rows.crossJoin(F.broadcast(share)).select("vec_id", "scaled_or_dropped", "about_half")


@register("op_schedule_plateau", "SELECT t AS epoch, round(CASE WHEN t < 8 THEN 1.0 WHEN t < 11 THEN 0.1 WHEN t < 14 THEN 0.01 WHEN t < 17 THEN 0.001 ELSE CASE WHEN t < 20 THEN 0.0001 END END::DOUBLE, 9) AS lr FROM range(20) AS r(t)")
def _plateau(spark, d):
    """The metric falls until epoch 5 and stays: after more than two bad epochs the rate falls."""
    from ..nn import optim

    o = optim.SGD({"w": 0.0}, 1.0)
    s, rows = optim.ReduceLROnPlateau(o, patience=2), []
    for t in range(20):
        s.step(float(max(10 - t, 5)))
        rows.append((t, o.lr))
    return spark.createDataFrame(rows, "epoch long, lr double").select("epoch", rounded("lr", 9).alias("lr"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
