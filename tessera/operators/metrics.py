"""Metrics. Those of one pass are aggregate Columns of two column names; the others take a DataFrame and give one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elementwise import num
from .ordered import running

TINY = 1e-10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def accuracy_score(y, p, normalize: bool = True) -> Column:
    hit = F.when(_c(y) == _c(p), 1.0).otherwise(0.0)
    return F.avg(hit) if normalize else F.sum(hit)


def mean_squared_error(y, p, squared: bool = True) -> Column:
    e = num(_c(y)) - num(_c(p))
    mse = F.avg(e * e)
    return mse if squared else F.sqrt(mse)


def mean_absolute_error(y, p) -> Column:
    return F.avg(F.abs(num(_c(y)) - num(_c(p))))


def r2_score(y, p) -> Column:
    e = num(_c(y)) - num(_c(p))
    return 1 - F.sum(e * e) / (F.var_pop(num(_c(y))) * F.count(_c(y)) + TINY)


def mean_absolute_percentage_error(y, p) -> Column:
    """In percent, of rows whose truth is not 0."""
    t = num(_c(y))
    return 100 * F.avg(F.when(t != 0, F.abs(F.try_divide(t - num(_c(p)), t))))


def explained_variance_score(y, p) -> Column:
    return 1 - F.var_pop(num(_c(y)) - num(_c(p))) / (F.var_pop(num(_c(y))) + TINY)


def max_error(y, p) -> Column:
    return F.max(F.abs(num(_c(y)) - num(_c(p))))


def median_absolute_error(y, p) -> Column:
    return F.median(F.abs(num(_c(y)) - num(_c(p))))


def mean_squared_log_error(y, p) -> Column:
    """An error for values below 0."""
    low = F.least(num(_c(y)), num(_c(p)))
    e = F.log1p(num(_c(y))) - F.log1p(num(_c(p)))
    return F.avg(F.when(low < 0, F.raise_error(F.lit("mean_squared_log_error needs values of 0 or more")).cast("double")).otherwise(e * e))


def huber_loss(y, p, delta: float = 1.0) -> Column:
    e = F.abs(num(_c(y)) - num(_c(p)))
    return F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta)))


def log_loss(y, proba, eps: float = 1e-7) -> Column:
    """y: class index; proba: array of class probabilities."""
    p = F.get(_c(proba), _c(y).cast("int"))
    return F.avg(-F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))))


def confusion_matrix(df: DataFrame, y: str, p: str, labels: list | None = None) -> DataFrame:
    """y_true, y_pred, n for all pairs of labels (those that occur, sorted, or those given), zeros included."""
    seen = df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count("*").alias("n"))
    if labels is None:
        names = seen.select(F.col("y_true").alias("l")).union(seen.select("y_pred")).distinct()
    else:
        names = df.sparkSession.createDataFrame([(x,) for x in labels], ["l"])
    # Classes are few: the square of their number is the size of the result.
    grid = names.select(F.col("l").alias("y_true")).crossJoin(F.broadcast(names.select(F.col("l").alias("y_pred"))))
    return grid.join(seen, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str, p: str, zero_division: float = 0.0) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1."""
    hit = (F.col(y) == F.col(p)).cast("long")
    one = df.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("support"), F.sum(hit).alias("tp"))
    two = df.groupBy(F.col(p).alias("label")).agg(F.count("*").alias("predicted"))
    c = one.join(two, "label", "full").select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "tp", "predicted")])
    c = c.select("label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), "support")
    return c.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn"), zero_division))


def _rates(tp: Column, fp: Column, fn: Column, zero: float) -> list[Column]:
    part = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(float(zero)))
    pr, re = part(tp, tp + fp), part(tp, tp + fn)
    return [pr.alias("precision"), re.alias("recall"), part(2 * pr * re, pr + re).alias("f1")]


def precision_recall_fscore(df: DataFrame, y: str, p: str, average: str | None = "binary", zero_division: float = 0.0) -> DataFrame:
    """precision, recall, f1 (one row; one for each label with average=None). 'binary' is the last label in order."""
    c = per_class(df, y, p, zero_division)
    if average is None:
        return c.select("label", "precision", "recall", "f1")
    if average == "micro":
        t = c.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        return t.select(*_rates(F.col("tp"), F.col("fp"), F.col("fn"), zero_division))
    names = ("precision", "recall", "f1")
    if average == "binary":
        return c.agg(*[F.max_by(n, "label").alias(n) for n in names])
    if average == "macro":
        return c.agg(*[F.avg(n).alias(n) for n in names])
    return c.agg(*[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names])


def precision_score(df, y, p, average="binary", zero_division=0.0) -> DataFrame:
    return precision_recall_fscore(df, y, p, average, zero_division).select("precision")


def recall_score(df, y, p, average="binary", zero_division=0.0) -> DataFrame:
    return precision_recall_fscore(df, y, p, average, zero_division).select("recall")


def f1_score(df, y, p, average="binary", zero_division=0.0) -> DataFrame:
    return precision_recall_fscore(df, y, p, average, zero_division).select("f1")


def balanced_accuracy_score(df: DataFrame, y: str, p: str) -> DataFrame:
    return precision_recall_fscore(df, y, p, "macro").select(F.col("recall").alias("balanced_accuracy"))


def classification_report(df: DataFrame, y: str, p: str, target_names: list[str] | None = None, zero_division: float = 0.0) -> str:
    """The table of per-class and averaged scores as text."""
    rows = per_class(df, y, p, zero_division).orderBy("label").collect()  # one row a class
    names = target_names or [str(r["label"]) for r in rows]
    n = sum(r["support"] for r in rows)
    width = max(12, *map(len, names)) if names else 12
    line = lambda name, a, b, c, k: f"{name:>{width}}  {a:>9}  {b:>9}  {c:>9}  {k:>9}"
    f = lambda v: f"{v:.4f}"
    out = [line("", "precision", "recall", "f1-score", "support"), ""]
    out += [line(name, f(r["precision"]), f(r["recall"]), f(r["f1"]), r["support"]) for name, r in zip(names, rows, strict=True)]
    mean = lambda k, weigh: sum(r[k] * (r["support"] / n if weigh else 1 / len(rows)) for r in rows)
    out += ["", line("accuracy", "", "", f(sum(r["tp"] for r in rows) / n), n)]
    out += [line(name, *[f(mean(k, w)) for k in ("precision", "recall", "f1")], n) for name, w in (("macro avg", False), ("weighted avg", True))]
    return "\n".join(out)


def roc_curve(df: DataFrame, y: str, score: str, id_col: str) -> DataFrame:
    """rank, fpr, tpr, threshold: one point a row by falling score (ties by id), after (0, 0) at the greatest score plus 1."""
    pos = F.col(y).cast("double")
    run = running(df.select(F.col(y), F.col(score), F.col(id_col)), [F.col(score).desc(), F.col(id_col)], {"tp": pos, "rank": F.lit(1)})
    total = df.agg(F.sum(pos).alias("p"), F.count("*").alias("n"), F.max(score).alias("top"))
    total = total.withColumn("p", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("p")).otherwise(F.raise_error(F.lit("roc_curve needs both classes")).cast("double")))
    points = run.crossJoin(F.broadcast(total)).select(F.col("rank").cast("long"), ((F.col("rank") - F.col("tp")) / (F.col("n") - F.col("p"))).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"), F.col(score).cast("double").alias("threshold"))
    first = total.select(F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), (F.col("top") + 1).cast("double").alias("threshold"))
    return first.where("p > 0").unionByName(points)


def roc_auc_score(df: DataFrame, y: str, score: str, id_col: str) -> DataFrame:
    """The trapezoids under the curve. A step is either up or right, so their sum is that of the heights where it goes right."""
    pos = F.col(y).cast("double")
    run = running(df.select(F.col(y), F.col(score), F.col(id_col)), [F.col(score).desc(), F.col(id_col)], {"tp": pos})
    return run.agg((F.sum((1 - pos) * F.col("tp")) / (F.sum(pos) * F.sum(1 - pos))).alias("auc"))


def average_precision_score(df: DataFrame, y: str, score: str, id_col: str) -> DataFrame:
    """Trapezoids of precision over recall, beginning at (0, 1): a step counts where recall grows, which is at positives."""
    pos = F.col(y).cast("double")
    run = running(df.select(F.col(y), F.col(score), F.col(id_col)), [F.col(score).desc(), F.col(id_col)], {"tp": pos, "rank": F.lit(1)})
    before = F.when(F.col("rank") > 1, F.try_divide(F.col("tp") - pos, F.col("rank") - 1)).otherwise(1.0)
    step = pos * (F.col("tp") / F.col("rank") + before) / 2
    return run.agg((F.sum(step) / F.sum(pos)).alias("average_precision"))


def cohen_kappa_score(df: DataFrame, y: str, p: str) -> DataFrame:
    c = per_class(df, y, p)
    n = F.sum("support")
    t = c.agg((F.sum("tp") / n).alias("po"), (F.sum(F.col("support") * (F.col("tp") + F.col("fp"))) / (n * n)).alias("pe"))
    return t.select(((F.col("po") - F.col("pe")) / (1 - F.col("pe") + TINY)).alias("kappa"))


def _pairs(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n"))
    return cells, side("a"), side("b")


def adjusted_rand_score(df: DataFrame, a: str, b: str) -> DataFrame:
    two = lambda t: t.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("s"), F.sum("n").alias("t"))
    c, x, y = (two(t) for t in _pairs(df, a, b))
    j = c.crossJoin(x.select(F.col("s").alias("sa"))).crossJoin(y.select(F.col("s").alias("sb")))  # one row each
    expect = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), F.col("t") * (F.col("t") - 1) / 2), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / 2
    flat = F.when(F.col("s") == expect, 1.0).otherwise(0.0)
    return j.select(F.when(most == expect, flat).otherwise(F.try_divide(F.col("s") - expect, most - expect)).alias("ari"))


def normalized_mutual_info_score(df: DataFrame, a: str, b: str) -> DataFrame:
    cells, x, y = _pairs(df, a, b)
    total = cells.agg(F.sum("n").alias("t"))
    j = cells.join(x.withColumnRenamed("n", "na"), "a").join(y.withColumnRenamed("n", "nb"), "b").crossJoin(F.broadcast(total))
    mi = j.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    h = lambda t, k: t.crossJoin(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias(k))
    both = mi.crossJoin(h(x, "ha")).crossJoin(h(y, "hb"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return both.select(F.when(mean == 0, 1.0).otherwise(F.try_divide(F.col("mi"), mean)).alias("nmi"))


def _centroids(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in cols])


def _distance(cols: list[str], a: str, b: str, metric: str = "euclidean") -> Column:
    parts = [num(F.col(f"{a}{c}")) - num(F.col(f"{b}{c}")) for c in cols]
    if metric == "euclidean":
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    return sum((F.abs(p) for p in parts), F.lit(0.0))


def davies_bouldin_score(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Without noise (label -1). Clusters are few; their centroids are broadcast."""
    df = df.where(F.col(label) != -1)
    m = _centroids(df, cols, label)
    s = df.join(F.broadcast(m), label).groupBy(label, *[f"_m_{c}" for c in cols]).agg(F.avg(_distance(cols, "", "_m_")).alias("_s"))
    a, b = s.select(*[F.col(c).alias(f"a{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b{c}") for c in s.columns])
    r = (F.col("a_s") + F.col("b_s")) / F.nullif(_distance([f"_m_{c}" for c in cols], "a", "b"), F.lit(0.0))
    worst = a.crossJoin(F.broadcast(b)).where(F.col(f"a{label}") != F.col(f"b{label}")).groupBy(f"a{label}").agg(F.coalesce(F.max(r), F.lit(0.0)).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def calinski_harabasz_score(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Noise counts as a cluster. 0 for one cluster or no spread within clusters."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols], *[F.var_pop(F.col(c).cast("double")).alias(f"v_{c}") for c in cols])
    total = df.agg(F.count("*").alias("t"), *[F.avg(F.col(c).cast("double")).alias(f"g_{c}") for c in cols])
    wss = sum((F.col("n") * F.col(f"v_{c}") for c in cols), F.lit(0.0))
    bss = sum((F.col("n") * (F.col(f"m_{c}") - F.col(f"g_{c}")) * (F.col(f"m_{c}") - F.col(f"g_{c}")) for c in cols), F.lit(0.0))
    s = per.crossJoin(F.broadcast(total)).agg(F.sum(wss).alias("w"), F.sum(bss).alias("b"), F.count("*").alias("k"), F.max("t").alias("t"))
    score = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("t") - F.col("k")))
    return s.select(F.when((F.col("k") > 1) & (F.col("w") > 0), score).otherwise(0.0).alias("calinski_harabasz"))


def silhouette_samples(df: DataFrame, cols: list[str], label: str, id_col: str, metric: str = "euclidean") -> DataFrame:
    """id, silhouette of rows that are not noise. Exact, so every row meets every row: one side goes round in blocks of columns
    that Spark deals out, and is summed by cluster at once."""
    rows = df.where(F.col(label) != -1).select(F.col(id_col).alias("id"), F.col(label).alias("l"), *cols)
    other = rows.select(F.col("id").alias("oid"), F.col("l").alias("ol"), *[F.col(c).alias(f"o{c}") for c in cols])
    d = rows.crossJoin(other).where("id <> oid").groupBy("id", "l", "ol").agg(F.avg(_distance(cols, "", "o", metric)).alias("d"))
    s = d.groupBy("id", "l").agg(F.max(F.when(F.col("l") == F.col("ol"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("ol"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.select("id", value.alias("silhouette"))


def silhouette_score(df: DataFrame, cols: list[str], label: str, id_col: str, metric: str = "euclidean") -> DataFrame:
    if df.where(F.col(label) != -1).select(label).distinct().limit(2).count() < 2:
        raise ValueError("silhouette needs two clusters")
    return silhouette_samples(df, cols, label, id_col, metric).agg(F.avg("silhouette").alias("silhouette"))
