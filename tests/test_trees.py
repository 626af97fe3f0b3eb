"""Trees, forests' parts and boosting against plain recursion; parts of ranges; exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, prep, quantiles, tree


def impurity(y, how):
    if how in ("gini", "entropy"):
        p = np.unique(y, return_counts=True)[1] / len(y)
        return 1 - (p * p).sum() if how == "gini" else -(p * np.log2(p + 1e-10)).sum()
    return y.var() if how == "mse" else np.abs(y - np.median(y)).mean()


def grown(x, y, how, depth, leaf=1):
    """A nested tuple (feature, threshold, left, right), or a leaf's rows."""
    best = None
    if depth and len(y) >= 2:
        for f in range(x.shape[1]):
            v = np.unique(x[:, f])
            for t in (v[1:] + v[:-1]) / 2:
                m = x[:, f] <= t
                if min(m.sum(), (~m).sum()) >= leaf:
                    gain = impurity(y, how) - m.mean() * impurity(y[m], how) - (~m).mean() * impurity(y[~m], how)
                    key = (-round(gain, 12), f, t)
                    if gain > 1e-12 and (best is None or key < best[0]):
                        best = (key, m)
    if best is None:
        return y
    (_, f, t), m = best
    return f, t, grown(x[m], y[m], how, depth - 1, leaf), grown(x[~m], y[~m], how, depth - 1, leaf)


def predicted(node, row, how):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    if how in ("gini", "entropy"):
        v, n = np.unique(node, return_counts=True)
        return v[n.argmax()]
    return node.mean() if how == "mse" else np.median(node)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.2).astype(int) + (x[:, 2] > 0.9)
    rows = [(i, *map(float, r), int(c), float(c + r[0])) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y int, z double"), np.array([r[-1] for r in rows])


@pytest.mark.parametrize("how", ["gini", "entropy", "mse", "mae"])
@pytest.mark.parametrize("cells", [250_000, 40])
def test_trees_against_recursion(small, monkeypatch, how, cells):
    monkeypatch.setattr(ordered, "ROWS", cells)
    x, y, df, z = small
    kind, label, truth = (tree.DecisionTreeClassifier, "y", y) if how in ("gini", "entropy") else (tree.DecisionTreeRegressor, "z", z)
    got = kind(["a", "b", "c"], label, criterion=how, max_depth=4, min_samples_leaf=2).fit(df).transform(df).orderBy("id").collect()
    want = grown(x, truth, how, 4, 2)
    assert [r["prediction"] for r in got] == pytest.approx([predicted(want, r, how) for r in x], abs=1e-9)


def test_boosting_against_recursion(small):
    x, _, df, z = small
    m = tree.GradientBoostingRegressor(["a", "b", "c"], "z", "id", n_estimators=3, learning_rate=0.5, max_depth=2).fit(df)
    f = np.full(len(z), z.mean())
    for _ in range(3):
        t = grown(x, z - f, "mse", 2)
        f = f + 0.5 * np.array([predicted(t, r, "mse") for r in x])
    assert [r["prediction"] for r in m.transform(df).orderBy("id").collect()] == pytest.approx(f.tolist(), abs=1e-9)


def test_logistic_boosting_against_recursion(small):
    x, y, df, _ = small
    m = tree.GradientBoostingClassifier(["a", "b", "c"], "w", "id", n_estimators=2, learning_rate=0.5, max_depth=2).fit(df.withColumn("w", (F.col("y") > 0).cast("int")))
    w = (y > 0).astype(float)
    f = np.full(len(w), np.log(w.mean() / (1 - w.mean())))
    for _ in range(2):
        t = grown(x, w - 1 / (1 + np.exp(-f)), "mse", 2)
        f = f + 0.5 * np.array([predicted(t, r, "mse") for r in x])
    got = m.transform(df).orderBy("id").collect()
    assert [r["probability"][1] for r in got] == pytest.approx((1 / (1 + np.exp(-f))).tolist(), abs=1e-9)


def test_forest_is_the_mean_of_its_trees(small):
    """Without bootstrap and with all features, every tree is the same; with bootstrap, rows weigh as often as they are drawn."""
    x, y, df, _ = small
    m = tree.RandomForestClassifier(["a", "b", "c"], "y", max_depth=3, n_estimators=3, bootstrap=False, max_features=None, id_col="id").fit(df)
    want = grown(x, y, "gini", 3)
    assert [r["prediction"] for r in m.transform(df).orderBy("id").collect()] == [predicted(want, r, "gini") for r in x]
    b = tree.RandomForestClassifier(["a", "b", "c"], "y", max_depth=3, n_estimators=2, max_features=None, id_col="id")
    b.fit(df)
    drawn = df.withColumn("tree", F.lit(1)).withColumn("w", b._weights(df)).orderBy("id").collect()
    k = np.repeat(np.arange(len(y)), [int(r["w"]) for r in drawn])
    want = grown(x[k], y[k], "gini", 3)
    one = tree.RandomForestClassifier(["a", "b", "c"], "y", trees_={0: b.trees_[1]})
    one.classes_ = b.classes_
    assert [r["prediction"] for r in one.transform(df).orderBy("id").collect()] == [predicted(want, r, "gini") for r in x]
    assert 0.5 < b.oob_score(df) <= 1


def test_exact_quantiles_and_modes(spark):
    rng = np.random.default_rng(8)
    a, b = np.exp(rng.normal(size=3000) * 4), rng.integers(0, 5, 3000).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b, strict=True)] + [(None, float("nan"), None)], "a double, b double, c double").repartition(5)
    q = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.quantiles(df, [prep.real(c) for c in "abc"], q)
    assert np.allclose(got[0], np.quantile(a, q), rtol=1e-12) and got[1] == np.quantile(b, q).tolist() and got[2] == [None] * 5
    v, n = np.unique(b, return_counts=True)
    assert quantiles.modes(df, [prep.real(c) for c in "abc"])[1:] == [v[n.argmax()], None]


def test_one_tied_score_in_many_parts(spark, monkeypatch):
    """Sums in order are right where all keys are equal, and no part holds much more than ROWS rows."""
    monkeypatch.setattr(ordered, "ROWS", 100)
    df = spark.range(2000).select("id", F.lit(0.5).alias("s"))
    out = ordered.running(df, [F.col("s").desc(), F.col("id")], {"n": F.lit(1), "t": F.col("id")}).orderBy("id").collect()
    assert [(r["n"], r["t"]) for r in out] == [(i + 1, i * (i + 1) // 2) for i in range(2000)]
    parts = ordered._ranged(df, [F.col("s"), F.col("id")]).groupBy("_part").count().collect()
    assert len(parts) >= 15 and max(r["count"] for r in parts) < 400


@pytest.mark.parametrize("seed", [None, 3])
def test_positions_within_classes(spark, monkeypatch, seed):
    monkeypatch.setattr(ordered, "ROWS", 50)
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), F.when(F.col("id") % 10 < 9, "hot").otherwise(None).alias("y"), F.lit("x").alias("n"))
    got = ordered.position(df, "id", seed, within="y").collect()
    by = {y: sorted(((r["_pos"], r["id"]) for r in got if r["y"] == y)) for y in ("hot", None)}
    assert [p for p, _ in by["hot"]] == list(range(900)) and [p for p, _ in by[None]] == list(range(100)) and {r["_n"] for r in got if r["y"]} == {900}
    assert (sorted(i for _, i in by["hot"]) == [i for _, i in by["hot"]]) == (seed is None)
    again = ordered.position(df.repartition(7), "id", seed, within="y").collect()
    assert {(r["id"], r["_pos"]) for r in got} == {(r["id"], r["_pos"]) for r in again}
