"""Estimators: quality floors, invariants and closed forms on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import bayes, cluster, decomposition, linear, metrics, neighbors, prep, resample, svm, tree


def frame(spark, x, y=None):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), *([] if y is None else [y[i].item() if hasattr(y[i], "item") else y[i]])) for i, r in enumerate(x)]
    return names, spark.createDataFrame(rows, ["row_id", *names, *([] if y is None else ["y"])])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 0.8, (100, 2)), rng.normal(4, 0.8, (100, 2))))
    return frame(spark, x, np.repeat([0, 1], 100))


@pytest.mark.parametrize("make", [
    lambda c: linear.LogisticRegression(c, "y"), lambda c: linear.LogisticRegression(c, "y", solver="gd", lr=1.0, max_iter=60), lambda c: bayes.GaussianNB(c, "y"),
    lambda c: tree.DecisionTreeClassifier(c, "y", max_depth=4), lambda c: tree.DecisionTreeClassifier(c, "y", criterion="entropy", max_depth=2),
    lambda c: neighbors.KNNClassifier(c, "y", "row_id"), lambda c: tree.RandomForestClassifier(c, "y", max_depth=3, n_estimators=5, id_col="row_id"),
    lambda c: svm.SVC(c, "y", kernel="linear"), lambda c: svm.SVC(c, "y"), lambda c: tree.GradientBoostingClassifier(c, "y", "row_id", n_estimators=3, max_depth=2, learning_rate=0.5),
])
def test_classifiers(blobs, make):
    cols, df = blobs
    got = make(cols).fit(df).transform(df).agg(metrics.accuracy_score("y", "prediction").alias("a")).first()["a"]
    assert got > 0.95


def test_several_classes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.5, (40, 2)) for m in ((0, 0), (5, 5), (-5, 5))])
    cols, df = frame(spark, x, np.repeat([0, 1, 2], 40))
    for m in (linear.LogisticRegression(cols, "y"), linear.LogisticRegression(cols, "y", multi_class="ovr"), svm.SVC(cols, "y", kernel="linear")):
        assert m.fit(df).transform(df).agg(metrics.accuracy_score("y", "prediction").alias("a")).first()["a"] > 0.95
    k = cluster.KMeans(cols, "row_id", 3, n_init=2, max_iter=20).fit(df)
    assert all(min(math.dist(c, m) for c in k.cluster_centers_) < 2 for m in ((0, 0), (5, 5), (-5, 5)))
    db = cluster.DBSCAN(cols, "row_id", 1.5, 4).fit_predict(df)
    assert db.agg(F.countDistinct("label")).first()[0] >= 3


def test_linear_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 3))
    w = np.array([1.5, -2.0, 0.5])
    cols, df = frame(spark, x, x @ w + 3)
    m = linear.LinearRegression(cols, "y").fit(df)
    assert np.allclose(m.coef_, w) and abs(m.intercept_ - 3) < 1e-8 and m.score(df) > 0.999
    r = linear.Ridge(cols, "y", alpha=2.0).fit(df)
    xc, y = x - x.mean(0), x @ w + 3
    assert np.allclose(r.coef_, np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ (y - y.mean())))
    wide = rng.normal(size=(50, 10))
    cols, df = frame(spark, wide, wide[:, 0] * 3)
    assert (np.abs(linear.Lasso(cols, "y", alpha=0.5).fit(df).coef_) < 1e-6).sum() > 5
    scores = resample.cross_val_score(lambda: linear.LinearRegression(cols, "y"), df, "row_id", "y", 3, "r2")
    assert len(scores) == 3 and min(scores) > 0.99


def test_regressors(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(120, 1))
    cols, df = frame(spark, x, np.sin(6 * x[:, 0]))
    for m in (tree.DecisionTreeRegressor(cols, "y", max_depth=6), tree.RandomForestRegressor(cols, "y", n_estimators=5, max_depth=5, id_col="row_id"), svm.SVR(cols, "y", C=10.0, epsilon=0.05), tree.GradientBoostingRegressor(cols, "y", "row_id", n_estimators=6, learning_rate=0.5), neighbors.KNNRegressor(cols, "y", "row_id", n_neighbors=3)):
        assert m.fit(df).transform(df).agg(metrics.r2_score("y", "prediction").alias("s")).first()["s"] > 0.8, m


def test_tree_does_not_depend_on_partitions(blobs):
    cols, df = blobs
    trees = [tree.DecisionTreeClassifier(cols, "y", max_depth=3).fit(df.repartition(n)) for n in (1, 7)]
    assert [(n.feature, n.threshold) for n in trees[0].trees_[0].walk()] == [(n.feature, n.threshold) for n in trees[1].trees_[0].walk()]
    assert abs(sum(trees[0].feature_importances_) - 1) < 1e-6


def test_decomposition(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 5)) @ rng.normal(size=(5, 5))
    cols, df = frame(spark, x)
    m = decomposition.PCA(cols).fit(df)
    assert np.allclose(m.explained_variance_, np.linalg.svd(x - x.mean(0))[1] ** 2 / 99)
    back = m.inverse_transform(m.transform(df)).orderBy("row_id").select(*cols).toPandas().to_numpy()
    assert np.allclose(back, x)
    inc = decomposition.IncrementalPCA(cols)
    for k in range(4):
        inc.partial_fit(df.where(F.col("row_id") % 4 == k))
    assert np.allclose(inc.explained_variance_, m.explained_variance_) and np.allclose(inc.components_, m.components_)
    s = decomposition.TruncatedSVD(cols, 2).fit(df)
    assert np.allclose(s.singular_values_, np.linalg.svd(x)[1][:2])
    assert decomposition.PCA(cols, 0.9).fit(df).n_components_ <= 5 and np.isfinite(decomposition.PCA(cols, 2).fit(df).score(df))


def test_transforms(spark):
    df = spark.createDataFrame([(0, 1.0, "b", None), (1, 3.0, "a", 2.0), (2, 5.0, "b", float("nan")), (3, 3.0, "c", 4.0)], "row_id int, x double, s string, h double")
    assert [r[0] for r in prep.StandardScaler(["x"]).fit(df).transform(df).orderBy("row_id").select("x").collect()] == pytest.approx([-math.sqrt(2), 0, math.sqrt(2), 0])
    flat = df.withColumn("x", F.lit(2.0))
    assert {r[0] for r in prep.MinMaxScaler(["x"]).fit_transform(flat).select("x").collect()} == {0.0}
    assert [r[0] for r in prep.SimpleImputer(["h"]).fit_transform(df).orderBy("row_id").select("h").collect()] == [3.0, 2.0, 3.0, 4.0]
    e = prep.OneHotEncoder(["s"], drop="first").fit(df)
    assert e.inverse_transform(e.transform(df)).orderBy("row_id").select("s").toPandas()["s"].tolist() == ["b", "a", "b", "c"]
    label = prep.LabelEncoder("s").fit(df)
    assert label.transform(df).orderBy("row_id").select("label").toPandas()["label"].tolist() == [1, 0, 1, 2]
    with pytest.raises(Exception, match="unknown category"):
        label.transform(df.withColumn("s", F.lit("zz"))).collect()
    with pytest.raises(NotImplementedError):
        prep.Normalizer(["x"]).inverse_transform(df)
    empty = df.limit(0)
    assert prep.StandardScaler(["x"]).fit(empty).transform(empty).count() == 0
    p = prep.PowerTransformer(["x"], method="box-cox").fit(df)
    assert abs(p.transform(df).agg(F.avg("x")).first()[0]) < 1e-9


def test_splits(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    for shuffle in (False, True):
        sizes = [r["count"] for r in resample.kfold(df, "row_id", 4, shuffle).groupBy("fold").count().orderBy("fold").collect()]
        assert sizes == [13, 13, 12, 12]
    assert resample.train_test_split(df, "row_id").where("is_test").count() == 10
    y = spark.range(40).selectExpr("id AS row_id", "int(id >= 20) AS y")
    got = resample.train_test_split(y, "row_id", stratify="y").where("is_test").groupBy("y").count().collect()
    assert {r["count"] for r in got} == {4}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.4), (2, 1, 0.35), (3, 1, 0.8)], "id int, y int, s double")
    assert metrics.roc_auc_score(df, "y", "s", "id").first()[0] == pytest.approx(0.75)
    assert metrics.roc_curve(df, "y", "s", "id").count() == 5
    with pytest.raises(Exception, match="both classes"):
        metrics.roc_curve(df.where("y = 1"), "y", "s", "id").collect()
    c = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (0, 1), (1, 0), (0, 0), (0, 0), (0, 0)], "y int, p int")
    r = metrics.precision_recall_fscore(c, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.75, 0.75, 0.75)
    assert "accuracy" in metrics.classification_report(c, "y", "p")


@pytest.mark.parametrize("epsilon", [0.0, 0.1])
def test_kernel_machine_optimum_of_many_working_sets(monkeypatch, epsilon):
    """Labels without a pattern, so that nearly all rows are support vectors and need more than 10,000 steps; no row may violate
    the conditions of the optimum by more than tol."""
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(9000, 20)), 9000
    target = rng.choice([-1.0, 1.0], n) if not epsilon else rng.integers(0, 10, n).astype(float)
    low, high = (np.minimum(target, 0), np.maximum(target, 0)) if not epsilon else (np.full(n, -1.0), np.full(n, 1.0))
    m = svm.SVR([f"x{k}" for k in range(20)], "y")
    m.gamma_ = 0.05
    monkeypatch.setattr(svm, "WORKING", 1000)
    w, b = m._solve(x, target, low, high, epsilon)
    assert abs(w.sum()) < 1e-6 and (w >= low - 1e-9).all() and (w <= high + 1e-9).all() and (abs(w) > 1e-8).sum() > 8000
    e = target - m._gram(x, x) @ w - b
    up, down = svm._slopes(e, w, low, high, epsilon)
    assert up.max() < 2e-3 and down.min() > -2e-3 and up.max() - down.min() < 1.01e-3


def test_kernel_products_on_executors_are_those_of_the_driver(spark, monkeypatch):
    """Blocks are the same, however many tasks there are; so are weights and bias."""
    rng = np.random.default_rng(2)
    x, y, most = rng.normal(size=(700, 5)), rng.integers(0, 10, 700).astype(float), np.ones(700)
    m = svm.SVR([], "y")
    m.gamma_ = 0.1
    want = m._solve(x, y, -most, most, 0.1)
    monkeypatch.setattr(svm, "ALONE", 100)
    got = m._solve(x, y, -most, most, 0.1, spark)
    assert got[1] == pytest.approx(want[1], abs=1e-3) and np.allclose(got[0], want[0], atol=0.02)


@pytest.mark.parametrize("make", [svm.SVR, svm.SVC])
def test_copies_of_a_row_are_one_vector(spark, make):
    """Copies weigh as one row with a bound as many times as large: the same machine, without more vectors."""
    rng = np.random.default_rng(3)
    one = pd.DataFrame(rng.normal(size=(60, 2)), columns=["a", "b"]).assign(y=rng.integers(0, 2, 60))
    many, single = make(["a", "b"], "y", tol=1e-6).fit(spark.createDataFrame(pd.concat([one] * 3))), make(["a", "b"], "y", C=3.0, tol=1e-6).fit(spark.createDataFrame(one))
    machine = (lambda m: m.machine_) if make is svm.SVR else (lambda m: m.machines_[0][2:])
    assert len(machine(many)[0]) <= 60
    at = rng.normal(size=(20, 2))
    value = lambda m: m._product(at, machine(m)[1], machine(m)[0]) + machine(m)[2]
    assert np.allclose(value(many), value(single), atol=1e-4)


def _many(spark):
    """20,500 rows in two clouds apart."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_500, 2)) * 0.3
    x[::2] += 2
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (np.arange(20_500) % 2).astype(float)}))


def test_support_vector_classifier_takes_many_rows(spark):
    df = _many(spark)
    got = svm.SVC(["a", "b"], "y").fit(df).transform(df).toPandas()
    assert len(got) == 20_500 and (got["prediction"] == got["y"]).mean() > 0.99
    with pytest.raises(ValueError):
        svm.SVC(["a", "b"], "y", max_rows=20_000).fit(df)


def test_support_vector_regression_takes_many_rows(spark):
    df = _many(spark)
    got = svm.SVR(["a", "b"], "y").fit(df).transform(df).toPandas()
    assert len(got) == 20_500 and (got["prediction"] - got["y"]).abs().mean() < 0.12
