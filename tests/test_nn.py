"""Expressions, layers, optimizers, schedules, storage and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.nn import autograd, init, layers, optim
from tessera.sources import datasets, io


def slope(f, x, eps=1e-6):
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        a, b = x.copy(), x.copy()
        a[i] += eps
        b[i] -= eps
        g[i] = (f(a) - f(b)) / (2 * eps)
    return g


LAYERS = [
    (lambda: layers.Dense(3, 2), (4, 3)), (lambda: layers.Conv2d(2, 3, 3, 2, 1), (2, 2, 5, 5)), (lambda: layers.MaxPool2d(2), (2, 2, 4, 4)), (lambda: layers.BatchNorm1d(3), (6, 3)),
    (lambda: layers.BatchNorm2d(2), (3, 2, 3, 3)), (lambda: layers.Softmax(), (3, 4)), (lambda: layers.LogSoftmax(), (3, 4)), (lambda: layers.Flatten(), (2, 2, 3)),
    *[((lambda n=n: layers.Activation(n)), (4, 3)) for n in layers.ACTIVATIONS],
]


@pytest.mark.parametrize("make,shape", LAYERS)
def test_layer_gradients(make, shape):
    rng = np.random.default_rng(0)
    x, layer = rng.normal(size=shape), make()
    w = rng.normal(size=layer.forward(x).shape)
    layer.forward(x)
    g = layer.backward(w)
    assert np.allclose(g, slope(lambda v: (layer.forward(v) * w).sum(), x), atol=1e-5)
    for name in layer.params:
        layer.forward(x)
        layer.backward(w)
        own = layer.grads[name].copy()

        def at(v, name=name):
            kept, layer.params[name] = layer.params[name], v
            out = (layer.forward(x) * w).sum()
            layer.params[name] = kept
            return out

        assert np.allclose(own, slope(at, layer.params[name].copy()), atol=1e-5)


@pytest.mark.parametrize("cls", [layers.RNN, layers.LSTM, layers.GRU])
@pytest.mark.parametrize("both", [False, True])
def test_recurrent_gradients(cls, both):
    rng = np.random.default_rng(1)
    net, x = cls(3, 4, num_layers=2, bidirectional=both), rng.normal(size=(5, 2, 3))
    out, last = net.forward(x)
    assert out.shape == (5, 2, 8 if both else 4) and len(last) == (4 if both else 2)
    w = rng.normal(size=out.shape)
    g = net.backward(w)
    assert np.allclose(g, slope(lambda v: (net.forward(v)[0] * w).sum(), x), atol=1e-5)


def test_xor(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0.0), ([0.0, 1.0], 1.0), ([1.0, 0.0], 1.0), ([1.0, 1.0], 0.0)], "x array<double>, y double").coalesce(1)
    net = layers.Sequential([layers.Dense(2, 16, seed=1), layers.Activation("Tanh"), layers.Dense(16, 1, seed=2)])
    losses = layers.fit(net, df, "x", "y", layers.logits_cross_entropy, optim.Adam(net.named(), 0.2), 40)
    assert losses[-1] < 0.05
    got = layers.predict(net, df, "x").collect()
    assert all((r["output"][0] > 0) == (r["y"] == 1) for r in got)


def test_expression_gradients(spark):
    df = spark.createDataFrame([(0.3, 1.0), (-0.7, 2.0)], "x double, y double")
    w, b, x = autograd.param("w"), autograd.param("b"), autograd.column("x")

    def loss(v):
        h = (w * x + b).tanh() * 1.5 + (w * x).sigmoid() ** 2 - (b / (x * x + 1.0)).gelu()
        return autograd.gradients((h - autograd.column("y")) ** 2 + (w * b).detach(), df, v)

    at = {"w": 0.4, "b": -0.2}
    _, g = loss(at)
    for k in at:
        up, down = ({**at, k: at[k] + d} for d in (1e-6, -1e-6))
        detached = {"w": at["b"], "b": at["w"]}[k]
        assert g[k] == pytest.approx((loss(up)[0] - loss(down)[0]) / 2e-6 - detached, abs=1e-5)


@pytest.mark.parametrize("make", [lambda p: optim.SGD(p, 0.1), lambda p: optim.SGD(p, 0.05, momentum=0.9, nesterov=True), lambda p: optim.Adam(p, 0.1, amsgrad=True), lambda p: optim.AdamW(p, 0.1), lambda p: optim.RMSProp(p, 0.05, momentum=0.5, centered=True), lambda p: optim.Adagrad(p, 0.5)])
def test_optimizers(make):
    o = make({"w": np.array([3.0, -2.0, 1.0])})
    for _ in range(300):
        o.step({"w": 2 * o.params["w"]})
    assert (o.params["w"] ** 2).sum() < 0.01


def test_plateau_and_clipping():
    o = optim.SGD({"w": 0.0}, 1.0)
    s = optim.ReduceLROnPlateau(o, patience=2)
    for v in (1.0, 1.0, 1.0, 1.0):
        s.step(v)
    assert o.lr == pytest.approx(0.1)
    g = {"a": np.array([3.0, 4.0])}
    assert optim.clip_grad_norm(g, 1.0) == pytest.approx(5) and np.linalg.norm(g["a"]) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        optim.SGD({"w": 0.0}, 0.1, nesterov=True)


def test_init():
    assert init.fans((4, 3, 2, 2)) == (12, 16)
    q = init.orthogonal((4, 4))
    assert np.allclose(q @ q.T, np.eye(4)) and np.abs(init.xavier_uniform((50, 50))).max() <= np.sqrt(6 / 100)
    with pytest.raises(ValueError):
        init.eye((2, 3))


def test_storage(spark, tmp_path):
    net = layers.Sequential([layers.Dense(3, 4), layers.BatchNorm1d(4), layers.Activation("ReLU"), layers.Dense(4, 2)])
    x = np.random.default_rng(0).normal(size=(8, 3))
    net.forward(x)
    io.save_model(spark, net, f"{tmp_path}/m")
    again = io.load_model(spark, f"{tmp_path}/m")
    assert np.allclose(net.eval().forward(x), again.eval().forward(x))
    o = optim.Adam(net.named(), 0.01)
    o.step({k: np.ones_like(v) for k, v in net.named().items()})
    net.load(o.params)
    io.save_checkpoint(spark, net, o, 3, f"{tmp_path}/c", {"note": "x"})
    p = optim.Adam(again.named(), 0.5)
    meta = io.load_checkpoint(spark, f"{tmp_path}/c", again, p)
    assert meta["epoch"] == 3 and p.steps == 1 and p.lr == 0.01 and np.allclose(p.state["0.weight"]["m"], o.state["0.weight"]["m"])
    with pytest.raises(KeyError):
        again.load({"9.weight": np.zeros(1)})


def test_classical_storage(spark, tmp_path):
    from tessera.operators import linear, prep, tree

    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    for n, m in enumerate((linear.Ridge(["a"], "y"), tree.DecisionTreeRegressor(["a"], "y", max_depth=2), prep.StandardScaler(["a"]))):
        m.fit(df)
        io.save_classical(spark, m, f"{tmp_path}/{n}")
        again = io.load_classical(spark, f"{tmp_path}/{n}")
        assert again.transform(df).orderBy("row_id").collect() == m.transform(df).orderBy("row_id").collect()


def test_loader(spark):
    df = spark.range(21).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("v"))
    loader = datasets.DataLoader(df, 8, shuffle=True)
    got = list(loader)
    assert len(loader) == len(got) == 3 and sorted(i for b in got for i in b["row_id"]) == list(range(21))
    assert len(datasets.DataLoader(df, 8, drop_last=True)) == 2
    assert [r["v"] for r in datasets.subset_dataset(df, [3, 3, 1]).orderBy("pos").collect()] == [6, 6, 2]
    assert datasets.concat_dataset(df, df).agg(F.max("row_id")).first()[0] == 41
    with pytest.raises(ValueError):
        datasets.array_dataset(df, df.limit(3))


def test_streams(spark, tmp_path):
    from tessera.operators.decomposition import PCA, IncrementalPCA
    from tessera.operators.prep import StandardScaler
    from tessera.streaming.incremental import fit_stream, score_stream

    df = spark.range(90).select(F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    m = IncrementalPCA(["a", "b"])
    fit_stream(stream, m, f"{tmp_path}/cp").awaitTermination()
    assert np.allclose(m.explained_variance_, PCA(["a", "b"]).fit(df).explained_variance_)
    score_stream(stream, StandardScaler(["a"]).fit(df), f"{tmp_path}/out", f"{tmp_path}/cp2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 90


@pytest.fixture
def narrow(spark):
    """Files are cut into more splits than they have row groups, so that most tasks have no rows."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["op_nn_batch_norm", "op_nn_gradient_norms", "op_nn_clip_grad_norm", "op_nn_parameter_norms", "op_nn_clip_grad_value"])
def test_queries_with_tasks_without_rows(spark, duck, narrow, name):
    from tessera.plans.catalogue import oracle_sql, queries, table
    from tests.conftest import DATA, rows_of

    assert 0 in table(spark, DATA, "embeddings").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert rows_of(queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


def test_kl_div_where_probabilities_are_zero(spark, duck, tmp_path):
    """The logarithm of zero is minus infinity in SQL, not a missing value: such rows count."""
    from tessera.plans.catalogue import oracle_sql, queries

    spark.createDataFrame([(50.0, "purchase"), (0.0, "click")], "value double, event_type string").write.parquet(f"{tmp_path}/a/events.parquet")
    spark.createDataFrame([(50.0, "purchase"), (0.0, "purchase")], "value double, event_type string").write.parquet(f"{tmp_path}/b/events.parquet")
    spark.createDataFrame([(50.0, "purchase"), (None, "purchase")], "value double, event_type string").write.parquet(f"{tmp_path}/c/events.parquet")
    for d in "abc":
        sql = oracle_sql()["op_loss_kl_div"].replace("FROM events", f"FROM read_parquet('{tmp_path}/{d}/events.parquet/*.parquet')")
        assert np.array_equal([queries()["op_loss_kl_div"](spark, f"{tmp_path}/{d}").first()[0]], duck.execute(sql).fetchone(), equal_nan=True)
