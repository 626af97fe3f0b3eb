"""Registered queries on small tables of their own: every row takes part."""

import numpy as np
import pytest

from tessera.plans.catalogue import queries


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with an embeddings table of 40 rows, ids from 480 in steps of 5; and the table's ids, vectors and labels."""
    rng = np.random.default_rng(6)
    ids, x, y = np.arange(40) * 5 + 480, rng.normal(size=(40, 64)).astype(np.float32), rng.integers(0, 10, 40)
    d = str(tmp_path_factory.mktemp("vectors"))
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, y, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, ids, x.astype(float), y


@pytest.mark.parametrize("name", ["op_model_svc", "op_model_svr"])
def test_kernel_machines_score_every_row(spark, vectors, name):
    d, ids, _, _ = vectors
    assert sorted(r["vec_id"] for r in queries()[name](spark, d).collect()) == ids.tolist()


def nearest(ids, x, wide):
    """Five nearest other rows of each id divisible by 20, as (id, distance), by brute force over the first ``wide`` values."""
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x[:, :wide] - x[i, :wide]) ** 2).sum(1))
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if j != i][:5]
    return out


def test_neighbours_among_all_rows(spark, vectors):
    d, ids, x, y = vectors
    want, label = nearest(ids, x, 64), dict(zip(ids.tolist(), y.tolist(), strict=True))
    assert any(j % 20 == 0 for near in want.values() for j, _ in near)
    got = {}
    for r in sorted(queries()["op_model_knn_neighbors"](spark, d).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["vec_id"], []).append((r["neighbor"], r["distance"]))
    assert got == {k: [(j, pytest.approx(f, abs=1e-6)) for j, f in near] for k, near in want.items()}
    votes = {k: [label[j] for j, _ in near] for k, near in want.items()}
    classes = {r["vec_id"]: r["prediction"] for r in queries()["op_model_knn_classifier"](spark, d).collect()}
    assert classes == {k: min(v, key=lambda c: (-v.count(c), c)) for k, v in votes.items()}
    means = {r["vec_id"]: r["prediction"] for r in queries()["op_model_knn_regressor"](spark, d).collect()}
    assert means == {k: pytest.approx(sum(label[j] / f for j, f in near) / sum(1 / f for _, f in near), abs=1e-4) for k, near in want.items()}


def test_im2col_unfolds_every_image(spark, vectors):
    d, ids, x, _ = vectors
    got = {(r["n"], r["oh"], r["ow"], r["kh"], r["kw"]): (r["h"], r["w"], r["v"]) for r in queries()["op_nn_im2col"](spark, d).collect()}
    places = [(oh, ow, kh, kw) for oh in range(6) for ow in range(6) for kh in range(3) for kw in range(3)]
    want = {(int(n), *p): (p[0] + p[2], p[1] + p[3], pytest.approx(v.reshape(8, 8)[p[0] + p[2], p[1] + p[3]], abs=1e-6)) for n, v in zip(ids, x, strict=True) for p in places}
    assert got == want
