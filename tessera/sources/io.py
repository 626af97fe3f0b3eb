"""Models and checkpoints as plain data: Parquet tables of values and one JSON document. Nothing is executed on loading: classes
come from a fixed registry."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, name string, shape array<int>, values array<double>"


def _rows(kind: str, arrays: dict[str, np.ndarray]) -> list[tuple]:
    return [(kind, k, [int(n) for n in np.shape(v)], [float(x) for x in np.ravel(v)]) for k, v in arrays.items()]


def _write(spark: SparkSession, path: str, rows: list[tuple], meta: dict) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/values")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _read(spark: SparkSession, path: str) -> tuple[dict[str, dict[str, np.ndarray]], dict]:
    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    out: dict[str, dict[str, np.ndarray]] = {}
    for r in spark.read.parquet(f"{path}/values").collect():  # one row a parameter
        out.setdefault(r["kind"], {})[r["name"]] = np.array(r["values"]).reshape(r["shape"])
    return out, meta


def save_model(spark: SparkSession, model, path: str) -> None:
    """A network: parameters, kept state (running statistics) and the configuration of all layers."""
    _write(spark, path, _rows("params", model.named()) + _rows("state", model.named("state")), {"model": model.get_config()})


def load_model(spark: SparkSession, path: str):
    from ..nn.layers import build

    arrays, meta = _read(spark, path)
    model = build(meta["model"])
    for kind in ("params", "state"):
        model.load(arrays.get(kind, {}), kind)
    return model


def save_checkpoint(spark: SparkSession, model, optimizer, epoch: int, path: str, extra: dict | None = None) -> None:
    """The model, the optimizer's steps, groups and moments (by parameter name), the epoch and anything that JSON holds."""
    state = optimizer.state_dict()
    rows = _rows("params", model.named()) + _rows("state", model.named("state"))
    rows += _rows("moments", {f"{n}|{k}": v for n, s in state["state"].items() for k, v in s.items()})
    _write(spark, path, rows, {"model": model.get_config(), "epoch": epoch, "extra": extra or {}, "steps": state["steps"], "groups": state["groups"]})


def load_checkpoint(spark: SparkSession, path: str, model, optimizer=None) -> dict:
    """Restores all of it in place; returns epoch, extra and the model's configuration."""
    arrays, meta = _read(spark, path)
    for kind in ("params", "state"):
        model.load(arrays.get(kind, {}), kind)
    if optimizer is not None:
        moments: dict[str, dict] = {}
        for key, v in arrays.get("moments", {}).items():
            name, _, k = key.rpartition("|")
            moments.setdefault(name, {})[k] = v.item() if v.ndim == 0 else v
        groups = [{**g, **({"betas": tuple(g["betas"])} if "betas" in g else {})} for g in meta["groups"]]
        optimizer.load_state_dict({"steps": meta["steps"], "state": moments, "groups": groups})
        optimizer.params = model.named()
    return {"epoch": meta["epoch"], "extra": meta["extra"], "config": meta["model"]}


def registry() -> dict[str, type]:
    from ..operators import bayes, cluster, decomposition, linear, neighbors, prep, svm, tree

    names = (linear, bayes, cluster, decomposition, neighbors, prep, svm, tree)
    return {c.__name__: c for m in names for c in vars(m).values() if isinstance(c, type) and dataclasses.is_dataclass(c) and not c.__name__.startswith("_")} | {c.__name__: c for c in (linear.Lasso, neighbors.KNNClassifier, neighbors.KNNRegressor)}


def _plain(v, tables: list[DataFrame]):
    if isinstance(v, DataFrame):
        tables.append(v)
        return {"_table": len(tables) - 1}
    if isinstance(v, np.ndarray):
        return {"_array": v.tolist()}
    if isinstance(v, np.generic):
        return v.item()
    if dataclasses.is_dataclass(v) and not isinstance(v, type):
        return {"_object": type(v).__name__, "fields": {k: _plain(x, tables) for k, x in vars(v).items()}}
    if isinstance(v, dict):
        return {"_dict": [[_plain(k, tables), _plain(x, tables)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"_tuple": [_plain(x, tables) for x in v]}
    return [_plain(x, tables) for x in v] if isinstance(v, list) else v


def _object(v, known: dict[str, type], tables):
    if isinstance(v, list):
        return [_object(x, known, tables) for x in v]
    if not isinstance(v, dict):
        return v
    if "_table" in v:
        return tables(v["_table"])
    if "_array" in v:
        return np.array(v["_array"])
    if "_dict" in v:
        return {_object(k, known, tables): _object(x, known, tables) for k, x in v["_dict"]}
    if "_tuple" in v:
        return tuple(_object(x, known, tables) for x in v["_tuple"])
    out = object.__new__(known[v["_object"]])
    out.__dict__.update({k: _object(x, known, tables) for k, x in v["fields"].items()})
    return out


def save_classical(spark: SparkSession, model, path: str) -> None:
    """A fitted estimator or transform: its parameters and statistics as JSON, and each table that it holds (neighbours, classes)
    as Parquet beside it."""
    tables: list[DataFrame] = []
    document = json.dumps(_plain(model, tables))
    for i, t in enumerate(tables):
        t.write.mode("overwrite").parquet(f"{path}/table{i}")
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_classical(spark: SparkSession, path: str):
    document = "".join(r["value"] for r in spark.read.text(f"{path}/model").collect())
    return _object(json.loads(document), registry(), lambda i: spark.read.parquet(f"{path}/table{i}"))
