"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

Texts become sets of hashed n-grams of code points, in lower case, where all that is no letter or digit is a space. From labelled texts come the counts of texts of each class
that hold an n-gram, and so its log-count ratio; the n-grams that tell the classes apart best are the features, valued at their
ratio where present, and a ridge-penalised logistic regression weighs them. Scoring looks all n-grams of a batch up in one table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, powers, strings
from .labelled import remainder, sample
from .shared import kept

#: At most so many labelled rows are learnt from.
SAMPLE = 10_000
ORDERS, BUCKET_BITS, KEPT = (3, 4, 5, 6), 20, 4096
SMOOTH, RIDGE, STEPS = 1.0, 0.1, 300
#: Bytes of text that are looked at together: their n-grams of all orders are held at once.
_BYTES = 1 << 20
_BASE, _SPREAD = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93


#: Code points below 0x3000: their lower case, where that is one letter; others stay as they are.
FOLD = np.array([ord(low) if len(low := chr(i).lower()) == 1 and chr(i).isalnum() else i if chr(i).isalnum() else 0x20 for i in range(0x3000)], np.uint32)


def code_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows and each row's offsets (n + 1)."""
    buf, off = strings(col)
    lead = (buf & 0xC0) != 0x80
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=at[1:])
    cps = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    return np.where(cps < len(FOLD), FOLD[np.minimum(cps, len(FOLD) - 1)], cps), at[off]


def grams(cps: np.ndarray, off: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, by row. A feature is an n-gram's bucket or, with a table, table[bucket] where that is >= 0."""
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum((cps.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(cps)), out=total[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(cps))
    found = []
    for n in ORDERS:
        if len(cps) < n:
            continue
        key = total[n:] - total[:-n]
        key *= back[: len(key)]
        key += np.uint64(n)
        key *= np.uint64(_SPREAD)
        key ^= key >> np.uint64(32)
        key *= np.uint64(_SPREAD)
        key >>= np.uint64(64 - BUCKET_BITS)
        bucket = key.astype(np.int64)
        pos = np.arange(len(bucket)) if table is None else np.flatnonzero(table[bucket] >= 0)
        row = np.searchsorted(off, pos, "right") - 1
        inside = pos + n <= off[row + 1]
        f = bucket[pos[inside]] if table is None else table[bucket[pos[inside]]]
        found.append(row[inside] << BUCKET_BITS | f)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


@dataclass
class Linear:
    bias: float
    table: np.ndarray  # of all buckets: the feature's number, or -1
    weight: np.ndarray  # of each feature: learnt weight times log-count ratio

    def score(self, col: pa.Array) -> np.ndarray:
        row, f = grams(*code_points(col), self.table)
        z = self.bias + np.bincount(row, self.weight[f], len(col)) if len(row) else np.full(len(col), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", bound: int = SAMPLE) -> Linear:
    """Counts are summed on the executors; the driver gets a row for each bucket, then the kept features of each labelled text."""
    rows = kept(sample(docs, labels, label, usable, bound))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BUCKET_BITS), np.int32)
        size = np.zeros(2, np.int64)
        for batch in chunks(batches, "text", _BYTES):
            y = batch.column(1).to_numpy()
            row, f = grams(*code_points(batch.column(0)), None)
            for c in (0, 1):
                n[c] += np.bincount(f[y[row] == c], minlength=n.shape[1]).astype(np.int32)
                size[c] += (y == c).sum()
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(n[0, at], size[0]), pa.int64()), pa.array(np.append(n[1, at], size[1]), pa.int64())], ["f", "clean", "toxic"])

    got = rows.mapInArrow(count, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("f < 0 or clean + toxic > 2").toArrow()
    f, neg, pos = (got.column(c).to_numpy() for c in ("f", "clean", "toxic"))
    n0, n1 = (int(x[f < 0].sum()) for x in (neg, pos))
    rate = (n1 + 0.5) / (n0 + n1 + 1)
    nothing = Linear(float(np.log(rate / (1 - rate))), np.full(1 << BUCKET_BITS, -1, np.int32), np.zeros(1))
    if not n0 or not n1:
        return nothing
    real = f >= 0
    f, neg, pos = f[real], neg[real].astype(float), pos[real].astype(float)
    # Log-count ratio: of the shares of texts of either class that hold the n-gram.
    ratio = np.log((pos + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((neg + SMOOTH) / (n0 + 2 * SMOOTH))
    expect = (pos + neg) * n1 / (n0 + n1)
    apart = (pos - expect) ** 2 / (expect * (1 - (pos + neg) / (n0 + n1 + 1)))
    best = np.lexsort((f, -apart))[:KEPT]
    table = nothing.table.copy()
    table[f[best]] = np.arange(len(best))
    ratio = ratio[best]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _BYTES):
            row, g = grams(*code_points(batch.column(0)), table)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(g, pa.int32()))], ["label", "f"])

    got = rows.mapInArrow(vectors, "label int, f array<int>").toArrow().combine_chunks()
    y = got.column("label").to_numpy().astype(float)
    lists = got.column("f").combine_chunks()
    g, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    weight, bias = logistic(np.repeat(np.arange(len(y)), size), g, ratio[g], y, len(best), nothing.bias)
    return Linear(bias, table, weight * ratio)


def logistic(row: np.ndarray, f: np.ndarray, v: np.ndarray, y: np.ndarray, n: int, bias: float) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression of sparse rows by accelerated gradient steps, scaled by each feature's curvature."""
    w, b = np.zeros(n), bias
    ahead, ahead_b = w.copy(), b
    width = np.bincount(row, np.abs(v), len(y))
    curve = 0.25 * np.bincount(f, np.abs(v) * width[row], n) + RIDGE
    curve_b = 0.25 * (len(y) + np.abs(v).sum()) + 1e-9
    curve += 0.25 * np.bincount(f, np.abs(v), n)
    for t in range(1, STEPS + 1):
        z = ahead_b + np.bincount(row, v * ahead[f], len(y))
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = ahead - (np.bincount(f, v * r[row], n) + RIDGE * ahead) / curve
        new_b = ahead_b - r.sum() / curve_b
        push = (t - 1) / (t + 2)
        ahead, ahead_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents. Labels of held-out ids (crc32 of the id as text, modulo 5, is 0) are
    not learnt from. Null texts are empty texts, which score as the bias has it; null ids are not held out; without labels of both
    classes every score is the rate of 1 (0.5 without any). Labels, lang, source and ids are no features. Rows that repeat an id are
    scored one by one; an empty table gives an empty result."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    src = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _BYTES):
            p = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return src.mapInArrow(run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
