"""Quality classifier: a generalised additive model with pairwise interactions over features of the whole text.

Training boosts shallow trees on one feature (later: one pair of features) after the other, again and again; as each tree sees
one feature only, all of them add up to one table of scores per feature. Scoring finds each feature's bin and adds up table
entries, for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import NOT_WHITE, WHITE, chunks, hash_windows, hash_words, mix, row_sums, strings, window_starts, words
from .labelled import remainder, sample

#: At most so many labelled rows are learnt from.
SAMPLE = 12_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 40, 4
RATE, LEAST, RIDGE = 0.1, 10, 2.0
REPEAT = 8
#: Bytes of text whose features are worked out together.
_BYTES = 1 << 20
_CLASSES = {
    "upper": np.isin(np.arange(256), [*range(65, 91)]),
    "symbol": np.isin(np.arange(256), [*b"#*$%&<>@^~\\{}[]_=+"]),
    "pipe": np.arange(256) == ord("|"),
    "bang": np.isin(np.arange(256), [*b"!?"]),
    "stop": np.isin(np.arange(256), [*b".,;:"]),
    "digit": np.isin(np.arange(256), [*range(48, 58)]),
    "beyond_ascii": np.arange(256) >= 0xC0,
}
FEATURES = ("words", "word_chars", "long_word", "short_words", *_CLASSES, "distinct", "repeated", "same_lines", "line_words", "white")


def repeated_in_row(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys stand twice or more in their row."""
    k = mix(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key
    order = np.argsort(k, kind="stable")
    same = k[order][1:] == k[order][:-1]
    out = np.zeros(len(k), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later_in_row(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which keys stood in their row before."""
    k = mix(row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key
    order = np.argsort(k, kind="stable")
    out = np.zeros(len(k), bool)
    out[order[1:][k[order][1:] == k[order][:-1]]] = True
    return out


def features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all of them are finite, and 0 for empty texts."""
    buf, off = strings(col)
    s, e, w_off = words(buf, off)
    n_rows, n = len(off) - 1, np.diff(w_off)
    row = np.repeat(np.arange(n_rows), n)
    over = lambda a, b: a / np.maximum(b, 1)
    lead = (buf & 0xC0) != 0x80
    cp = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=cp[1:])
    size = cp[e] - cp[s]
    chars = row_sums(size, w_off)
    h = hash_words(buf, s, e)
    longest = np.zeros(n_rows)
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(size, w_off[some])
    at, count = window_starts(w_off, REPEAT)
    twice = at[repeated_in_row(hash_windows(h, at, REPEAT), np.repeat(np.arange(n_rows), count))]
    mark = np.zeros(len(h) + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + REPEAT, -1)
    in_line = np.ones(256, bool)
    in_line[10] = False
    ls, le, l_off = words(buf, off, in_line)
    known = np.concatenate(([0], np.cumsum(NOT_WHITE[buf])))
    lines = known[le] > known[ls]
    ls, le, l_row = ls[lines], le[lines], np.repeat(np.arange(n_rows), np.diff(l_off))[lines]
    n_lines = np.bincount(l_row, minlength=n_rows)
    again = np.bincount(l_row, later_in_row(hash_words(buf, ls, le), l_row), minlength=n_rows)
    each = {name: over(row_sums(of[buf], off), chars) for name, of in _CLASSES.items()}
    values = {
        "words": np.log1p(n), "word_chars": over(chars, n), "long_word": np.log1p(longest), "short_words": over(row_sums(size <= 3, w_off), n), **each,
        "distinct": 1 - over(row_sums(later_in_row(h, row), w_off), n), "repeated": over(row_sums(np.cumsum(mark[:-1]) > 0, w_off), n), "same_lines": over(again, n_lines), "line_words": np.log1p(over(n, n_lines)), "white": over(row_sums(WHITE[buf], off), chars),
    }
    return np.stack([values[f].astype(np.float64) for f in FEATURES], axis=1)


@dataclass
class Additive:
    """Bin edges and score tables. edges[f] ascending: a value's bin is the number of edges that are not above it."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # f, g, edges of f and g, table

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for f, g, ef, eg, table in self.pairs:
            total += table[np.searchsorted(ef, x[:, f], "right"), np.searchsorted(eg, x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between about equally filled bins, none between equal values."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    q = np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))
    at = np.searchsorted(values, q)
    at = at[at + 1 < len(values)]
    edges = np.unique(np.append((values[at] + values[at + 1]) / 2, np.quantile(x, [0.99, 0.995])))
    return edges[edges > values[0]]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The tree of at most three leaves that best fits gradient sums by bin; its value in each bin."""
    leaves = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for leaf, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            gain[(cn[:-1] < LEAST) | (cn[-1] - cn[:-1] < LEAST)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], leaf, a + i + 1)
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a table of gradient sums: its gain and its value in each cell."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (0.0, np.zeros(g.shape))
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            corner = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])  # noqa: B023, E731
            gs, hs = np.array(corner(cg)), np.array(corner(ch))
            gain = _gain(gs, hs).sum()
            if gain > best[0]:
                table = np.zeros(g.shape)
                for at, v in zip(q, gs / (hs + RIDGE), strict=True):
                    table[at] = v
                best = (gain, table)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting on the logistic loss; then the pairs of greatest gain on what is left. With one class or no rows: its rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(float(np.log(rate / (1 - rate))), [cuts(x[:, f], BINS) if len(x) else np.zeros(0) for f in range(x.shape[1])], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    filled = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, model.tables, strict=True)]
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for b, t, n in zip(binned, model.tables, filled, strict=True):
            if len(t) < 2:
                continue
            p = 1 / (1 + np.exp(-total))
            step = RATE * shallow(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), n)
            t += step
            total += step[b]
    coarse = [cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-total))

    def sums(f: int, g: int, p: np.ndarray):
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        at = cells[f] * shape[1] + cells[g]
        return at, shape, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((quadrants(*sums(f, g, p)[2:])[0], -f, -g) for f in range(x.shape[1]) for g in range(f + 1, x.shape[1]) if len(coarse[f]) and len(coarse[g])), reverse=True)
    chosen = [(-f, -g) for gain, f, g in ranked[:pairs] if gain > 0]
    model.pairs = [(f, g, coarse[f], coarse[g], np.zeros((len(coarse[f]) + 1, len(coarse[g]) + 1))) for f, g in chosen]
    for _ in range(pair_rounds):
        for f, g, _, _, table in model.pairs:
            at, shape, gs, hs = sums(f, g, 1 / (1 + np.exp(-total)))
            step = RATE * quadrants(gs, hs)[1]
            table += step
            total += step.ravel()[at]
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", bound: int = SAMPLE) -> Additive:
    """Fits on the features of at most ``bound`` labelled documents; only their features come to the driver."""
    rows = sample(docs, labels, label, usable, bound)
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _BYTES):
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T)], ["label", *names])

    got = rows.mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names)).toArrow()
    x = np.stack([got.column(n).to_numpy() for n in names], axis=1) if len(got) else np.zeros((0, len(names)))
    y = got.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the sums of floats below do not depend on how tasks were dealt
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with score and predicted added (columns of these names give way). Null texts are empty texts; rows are independent."""
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    src = docs.select(*rest)
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _BYTES):
            p = model.score(features(batch.column(rest.index("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    return src.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 3) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents. Labels of held-out ids (crc32 of the id as text, modulo 3, is 1) are
    not learnt from. Null ids are not held out; without usable labels every score is 0.5. Labels, lang, source and ids are no
    features. Rows that repeat an id are scored one by one; an empty table gives an empty result."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
