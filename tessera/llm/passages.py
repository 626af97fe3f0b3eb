"""Substring deduplication with suffix automata of reference shards.

A window of 13 words is removed from a document if a document of smaller id has it, too. Reference text is what holds the first
occurrence of a window that may be repeated; it is cut into shards of bounded size. Each shard's suffix automaton is built once and
sent to all streams of documents' text that may match the shard; there the text runs through it for matching statistics. Maximal
spans whose statistics reach the threshold go.

What may be repeated is found without a row for each window: of a window's nine 5-word grams the one of least hash is its anchor,
so that equal windows have equal anchors wherever they stand, and neighbouring windows mostly share one. An anchor that occurs in
one document only settles its windows at once. For the others, the least document with that anchor is the reference of the
documents after it. Windows that the reference does not have (their anchor stands elsewhere by chance, or the text was edited
beside it) go through a second round, in which each window is its own anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import dealt_join
from .automaton import Packed, Suffixes
from .flat import chunks, covered, hash_windows, hash_words, row_sums, strings, window_starts, words
from .shared import drop, kept

WINDOW, GRAM = 13, 5
#: Words of reference text in one shard, and of documents that one task streams through it.
SHARD_WORDS, STREAM_WORDS = 20_000, 400_000
#: Rows of a batch that carries texts.
TEXT_ROWS = 1024


def anchors_of(h: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows' starts, their rows, and the anchor's place and hash."""
    at, count = window_starts(off, window)
    row = np.repeat(np.arange(len(off) - 1), count)
    if not len(at):
        return at, row, at, np.zeros(0, np.int64)
    g = hash_windows(h, np.arange(len(h) - gram + 1), gram)
    if window == gram:
        return at, row, at, g[at].view(np.int64)
    # In blocks: the table of all windows' grams is wide.
    place = np.concatenate([b + sliding_window_view(g, window - gram + 1)[b].argmin(axis=1) for b in np.array_split(at, -(-len(at) // 65536))])
    return at, row, place, g[place].view(np.int64)


def hashed(col: pa.Array) -> tuple:
    buf, off = strings(col)
    s, e, w = words(buf, off)
    return buf, s, e, w, hash_words(buf, s, e)


def anchors(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, id: once for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            *_, w, h = hashed(batch.column(1))
            _, row, place, anchor = anchors_of(h, w, window, gram)
            first = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
            row, anchor = row[first], anchor[first]
            ids = batch.column(0).to_numpy()[row]
            _, one = np.unique(anchor.view(np.uint64) ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[one]), pa.array(ids[one], pa.int64())], ["anchor", "id"])

    return pieces.select("id", "text").mapInArrow(run, "anchor long, id long")


def dealt(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Reference and matching text: is_match, owner, id, th, start, n (words), text. Runs of windows of one owner are one row."""
    rows = anchors(pieces, window, gram)
    first = rows.groupBy("anchor").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("anchor", "owner")
    shared = rows.join(first, "anchor").groupBy("id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("owner").alias("owners"))
    full = pieces.join(shared, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "th", "start", "text", "anchors", "owners")}
            buf, s, e, w, h = hashed(col["text"])
            at, row, _, anchor = anchors_of(h, w, window, gram)
            if not len(at):
                continue
            ids = col["id"].to_numpy()
            # (row, anchor) to the anchor's owner; -1 for anchors of one document.
            size = np.diff(col["anchors"].offsets.to_numpy())
            salt = lambda r: (r.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            keys = col["anchors"].flatten().to_numpy().view(np.uint64) ^ salt(np.repeat(np.arange(len(ids)), size))
            order = np.argsort(keys)
            keys, owners = keys[order], col["owners"].flatten().to_numpy()[order]
            mine = anchor.view(np.uint64) ^ salt(row)
            i = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            owner = np.where(keys[i] == mine, owners[i], np.iinfo(np.int64).min)
            known = owner > np.iinfo(np.int64).min
            at, row, owner = at[known], row[known], owner[known]
            if not len(at):
                continue
            cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]))))
            a, b = at[cut], at[np.append(cut[1:], len(at)) - 1] + window
            r, o = row[cut], owner[cut]
            text = pa.array([bytes(buf[x:y]).decode() for x, y in zip(s[a].tolist(), e[b - 1].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(o != ids[r]), pa.array(o), pa.array(ids[r]), pa.array(col["th"].to_numpy()[r]), pa.array(col["start"].to_numpy()[r] + a - w[r]), pa.array(b - a), text],
                ["is_match", "owner", "id", "th", "start", "n", "text"],
            )

    return full.mapInArrow(run, "is_match boolean, owner long, id long, th long, start long, n long, text string")


def automata(references: DataFrame) -> DataFrame:
    """references (shard, text) to shard, automaton (packed): each shard's automaton, built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, Suffixes()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([shard.packed()], pa.binary())], ["shard", "automaton"])
        for batch in chunks(batches, "text"):
            *_, w, h = hashed(batch.column(1))
            for i, k in enumerate(batch.column(0).to_pylist()):
                if k != key:
                    if key is not None:
                        yield done()
                    key, shard = k, Suffixes()
                shard.add(h[w[i] : w[i + 1]].tolist())
        if key is not None:
            yield done()

    return references.select("shard", "text").repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, automaton binary")


def matched(rows: DataFrame, window: int) -> DataFrame:
    """Streams matching text through its shard's automaton: id, th, start, end (word places) of removed spans, text null; and of
    maximal runs of windows that the shard does not have, with their text.

    Shards have about SHARD_WORDS words, streams STREAM_WORDS; their numbers follow from sums, so both grow with the text and stay
    of one size. A shard's automaton is sent to each of the shard's streams, to these only.
    """
    words_in = rows.where("not is_match").agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-words_in // SHARD_WORDS)))).cast("int")
    rows = rows.withColumn("shard", shard)
    built = kept(automata(rows.where("not is_match")))
    streams = rows.where("is_match").groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("streams"))
    stream = F.pmod(F.xxhash64("id", "start"), F.col("streams")).cast("int").alias("stream")
    texts = dealt_join(rows.where("is_match"), streams, ["shard"]).select("shard", stream, F.lit(True).alias("is_match"), "id", "th", "start", "text", F.lit(None).cast("binary").alias("automaton"))
    sent = built.join(streams, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), F.lit(False).alias("is_match"), "automaton")
    both = texts.unionByName(sent, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in chunks(batches, "text"):
            buf, s, e, w, h = hashed(batch.column(6))
            found = []
            for i, is_match in enumerate(batch.column(2).to_pylist()):
                if not is_match:
                    shard = Packed(batch.column(7)[i].as_py())
                    continue
                has = np.array(shard.statistics(h[w[i] : w[i + 1]])[window - 1 :]) >= window
                edge = np.flatnonzero(np.concatenate(([True], has[1:] != has[:-1], [True])))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    found.append((i, x, y + window - 1, None if has[x] else bytes(buf[s[w[i] + x] : e[w[i] + y + window - 2]]).decode()))
            if found:
                i, x, y, text = zip(*found, strict=True)
                at = np.array(i)
                start = batch.column(5).to_numpy(zero_copy_only=False)[at].astype(np.int64)
                keys = [batch.column(c).take(pa.array(at)) for c in (3, 4)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(start + x), pa.array(start + y), pa.array(text, pa.string())], ["id", "th", "start", "end", "text"])

    # The automaton comes before what is matched.
    return both.repartition("shard", "stream").sortWithinPartitions("shard", "stream", "is_match").mapInArrow(run, "id long, th long, start long, end long, text string")


def repeated(pieces: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, th, start, end: spans of words whose windows also start in a document of smaller id."""
    spans = []
    for size in (gram, window):
        rows = kept(dealt(pieces, window, size), TEXT_ROWS)
        found = kept(matched(rows, window), TEXT_ROWS)
        drop(rows)
        spans.append(found.where("text is null").select("id", "th", "start", "end"))
        pieces = found.where("text is not null").select("id", "th", "start", "text")
    return spans[0].unionByName(spans[1])


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_words, n_removed, kept_text (kept words, joined by one space) and removed_spans added; all columns stay.

    Words end at ASCII white space and are compared unchanged. A word goes if a window of ``window`` words of its document that
    covers it also starts in a document of smaller id; windows are judged on the input. Null texts have no words; texts of fewer
    than ``window`` words stay whole. Rows with a null id neither lose words nor take them from others. Rows of one id do not
    take from each other, and each is judged by its own text. Empty tables give empty results. Ids must be integers; a column
    that bears the name of an added one is replaced.
    """
    new = ["n_words", "n_removed", "kept_text", "removed_spans"]
    base = docs.select(*[c for c in docs.columns if c not in new], docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    base = base.withColumn("_th", F.xxhash64("_text"))
    pieces = base.where("_id is not null").select(F.col("_id").alias("id"), F.col("_th").alias("th"), F.lit(0).cast("long").alias("start"), F.col("_text").alias("text"))
    spans = repeated(pieces, window, gram).groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    full = base.join(spans, ["_id", "_th"], "left").drop("_id", "_th")
    rest = [c for c in full.columns if c not in ("_text", "_spans")]
    schema = full.select(*rest).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            col = batch.column(batch.schema.get_field_index("_text"))
            spans = batch.column(batch.schema.get_field_index("_spans"))
            buf, off = strings(col)
            s, e, w = words(buf, off)
            gone = np.zeros(len(s), bool)
            lists = spans.to_pylist()
            for i, some in enumerate(lists):
                if some:
                    gone[w[i] : w[i + 1]] = covered(int(w[i + 1] - w[i]), np.array([x["start"] for x in some]), np.array([x["end"] - x["start"] for x in some]))
            text = [b" ".join([bytes(buf[a:b]) for a, b in zip(s[w[i] : w[i + 1]][keep].tolist(), e[w[i] : w[i + 1]][keep].tolist(), strict=True)] if (keep := ~gone[w[i] : w[i + 1]]).sum() < w[i + 1] - w[i] else bytes(buf[off[i] : off[i + 1]]).split()).decode() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(np.diff(w), pa.int64()), pa.array(row_sums(gone.astype(np.int64), w), pa.int64()), pa.array(text, pa.string()), pa.array([x or [] for x in lists], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [*rest, *new],
            )

    return full.mapInArrow(run, schema)
