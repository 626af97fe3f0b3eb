"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows are sets of shingles. A document that contains a window contains its rarest shingle, so that shingle alone
is the window's necessary prefix: shingles are ordered by their count over the whole corpus, documents are joined with the
prefix shingles, and the shingle's place in its window gives the one place where the window can lie. A candidate passes the
bounds (the window fits between the document's first and last word) and then must agree with the window word by word.

Items stay on the executors. Two scans read the corpus, however many items there are: one counts the items' shingles, one finds
places of prefix shingles, with the few words around them that a window there would need. What a scan lets pass is told by a bit
map of hashes, whose size follows from the number of shingles up to a bound; beyond that, more places than needed pass, which the
join then drops. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import dealt_join
from .flat import ALNUM, LOWER, chunks, hash_windows, hash_words, ranges, strings, window_starts, words
from .shared import kept

WINDOW, SHINGLE = 10, 3
#: Bits of a map for each of its hashes, so that about one other shingle in as many passes; and the size of the map, as a power
#: of two, at least and at most (2**27 bits are 16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 1024, 16, 27
_SEGMENT = 12


def tokenised(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all rows, words' starts and ends, and each row's words."""
    buf, off = strings(col)
    return (LOWER[buf], *words(buf, off, ALNUM))


def joined_words(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> str:
    return b" ".join([bytes(buf[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]).decode()


def item_windows(items: DataFrame, item_cols: tuple[str, str], window: int) -> DataFrame:
    """item, k (words), win (the words, one space between): a row for each window; an item of fewer words is one."""
    src = items.select(items[item_cols[0]].cast("string").alias("item"), items[item_cols[1]].cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            buf, s, e, off = tokenised(batch.column(1))
            n = np.diff(off)
            count = np.where(n == 0, 0, np.maximum(n - window + 1, 1))
            at, row = ranges(off[:-1], count), np.repeat(np.arange(len(n)), count)
            size = np.minimum(n, window)[row]
            win = [joined_words(buf, s[a : a + k], e[a : a + k]) for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(size, pa.int32()), pa.array(win, pa.string())], ["item", "k", "win"])

    return src.mapInArrow(run, "item string, k int, win string")


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """windows (win, k) to win, k, place, key: all shingles of each window, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "win"):
            buf, s, e, off = tokenised(batch.column(0))
            h, n = hash_words(buf, s, e), np.diff(off)
            size = np.minimum(n, shingle)
            count = n - size + 1
            row, at = np.repeat(np.arange(len(n)), count), ranges(off[:-1], count)
            key = hash_windows(h, at, size[row]) ^ size[row].astype(np.uint64)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at - off[:-1][row], pa.int32()), pa.array(key.view(np.int64))], ["win", "k", "place", "key"])

    return windows.select("win", "k").mapInArrow(run, "win string, k int, place int, key long")


class Marks:
    """A bit map of hashes (their leading bits), of a size that grows with their number up to 2**MOST_BITS bits."""

    def __init__(self, keys: DataFrame):
        n = max(1, keys.count())
        self.bits = bits = int(np.clip(int(np.ceil(np.log2(BITS_EACH * n))), LEAST_BITS, MOST_BITS))
        place = F.shiftrightunsigned("key", 64 - bits)
        segment, within = F.shiftright(place, _SEGMENT).alias("segment"), place.bitwiseAND((1 << _SEGMENT) - 1).cast("int")
        rows = keys.select(segment, within.alias("place")).groupBy("segment").agg(F.collect_set("place").alias("places"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                on = np.zeros((batch.num_rows, 1 << _SEGMENT), bool)
                on[np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in np.packbits(on, axis=1, bitorder="little")], pa.binary())], ["segment", "bits"])

        held = np.zeros((1 << (bits - _SEGMENT), 1 << (_SEGMENT - 3)), np.uint8)
        for r in rows.mapInArrow(pack, "segment long, bits binary").collect():  # 2**15 rows of 512 bytes at most
            held[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
        self.held = keys.sparkSession.sparkContext.broadcast(held.ravel())

    def __getstate__(self):
        return {"bits": self.bits, "held": self.held}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def has(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def occurring(h: np.ndarray, off: np.ndarray, sizes: list[int], marks: Marks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of shingle: the positions whose hash is marked, and these."""
    for k in sizes:
        pos, _ = window_starts(off, k)
        key = hash_windows(h, pos, k) ^ np.uint64(k)
        ok = marks.has(key)
        yield k, pos[ok], key[ok]


def corpus_counts(src: DataFrame, sizes: list[int], marks: Marks) -> DataFrame:
    """key, n: how often marked shingles occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            buf, s, e, off = tokenised(batch.column(0))
            found = [key for _, _, key in occurring(hash_words(buf, s, e), off, sizes, marks)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return src.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def candidates(src: DataFrame, sizes: list[int], marks: Marks, window: int) -> DataFrame:
    """src (id, a, b, text) to id, a, b, n_words and cands: places of marked shingles (pos, key), with the words that a window
    there may reach (around, beginning at word ``first``)."""
    cand = "array<struct<pos: int, key: bigint, first: int, around: string>>"
    schema = T.StructType([*src.select("id", "a", "b").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("cands", T._parse_datatype_string(cand))])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("first", pa.int32()), ("around", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            buf, s, e, off = tokenised(batch.column(3))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for k, pos, key in occurring(hash_words(buf, s, e), off, sizes, marks):
                row = np.searchsorted(off, pos, "right") - 1
                low, high = np.maximum(off[row], pos - (window - k)), np.minimum(off[row + 1], pos + window)
                for r, p, x, i, j in zip(row.tolist(), pos.tolist(), key.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True):
                    begin = int(off[r])
                    found[r].append({"pos": p - begin, "key": x, "first": i - begin, "around": joined_words(buf, s[i:j], e[i:j])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off), pa.int64()), pa.array(found, kind)], [f.name for f in schema])

    return src.select("id", "a", "b", "text").mapInArrow(run, schema)


def prefixes(windows: DataFrame, src: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """win, k, place, key: each window's rarest shingle in the corpus, the first of several."""
    places = kept(window_shingles(windows, shingle))
    counts = kept(corpus_counts(src, sizes, Marks(places.select("key").distinct())))
    ranked = dealt_join(places, counts, ["key"], "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "key")).alias("best")
    return kept(ranked.groupBy("win", "k").agg(best).select("win", "k", "best.place", "best.key"))


def found_windows(docs: DataFrame, items: DataFrame, window: int, shingle: int, id_col: str, text_col: str, item_cols: tuple[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of docs (id, a, b: hashes of id and text, n_words), verified occurrences (a, b, start, k, win), and win, item."""
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    src = src.select("id", F.xxhash64("id").alias("a"), F.xxhash64("text").alias("b"), "text")
    every = kept(item_windows(items, item_cols, window))
    windows = kept(every.select("win", "k").distinct())
    sizes = [r[0] for r in windows.select(F.least("k", F.lit(shingle)).alias("k")).distinct().collect()]  # as many as words in a shingle
    prefix = prefixes(windows, src, sizes, shingle)
    rows = kept(candidates(src, sizes, Marks(prefix.select("key").distinct()), window))
    one = rows.where(F.size("cands") > 0).dropDuplicates(["a", "b"]).select("a", "b", "n_words", F.inline("cands"))
    met = dealt_join(kept(one), prefix, ["key"]).withColumn("start", F.col("pos") - F.col("place"))
    fits = met.where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("first") + 1, F.col("k")), " ") == F.col("win")
    hits = kept(fits.where(same).select("a", "b", "start", "k", "win"))
    return rows.drop("cands"), hits, every.where("item is not null").select("win", "item").distinct()


def covered_words(hits: DataFrame) -> DataFrame:
    """a, b, n_hit and hit_spans (maximal, in order) of each document with hits."""
    lists = hits.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("s"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n = [], []
            for some in batch.column(2).to_pylist():
                out: list[dict] = []
                for x in some:
                    if out and x["start"] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], x["end"])
                    else:
                        out.append(dict(x))
                spans.append(out)
                n.append(sum(x["end"] - x["start"] for x in out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(spans, kind)], ["a", "b", "n_hit", "hit_spans"])

    return lists.mapInArrow(run, "a long, b long, n_hit long, hit_spans array<struct<start: int, end: int>>")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text")) -> DataFrame:
    """One row a document: id, n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans (word positions [start, end)),
    contaminated.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Every window of ``window`` consecutive words
    of an item (the whole item if it has fewer, but not none) that occurs in the document hits its words there. Null texts have
    no words and null item texts no windows; an item without an id hits words, but is not named or counted. Items that share an
    id count once. Document ids may be null or repeat: each row is judged by its own text. Empty documents give no rows, empty
    items no hits. Other columns are left aside.
    """
    rows, hits, named = found_windows(docs, items, window, shingle, id_col, text_col, item_cols)
    each = dealt_join(kept(hits.select("a", "b", "win").distinct()), named, ["win"]).groupBy("a", "b").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = covered_words(hits).join(each, ["a", "b"], "left")
    out = dealt_join(rows, kept(told), ["a", "b"], "left")
    ids, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    spans = F.coalesce("hit_spans", F.array().cast("array<struct<start: int, end: int>>"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), spans.alias("hit_spans"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_cols: tuple[str, str] = ("item_id", "text")) -> DataFrame:
    """The rows of docs that ``contamination`` does not call contaminated, all columns as they are. Rows without words stay."""
    _, hits, _ = found_windows(docs, items, window, shingle, id_col, text_col, item_cols)
    gone = kept(hits.select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct())
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(docs[id_col]).alias("_a"), F.xxhash64(docs[text_col].cast("string")).alias("_b"))
    return named.join(gone, ["_a", "_b"], "left_anti").select("_row.*")
