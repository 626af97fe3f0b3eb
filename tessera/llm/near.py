"""Near duplicates by circulant MinHash, banding and exact verification.

A text's distinct word shingles fall into cells of a fixed universe. One permutation deals the cells, another, shifted by one
place for each coordinate, gives them values; the least value at each shift is the signature. Equal bands of the signature make
two texts candidates, and a candidate is a link if the full sets agree.

Texts of equal sets are one class, and a class is handled once. Within a bucket, each class is held against the bucket's first
and last class only; links join classes into components. What is left is small: buckets that still hold several components.
There, classes of different components are compared in blocks of bounded size, band by band, so that no link between different
components is lost, and links inside one component need no look.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, merged
from .flat import LOWER, chunks, hash_windows, hash_words, mix, ranges, strings, window_starts, words
from .quality import later_in_row
from .shared import drop, kept

SHINGLE, PERCENT = 5, 75
BANDS, BAND_ROWS = 32, 4
#: A pair whose signatures agree in fewer coordinates than this, less so many deviations, is no link: with 128 coordinates one
#: pair in 10**5 of the least similarity falls below that, about as many as share no band.
DEVIATIONS = 4.3
KEYS = ["n", "set_a", "set_b"]
#: Rows of a batch that carries texts: one long text may stand in all of its rows.
TEXT_ROWS = 256
_CELL_BITS = 20
#: Where a bucket holds several components, its classes are compared in pairs of blocks: BLOCK classes each, or if that makes more
#: than BLOCKS blocks, larger ones up to WIDE_BLOCK (sketches only; of texts no more than two blocks come together).
BLOCK, BLOCKS, WIDE_BLOCK = 256, 16, 4096


@lru_cache(maxsize=1)
def permutations(size: int = BANDS * BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The dealing permutation, and all circular windows of ``size`` values of the second one (a view)."""
    rng = np.random.Generator(np.random.PCG64(20220601))
    deal = rng.permutation(1 << _CELL_BITS).astype(np.int32)
    value = rng.permutation(1 << _CELL_BITS).astype(np.uint32)
    return deal, sliding_window_view(np.concatenate((value, value[: size - 1])), size)


def shingles(col: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows and their rows' offsets (n + 1); a text of fewer words is one shingle."""
    buf, off = strings(col)
    buf = LOWER[buf]
    s, e, w_off = words(buf, off)
    h = hash_words(buf, s, e)
    n = np.diff(w_off)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    at, size = ranges(w_off[:-1], count), np.repeat(np.minimum(n, k), count)
    x = hash_windows(h, at, size) ^ mix(size.astype(np.uint64))
    row = np.repeat(np.arange(len(n)), count)
    new = ~later_in_row(x, row)
    return x[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def signatures(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's shingles: band hashes (BANDS a row), and the last byte of each coordinate (all of them a row)."""
    deal, windows = permutations()
    p = deal[(x >> np.uint64(64 - _CELL_BITS)).astype(np.int64)]
    out = np.full((len(off) - 1, BANDS * BAND_ROWS), 0xFFFFFFFF, np.uint32)
    for i in range(len(off) - 1):
        for a in range(off[i], off[i + 1], 4096):
            np.minimum(out[i], windows[p[a : min(a + 4096, off[i + 1])]].min(axis=0), out=out[i])
    v = out.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    h = np.broadcast_to(h, v.shape[:2])
    for j in range(BAND_ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ v[:, :, j])
    return np.ascontiguousarray(h).view(np.int64), (out & np.uint32(0xFF)).astype(np.uint8)


def wrapped_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]] modulo 2**64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def least_equal(percent: int) -> int:
    """Coordinates in which a link's signatures agree at least, but for rare chance."""
    n, j = BANDS * BAND_ROWS, percent / 100
    return int(n * j - DEVIATIONS * (n * j * (1 - j)) ** 0.5)


def summaries(src: DataFrame) -> DataFrame:
    """src (id, th, text) to id, th, n (size of the set), set_a, set_b (128 bits that only equal sets share), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x, off = shingles(batch.column(2))
            n = batch.num_rows
            bands, sketch = signatures(x, off)
            sets = [pa.array(wrapped_sums(mix(x ^ np.uint64(salt)), off).view(np.int64)) for salt in (0, 0x5DEECE66D)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
            sketches = pa.array([r.tobytes() for r in sketch], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.diff(off), pa.int64()), *sets, lists, sketches], ["id", "th", *KEYS, "bands", "sketch"])

    return src.mapInArrow(run, "id long, th long, n long, set_a long, set_b long, bands array<long>, sketch binary")


def bytes_of(col: pa.Array) -> np.ndarray:
    """Sketches as a table of bytes."""
    return strings(col)[0].reshape(-1, BANDS * BAND_ROWS)


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be links by the sets' sizes and their sketches."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "s_a", "s_b")
    least = least_equal(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array((bytes_of(batch.column(2)) == bytes_of(batch.column(3))).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets agree by ``percent`` of their union. Texts travel to pairs, each pair once."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a", 1 << 20):
            (x, xo), (y, yo) = shingles(batch.column(2)), shingles(batch.column(3))
            row = np.concatenate((np.repeat(np.arange(batch.num_rows), np.diff(xo)), np.repeat(np.arange(batch.num_rows), np.diff(yo))))
            shared = np.bincount(row[later_in_row(np.concatenate((x, y)), row)], minlength=batch.num_rows)
            union = np.diff(xo) + np.diff(yo) - shared
            ok = pa.array((100 * shared >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return kept(two.mapInArrow(run, "a long, b long").distinct(), TEXT_ROWS)


def shared_buckets(rows: DataFrame) -> DataFrame:
    """rows (bucket, id) with low, high (the bucket's least and greatest id), of buckets that hold two classes or more."""
    ends = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    # A frequent bucket's rows are spread by Spark's skew handling: the other side has one row.
    return rows.join(ends, "bucket")


def stars(rows: DataFrame) -> DataFrame:
    """Each class against the first and the last class of each of its buckets: a < b, distinct."""
    low = rows.where("id > low").select(F.col("low").alias("a"), F.col("id").alias("b"))
    high = rows.where("id < high and id > low").select(F.col("id").alias("a"), F.col("high").alias("b"))
    return low.unionByName(high).distinct()


def grouped(docs: DataFrame, percent: int, id_col: str, text_col: str, by_text: bool) -> tuple[DataFrame, DataFrame]:
    """All rows (id, th: the text's hash, n, set_a, set_b), and of each set that several rows or links have its component:
    the least id, and a number (group), as in ``by_text`` several components may have one least id.

    Classes bear a number of their own, so that one id may stand for several. Unless ``by_text``, the classes of one id are linked.
    """
    src = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    src = src.select("id", F.xxhash64("text").alias("th"), "text")
    rows = kept(summaries(src), 4 * TEXT_ROWS)
    full = rows.where("n > 0 and id is not null")
    first = F.min(F.struct("id", "th")).alias("first")
    classes = full.groupBy(*KEYS).agg(first, F.count("*").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = kept(classes.select(F.monotonically_increasing_id().alias("id"), F.col("first.id").alias("doc"), F.col("first.th").alias("th"), *KEYS, "size", "bands", "sketch"))
    shared = kept(shared_buckets(classes.select("id", F.explode("bands").alias("bucket"))))
    # The texts of all classes that have a candidate, picked once: one row each. The hint keeps one plan for every size of input.
    named = classes.join(shared.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("class"), F.col("doc").alias("id"), "th").hint("merge")
    texts = kept(src.join(named, ["id", "th"]).dropDuplicates(["class"]).select(F.col("class").alias("id"), "text"))
    found, more = linked(shared, classes, texts, percent)
    found = kept(merged(found, more if by_text else more.unionByName(of_one_id(full, classes))))
    drop(shared, texts, more)
    least = found.join(classes.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("least"))
    found = found.join(least, "component")
    placed = classes.where("size > 1").unionByName(classes.where("size = 1").join(found.select("id"), "id", "left_semi").select(*classes.columns))
    placed = placed.withColumnRenamed("id", "class").join(found.withColumnRenamed("id", "class"), "class", "left")
    return rows, placed.select(*KEYS, F.coalesce("least", "doc").alias("component"), F.coalesce("component", "class").alias("group"))


def of_one_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a < b) of the classes of each id that has several."""
    name = F.xxhash64(*KEYS)
    several = full.groupBy("id").agg(F.min(name).alias("x"), F.max(name).alias("y")).where("x < y").select("id")
    held = full.select("id", *KEYS).join(several, "id").distinct().withColumnRenamed("id", "doc_id").join(classes.select("id", *KEYS), KEYS).select("doc_id", "id")
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return held.join(least, "doc_id").where("a < id").select("a", F.col("id").alias("b")).distinct()


def placed_rows(docs: DataFrame, percent: int, id_col: str, text_col: str, by_text: bool) -> DataFrame:
    """id, th, n, component (null for a null id, the id itself for a row without shingles) and group (null for a row alone)."""
    rows, placed = grouped(docs, percent, id_col, text_col, by_text)
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")))
    return rows.select("id", "th", *KEYS).join(placed, KEYS, "left").select("id", "th", "n", own.alias("component"), "group")


def duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to id, n_shingles, component_id (the least id that links reach), kept (the id is its component's).

    Sets: distinct shingles of 5 words (A-Z lower-cased; words end at ASCII white space); a text of 1 to 4 words is one shingle;
    null, empty and white texts have none, link with nothing and are kept. Rows link if 100 * |A & B| >= percent * |A | B|. Rows
    with a null id link with nothing: their component is null and they are kept. Rows of one id are one document: what any of
    its texts links is linked, and all its rows with shingles have one component. Ids must be integers. Empty tables give empty
    results; other columns are left aside.
    """
    out = placed_rows(docs, percent, id_col, text_col, False)
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def survivors(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates, all columns as they are: of each group of linked texts the row of the least id stays.

    Links as in ``duplicates``, but between texts: where rows of one id hold different texts, each text is a document of its own,
    so that no text is lost with another one of its id (of several such texts in one group, that of the least hash stays). Rows
    that repeat an id and a text are one row. Rows with a null id and rows without shingles all stay, but for such repeats of an id.
    """
    out = placed_rows(docs, percent, id_col, text_col, True).where("id is not null")
    rows = kept(out.groupBy("id", "th", "component", "group").agg(F.count("*").alias("rows")))
    # Of each component the row of the least id, and of several texts of that id the one of least hash: a key that no other row has.
    heads = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("id", "th")).alias("h")).select("h.id", "h.th", F.lit(True).alias("head"))
    judged = rows.join(heads, ["id", "th"], "left").withColumn("stays", F.col("group").isNull() | F.coalesce("head", F.lit(False)))
    gone = kept(judged.where("not stays or rows > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th")))
    again = kept(judged.where("stays and rows > 1").select(F.col("id").alias("_id"), F.col("th").alias("_th")))
    named = docs.select(F.struct(*docs.columns).alias("_row"), docs[id_col].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("_th"))
    once = named.join(gone, ["_id", "_th"], "left_anti").select("_row.*")
    return once.unionByName(named.join(again, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*"))


def linked(shared: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The components (id, component) of the stars' verified links; and links that connect whatever else any link connects."""
    links = verified(plausible(stars(shared), classes, percent), texts, percent)
    found = components(links)
    rows = mixed(shared, found)
    more = crossing(rows, classes, texts, percent)
    drop(links, rows)
    return found, more


def mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """bucket, id, component, rows (of the bucket) for the buckets that hold several components."""
    rows = shared.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"))
    return kept(rows.join(several.where("x < y").select("bucket", "rows"), "bucket"))


def crossing(rows: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Verified links (a < b) that connect what is connected in the buckets of rows (bucket, id, component, rows).

    First the sketches of a bucket's classes are compared, in pairs of blocks. Only classes that have a plausible
    partner of another component in a pair of blocks come again, with their texts; these are compared in pairs of smaller blocks,
    and plausible pairs are verified, but for those that links of the same pair of blocks have connected already.
    """
    inside = rows.withColumn("key", F.col("bucket")).join(classes.select("id", F.col("n").alias("size"), "bands", "sketch"), "id")
    schema = "key long, p int, q int, own int, bucket long, id long, component long, size long, bands array<long>, sketch binary"
    names = [x.split()[0] for x in schema.split(", ")]
    blocks = F.greatest(F.least(F.ceil(F.col("rows") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("rows") / WIDE_BLOCK))
    some = kept(in_blocks(paired(inside, blocks, names), lambda t: [t.take(with_partner(t, percent))], names, schema))
    again = some.withColumn("key", F.xxhash64("key", "p", "q"))
    sizes = again.groupBy("key").agg(F.count("*").alias("rows"))
    again = paired(again.join(sizes, "key"), F.ceil(F.col("rows") / (2 * BLOCK)), names).join(texts, "id").select(*names, "text")
    links = kept(in_blocks(again, lambda t: [spanning(t, percent)], ["a", "b"], "a long, b long").distinct(), TEXT_ROWS)
    drop(some)
    return links


def paired(rows: DataFrame, blocks: Column, names: list[str]) -> DataFrame:
    """rows (key, rows: of the key) dealt to so many blocks of the key, once for each pair of blocks p <= q."""
    dealt = rows.withColumn("n", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).select(*names)


def with_partner(t: pa.Table, percent: int) -> np.ndarray:
    """The rows of one pair of blocks that ``partners`` names."""
    named = np.zeros(t.num_rows, bool)
    for rows in partners(t, percent):
        named[rows] = True
    return np.flatnonzero(named)


def in_blocks(rows: DataFrame, work, names: list[str], schema: str) -> DataFrame:
    """work(table) for the rows of each key and pair of blocks, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def out() -> Iterator[pa.RecordBatch]:
            for t in work(pa.Table.from_batches(held).combine_chunks()):
                yield from t.select(names).to_batches()

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if keys else []
            for a, b in zip(cut, cut[1:], strict=False):
                if keys[a] != key:
                    if held:
                        yield from out()
                    held, key = [], keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from out()

    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, schema)


def partners(t: pa.Table, percent: int, component: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each row of the first block: itself and its plausible partners of other components whose first common band is this
    bucket. component may change between the steps."""
    p, q = (t.column(c)[0].as_py() for c in ("p", "q"))
    bucket = t.column("bucket").to_numpy()
    own, ids, size = (t.column(c).to_numpy() for c in ("own", "id", "size"))
    comp = t.column("component").to_numpy() if component is None else component
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sketch = bytes_of(t.column("sketch"))
    least = least_equal(percent)
    left = np.flatnonzero(own == p)
    right = left if p == q else np.flatnonzero(own == q)
    for i in left.tolist():
        other = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) if p == q else True)]
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        other = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
        same = bands[other] == bands[i]
        other, same = other[same.any(axis=1)], same[same.any(axis=1)]
        other = other[bands[i][same.argmax(axis=1)] == bucket[i]] if len(other) else other
        if len(other):
            yield np.concatenate(([i], other))


def spanning(t: pa.Table, percent: int) -> pa.Table:
    """Links between components of one pair of blocks, no more than connect them."""
    found = [shingles(c.column(c.schema.get_field_index("text"))) for c in chunks(iter(t.to_batches()), "text", 1 << 20)]
    x = np.concatenate([x for x, _ in found])
    off = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for _, o in found]))))
    values, code = np.unique(x, return_inverse=True)
    mark = np.zeros(len(values), bool)
    component = t.column("component").to_numpy().copy()
    ids, size = t.column("id").to_numpy(), np.diff(off)
    links = []
    for rows in partners(t, percent, component):
        i, others = rows[0], rows[1:]
        mine = code[off[i] : off[i + 1]]
        mark[mine] = True
        at = ranges(off[others], size[others])
        ends = np.cumsum(size[others])
        total = np.concatenate(([0], np.cumsum(mark[code[at]])))
        shared = total[ends] - total[ends - size[others]]
        mark[mine] = False
        for j in others[100 * shared >= percent * (size[i] + size[others] - shared)].tolist():
            if component[j] != component[i]:
                links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                component[component == component[j]] = component[i]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})
