"""Quality rules with adaptive thresholds [DataFrame operations only].

The base rules' counts are plain expressions over one row. For the rest, every metric of a row is a small integer: a rate of
counted things, or a mean. A quantile sketch is the histogram of its buckets (linear up to 32, then 32 buckets an octave: a
relative error of 1/32 at most), so sketches of any two sets of rows merge by adding counts. Sketches are kept by language and
source, and each is blended with the sketch of its whole language, which weighs as much as PRIOR rows: the fewer rows a source
has, the more its thresholds are its language's. No threshold is fixed: a row is rejected where a metric lies so many interquartile
ranges beyond the quartiles of its own group, and by more counted things than chance puts into a short text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD, word_count

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: ASCII punctuation, as a character class's ranges.
MARKS = "!-/:-@\\[-`{-~"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Metrics: what is counted, what it is divided by, in which unit (thousandths; word_len: hundredths of a code point), and
#: whether a low and a high value count against a row. All of them have a spread in ordinary text, so that quartiles tell it.
METRICS = {
    "punctuation": ("_n_marks", "word_chars", 1000, False, True),
    "upper": ("_n_upper", "word_chars", 1000, False, True),
    "short_words": ("_n_short", "n_words", 1000, True, True),
    "word_len": ("word_chars", "n_words", 100, True, True),
    "distinct": ("_n_distinct", "n_words", 1000, True, False),
}
LOW_SIDE = [m for m, (*_, low, _) in METRICS.items() if low]
HIGH_SIDE = [m for m, (*_, high) in METRICS.items() if high]
#: Code points of a short word.
SHORT = 3
#: A threshold is a quartile and so many interquartile ranges (of LEAST units or more) beyond it.
SPREADS, LEAST = 6, 2
#: So many counted things must be too many or too few.
SLACK = 10
#: The language's sketch weighs as many rows as this; rows of a blended sketch are counted in parts of 1/UNIT.
PRIOR, UNIT = 50, 1000
#: The quartiles of the sketches, as numerators of quarters.
LOW, HIGH = 1, 3


def bucket(v: Column) -> Column:
    """The sketch's bucket of a non-negative integer, as that bucket's least value."""
    step = F.greatest(F.length(F.bin(v)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, step), step)


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) added.

    n_repeat_words: words are hashed, then pairs of hashes one, two and four places apart, which gives each 8-word window of the
    text a hash in three steps. Where these are not all distinct, they are sorted with their places, so that equal windows are
    neighbours; the places of those are put in order again, and the words that they cover are counted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    bare = F.call_function("btrim", text, F.lit(WHITE))
    out = docs.withColumn("_words", F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_lines", lines).withColumn("n_words", F.size("_words").cast("long"))
    # Windows that would pass the end are cut off below: their hash lacks its second half.
    out = out.withColumn("_h1", F.when(F.col("n_words") > WINDOW, F.transform("_words", lambda w: F.xxhash64(w))))
    for step in (1, 2, 4):
        h = F.col(f"_h{step}")
        out = out.withColumn(f"_h{2 * step}", F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda x, y: F.xxhash64(x, y)))
    out = out.withColumn("_hashes", F.slice("_h8", 1, F.size("_h8") - (WINDOW - 1)))
    placed = F.array_sort(F.transform(F.col("_hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_placed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), placed))
    # A column of its own: a field taken inside the comparison would be gathered anew for each element.
    out = out.withColumn("_sorted", F.transform("_placed", lambda x: x["h"]))
    same = lambda j: F.get(F.col("_sorted"), j)
    out = out.withColumn("_twice", F.array_sort(F.transform(F.filter(F.col("_placed"), lambda x, j: F.coalesce(x["h"] == same(j - 1), F.lit(False)) | F.coalesce(x["h"] == same(j + 1), F.lit(False))), lambda x: x["i"])))
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(F.col("_twice"), first, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": only(SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "_n_upper": only("A-Z").cast("long"),
            "_n_marks": only(MARKS).cast("long"),
            "_n_short": F.size(F.filter("_words", lambda w: F.length(w) <= SHORT)).cast("long"),
            "_n_distinct": F.size(F.array_distinct("_words")).cast("long"),
        }
    ).drop("_words", "_lines", "_h1", "_h2", "_h4", "_h8", "_hashes", "_placed", "_sorted", "_twice")


def metrics(counts: DataFrame) -> DataFrame:
    """counts with m_<metric> (long) for each of METRICS; 0 where there is nothing to divide by."""
    return counts.withColumns({f"m_{m}": F.coalesce(F.expr(f"{unit} * {a} div nullif({b}, 0)"), F.lit(0)).cast("long") for m, (a, b, unit, *_) in METRICS.items()})


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n of the rows that pass the base rules."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"m_{m}")).alias("bucket")) for m in METRICS]))
    return measures.where(~F.col("base_failed")).select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def blended(own: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Sketches with each language's sketch mixed into those of its sources, n in parts of 1/UNIT."""
    whole = own.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    rows = whole.groupBy("lang", "metric").agg(F.sum("n").alias("rows"))
    whole = whole.alias("w").join(rows.alias("r"), F.col("w.lang").eqNullSafe(F.col("r.lang")) & (F.col("w.metric") == F.col("r.metric")))
    share = F.expr(f"{prior * UNIT} * w.n div r.rows").alias("n")
    shares = whole.select(F.col("w.lang").alias("of"), "w.metric", "w.bucket", share)
    groups = own.select("lang", "source").distinct()
    added = groups.join(shares, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "source", "metric", "bucket", "n")
    return own.withColumn("n", F.col("n") * UNIT).unionByName(added).groupBy("lang", "source", "metric", "bucket").agg(F.sum("n").alias("n"))


def thresholds(measures: DataFrame, spreads: int = SPREADS, prior: int = PRIOR) -> DataFrame:
    """lang, source, t_<metric> for HIGH_SIDE and l_<metric> for LOW_SIDE (long): one row for each language and source of the rows
    that pass the base rules. A group's sketch has a bounded number of buckets, so its window is small."""
    w = Window.partitionBy("lang", "source", "metric")
    placed = blended(sketches(measures), prior).select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("rows"))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    of = placed.groupBy("lang", "source", "metric").agg(at(LOW).alias("low"), at(HIGH).alias("high"))
    room = spreads * F.greatest(F.col("high") - F.col("low"), F.lit(LEAST))
    pick = lambda m, value, name: F.max(F.when(F.col("metric") == m, value)).cast("long").alias(name)
    return of.groupBy("lang", "source").agg(*[pick(m, F.col("high") + room, f"t_{m}") for m in HIGH_SIDE], *[pick(m, F.col("low") - room, f"l_{m}") for m in LOW_SIDE])


def judge(docs: DataFrame, spreads: int = SPREADS, prior: int = PRIOR, store=None) -> DataFrame:
    """docs (doc_id, text, lang, source) to one row each: doc_id, lang, source, the base counts, base_failed, m_*, t_*, l_*, kept.

    Null texts are empty: no words, base_failed. Null languages and sources are groups like others. Rows that share a doc_id
    are judged one by one. An empty table gives an empty result; other columns are left aside. store: what keeps the measures,
    which are read twice (by default a table in the shared folder).
    """
    from .shared import kept as keep

    base = measured(docs.select("doc_id", "text", "lang", "source")).drop("text")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    rows = (store or keep)(metrics(base))
    t = thresholds(rows, spreads, prior)
    # One row for each language and source; beyond the session's limit Spark joins by a shuffle instead.
    out = rows.alias("r").join(t.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    fits = F.lit(True)
    for m in HIGH_SIDE:
        a, b, unit, *_ = METRICS[m]
        fits = fits & (unit * (F.col(f"r.{a}") - SLACK) <= F.col(f"t.t_{m}") * F.col(f"r.{b}"))
    for m in LOW_SIDE:
        a, b, unit, *_ = METRICS[m]
        fits = fits & (unit * (F.col(f"r.{a}") + SLACK) >= F.col(f"t.l_{m}") * F.col(f"r.{b}"))
    told = [f"r.{c}" for c in rows.columns if not c.startswith("_")]
    return out.select(*told, *[f"t.t_{m}" for m in HIGH_SIDE], *[f"t.l_{m}" for m in LOW_SIDE], (~F.col("r.base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))
