"""Mixing sources to target weights by nested hash thresholds [DataFrame operations only].

Every row gets a hash that depends on its id alone. Sizes are summed by source and hash bucket; over the buckets' running
sums a source's budget has one threshold, and only the bucket in which it falls is split by further hash digits. Rows below
the threshold are taken once more than those above: no row is sorted, and nothing larger than the histograms (16**3 rows a
source and level) meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running
from .shared import kept

#: Hex digits of the hash that each level of the histogram adds.
DIGITS, LEVELS = 3, 3
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words that ASCII white space ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: source, source_size, target.

    Sources by code point, null last, take the weights in turn. Targets are the weights' shares of ``share`` times all sizes,
    but no more than ``most`` times the source's own size; what exceeds that is shared anew by weight among the others. That
    fixed point is found in one pass: in order of limit / weight, sources are full as long as an equal level would exceed their
    limit. Running sums over the sources are taken by parts, so there may be any number of them.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = running(by, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("long")
    full = F.col("source_size") * most
    w = by.select("source", "source_size", weight.alias("weight"), full.alias("full"))
    w = running(w, [(F.col("full") / F.col("weight")).asc(), F.col("source").asc_nulls_last()], {"full_upto": F.col("full"), "weight_upto": F.col("weight")})
    sums = w.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    w = kept(w.crossJoin(F.broadcast(sums)))  # one row
    rest = F.col("weights") - F.col("weight_upto") + F.col("weight")
    level = (F.lit(float(share)) * F.col("total") - (F.col("full_upto") - F.col("full"))) / rest
    found = w.agg(F.max(F.when(level * F.col("weight") <= F.col("full"), level)).alias("level"))
    target = F.least(F.col("full").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("full").cast("double")))
    return w.crossJoin(F.broadcast(found)).select("source", "source_size", target.alias("target"))


def row_hash(doc_id: Column, text: Column) -> Column:
    """32 hex digits; rows that have no id are hashed by their text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text), F.lit("")).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """docs (doc_id, text, source) to doc_id, source, size, source_size, target, taken.

    size: the text's words (null: 0). taken: whole multiples of size, so that the sum of a source is its target less what the
    last split bucket holds. A source's rows are taken floor(target / source_size) times, and those whose hash is below the
    source's threshold once more. Null sources are one source. Rows of one doc_id stand or fall together; rows without an id go
    by their text. Empty texts and empty sources take 0; an empty table gives an empty result. Columns that are not named here
    are left aside.
    """
    sized = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")))
    return mix_sized(sized, weights, share, most, levels).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_sized(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """As ``mix``, for rows that have size and hash already; all other columns stay. A table to be read more than once."""
    goal = targets(sized, weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = goal.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    plan = plan.withColumn("below", F.lit("")).select("source", "source_size", "target", "times", "rest", "below")
    plan = kept(plan)
    for level in range(levels):
        plan = refine(sized, plan, DIGITS * (level + 1))
    out = sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left")
    more = (F.col("s.hash") < F.col("p.below")).cast("long")
    return out.select("s.*", "p.source_size", "p.target", (F.col("s.size") * (F.col("p.times") + more)).alias("taken"))


def refine(sized: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """plan with thresholds of ``digits`` hex digits: rows of a lower hash fit the budget, those of the bucket ``below`` names
    may not. Only rows in the bucket named so far are summed; rest is the budget that is left for it."""
    had = digits - DIGITS
    # One row a source, of a written table: Spark broadcasts it or not by its size.
    at = plan.select(F.col("source").alias("of"), F.col("below").alias("bucket"))
    inside = sized.join(at, sized["source"].eqNullSafe(F.col("of")) & (F.substring(sized["hash"], 1, had) == F.col("bucket")))
    buckets = inside.groupBy("source", F.substring("hash", 1, digits).alias("next")).agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("next"))
    found = buckets.select("source", "next", (run - F.col("n")).alias("before"), run.alias("upto")).alias("b")
    p = plan.alias("p")
    crossing = found.join(p, F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.before") <= F.col("p.rest")) & (F.col("b.upto") > F.col("p.rest")))
    nexts = crossing.select(F.col("p.source").alias("of"), F.col("b.next").alias("next"), F.col("b.before").alias("used")).alias("n")
    joined = plan.alias("p").join(nexts, F.col("p.source").eqNullSafe(F.col("n.of")), "left")
    # No bucket crosses where rest covers all of them: every row of the bucket is below its successor.
    past = F.concat(F.col("p.below"), F.lit("~"))
    cut = kept(joined.select("p.source", "p.source_size", "p.target", "p.times", (F.col("p.rest") - F.coalesce(F.col("n.used"), F.lit(0))).alias("rest"), F.coalesce(F.col("n.next"), past).alias("below")))
    return cut
