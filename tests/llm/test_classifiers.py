"""Both classifiers on real tables: scores against plain re-implementations, and held-out accuracy."""

import math
import re
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity

TABLES = "/root/testdata/sf0.1"
WORD = re.compile("[^ \t-\r]+")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{TABLES}/labels.parquet")


def plain_features(text):
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    over = lambda a, b: a / max(b, 1)
    count = lambda some: over(sum(c in some for c in text), chars)
    wins = [tuple(words[i : i + 8]) for i in range(n - 7)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "words": math.log1p(n),
        "word_chars": over(chars, n),
        "long_word": math.log1p(max(map(len, words), default=0)),
        "short_words": over(sum(len(w) <= 3 for w in words), n),
        "upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "symbol": count("#*$%&<>@^~\\{}[]_=+"),
        "pipe": count("|"),
        "bang": count("!?"),
        "stop": count(".,;:"),
        "digit": count("0123456789"),
        "beyond_ascii": over(sum(ord(c) > 127 for c in text), chars),
        "distinct": 1 - over(n - len(set(words)), n),
        "repeated": over(len(covered), n),
        "same_lines": over(len(lines) - len(set(lines)), len(lines)),
        "line_words": math.log1p(over(n, len(lines))),
        "white": over(sum(c in " \t\n\x0b\x0c\r" for c in text), chars),
    }


def plain_quality(model, text):
    x = [plain_features(text)[f] for f in quality.FEATURES]
    near = lambda edges, v: bisect_right(edges.tolist(), v)
    z = model.base + sum(t[near(e, v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    z += sum(t[near(ef, x[f]), near(eg, x[g])] for f, g, ef, eg, t in model.pairs)
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_toxicity(model, text):
    mask = (1 << 64) - 1
    folded = [c if ord(c) >= 0x3000 else (c.lower() if len(c.lower()) == 1 else c) if c.isalnum() else " " for c in text or ""]
    found = set()
    for n in toxicity.ORDERS:
        for i in range(len(folded) - n + 1):
            key = sum((ord(c) + 1) * pow(toxicity._BASE, j, 1 << 64) for j, c in enumerate(folded[i : i + n])) + n & mask
            key = key * toxicity._SPREAD & mask
            key = (key ^ key >> 32) * toxicity._SPREAD & mask
            found.add(int(model.table[key >> 64 - toxicity.BUCKET_BITS]))
    z = model.bias + sum(model.weight[f] for f in found if f >= 0)
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_quality_scores(tables):
    docs, labels = tables
    model = quality.learn(docs, labels, ~quality.held_out(F.col("doc_id")))
    assert model.pairs
    some = docs.where("doc_id % 5 = 0 or length(text) > 20000")
    odd = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.explode(F.array(F.lit(None).cast("string"), F.lit(""), F.lit(" \n\t"), F.lit("É日本 a\n\na"))).alias("text"))
    for r in quality.scored(some.unionByName(odd), model).collect():
        assert r["score"] == pytest.approx(plain_quality(model, r["text"]), abs=1e-9)


def test_toxicity_scores(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id % 40 = 0 and length(text) < 20000").collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    for i, text in texts.items():
        assert got[i] == pytest.approx(plain_toxicity(model, text), abs=1e-9)


@pytest.mark.parametrize("module, label, right, found", [(quality, "quality", 0.99, 0.95), (toxicity, "toxic", 0.97, 0.8)])
def test_held_out(tables, module, label, right, found):
    """Share of held-out rows that are right, and of either class that is found."""
    docs, labels = tables
    rows = module.classify(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    hit = lambda y: sum(r["predicted"] == y for r in rows if r["y"] == y) / sum(r["y"] == y for r in rows)
    assert len(rows) > 500 and sum(r["predicted"] == r["y"] for r in rows) >= right * len(rows) and min(hit(0), hit(1)) >= found


def test_labels_of_held_out_rows_do_not_count(tables):
    docs, labels = tables
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        docs_few = docs.where("doc_id % 10 < 3")
        other = labels.withColumn(label, F.when(module.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
        one, two = ({r["doc_id"]: r["score"] for r in module.classify(docs_few, x).collect()} for x in (labels, other))
        assert one == two


def test_repeated_rows_are_learnt_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(2, "c d"), (2, "e f"), (3, "g")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    from tessera.llm.labelled import sample

    assert sorted(map(tuple, sample(docs, labels, "quality", F.lit(True), 10).collect())) == [("a b", 1), ("c d", 1), ("e f", 1), ("g", 0)]
    assert sample(docs, labels, "quality", F.lit(True), 2).count() == 2
