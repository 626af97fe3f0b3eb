"""The pipeline and the registered queries, against SQL where there is some."""

import hashlib
import math
import random
import re

import pytest

from tessera.plans.shared import kept
from tests.conftest import DATA, rows_of


def test_queries_match_sql(spark, duck):
    from tessera.llm.queries import queries
    from tessera.llm.queries_sql import oracle_sql

    for name, sql in oracle_sql().items():
        assert rows_of(queries()[name](spark, DATA).toPandas()) == rows_of(duck.execute(sql).df()), name


def test_stages_against_plain_versions(spark):
    import corpus_pipeline as C
    from tests.llm.test_edges import brute_components, brute_passages

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one = C.quality_classifier(spark, docs, DATA)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sum(marks[i] == 1 for i in texts if i in marks) >= 0.95 * sum(marks.values())
    two = {r["doc_id"] for r in C.near_duplicates(spark, one, DATA).collect()}
    assert two == {i for i, (n, c) in brute_components(list(texts.items())).items() if i == c}
    kept = one.where(one["doc_id"].isin(*two))
    three = {r["doc_id"]: r["text"] for r in C.substring_dedup(spark, kept, DATA).collect()}
    plain = brute_passages([(i, texts[i]) for i in two])
    assert {i: " ".join(t.split()) for i, t in three.items()} == {i: t for i, t in plain.items() if t}
    four = C.decontamination(spark, kept, DATA)
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert four.columns == C.COLUMNS == kept.columns
    assert {r["doc_id"] for r in four.collect()} == {i for i in two if not plain_hit(texts[i], items)} != two
    five = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in C.source_mix(spark, four, DATA).collect()}
    assert five == plain_mix([(r["doc_id"], r["text"], r["source"]) for r in four.collect()])


def plain_hit(text, items, k=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w = words(text)
    for item in items:
        x = words(item)
        n = min(len(x), k)
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in wins for i in range(len(w) - n + 1)):
            return True
    return False


def plain_mix(rows):
    """Targets by repeated sharing of what exceeds a limit; a source's rows in the order of their hash as far as the budget goes."""
    size = {i: len(re.findall("[^ \t-\r]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    full, budget = {}, 1.5 * sum(total.values())
    while True:
        rest = [s for s in sources if s not in full]
        share = {s: (budget - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * total[s]]
        if not over:
            break
        full |= {s: 2.0 * total[s] for s in over}
    target = full | share
    out = {}
    for s in sources:
        times = int(target[s] // total[s]) if total[s] else 0
        left = target[s] - times * total[s]
        for i in sorted((i for i, _, x in rows if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            left -= size[i]
            out[i] = (size[i], total[s], pytest.approx(target[s], rel=1e-9), size[i] * (times + (left >= 0)))
            left = left if left >= 0 else -math.inf
    return out


def test_stages_of_empty_tables(spark):
    import corpus_pipeline as C

    nothing = spark.createDataFrame([], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in C.STAGES:
        assert stage(spark, nothing, DATA).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(5)
    prose = [w for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 400 and 900").limit(20).collect() for w in r["text"].split()]
    text = lambda n: " ".join(rnd.choice(prose) for _ in range(n))
    a, b, long = text(40), text(40), text(30_000)
    rows = [(None, None, None, None, None), (None, a, "en", "s", 1), (1, "", None, "s", 0), (2, "a b", "en", None, 3), (2, "a b", "en", None, 3), (3, None, "en", "s", None), (4, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (7, b, "en", "s", 1), (8, long, "en", "t", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("id", "row", "size", "hash", "_row", "_id", "_th", "a", "b", "n_words", "component", "group"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df, rows


def test_stages_of_odd_tables(spark, odd):
    """Nulls, empty, long and repeated texts, ids that repeat, clashing columns: what each stage keeps."""
    import corpus_pipeline as C

    docs, rows = odd
    pick = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    every = sorted((r[:2] for r in rows), key=str)
    a, b, long = rows[1][1], rows[9][1], rows[10][1]
    assert set(pick(C.quality_classifier(spark, docs, DATA))) <= set(every)
    near = pick(C.near_duplicates(spark, docs, DATA))
    assert near == sorted([(None, None), (None, a), (1, ""), (2, "a b"), (3, None), (4, a), (5, b), (8, long)], key=str)
    cut = pick(C.substring_dedup(spark, docs, DATA))
    assert cut == sorted([r for r in every if r not in ((5, a), (7, b))], key=str)
    assert pick(C.decontamination(spark, docs, DATA)) == every
    mixed = C.source_mix(spark, docs, DATA).collect()
    assert len(mixed) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    assert {r["taken"] for r in mixed if not r["size"]} == {0}


def test_run(spark):
    import corpus_pipeline as C

    out, docs = C.run(spark, DATA), spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in C.STAGES:
        docs = kept(stage(spark, docs, DATA))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str) and {"doc_id", "size", "taken"} <= set(out.columns)
