"""Thresholds that follow each source's own texts."""

import random

import pytest

from tessera.llm import rules
from tests.conftest import DATA

KIND = "doc_id long, text string, lang string, source string"
WORDS = "of in to the a at stone river cloud maple under quiet window garden copper silver" .split()


def prose(rnd, n=120):
    return [w.capitalize() if not i % 9 else w + "." if i % 9 == 8 else w for i, w in enumerate(rnd.choice(WORDS) + (str(rnd.randint(0, 400)) if rnd.random() < 0.5 else "") for _ in range(n))]


def code(rnd, n=120):
    return [w + rnd.choice(("();", " = [0];", "{}", "")) for w in prose(rnd, n)]


ODD = {
    "punctuation": lambda w: [x + "!?;" * 4 for x in w],
    "upper": lambda w: [x.upper() for x in w],
    "short_words": lambda w: [x[:3] for x in w],
    "word_len": lambda w: [x + "ish" * 9 if len(x) > 3 else x for x in w],
    "distinct": lambda w: [("tall " * 7 + x).split()[i % 8] if i % 8 < 6 else x for i, x in enumerate(w)],
}


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(prose(rnd)), "en", "prose") for i in range(300)] + [(i, " ".join(code(rnd)), "en", "code") for i in range(300, 600)]
    rows += [(1000 + k, " ".join(f(prose(rnd))), "en", "prose") for k, f in enumerate(ODD.values())]
    rows += [(1100, " ".join(code(rnd)), "en", "prose")] + [(1200 + i, " ".join(code(rnd)), "en", "tiny") for i in range(3)]
    return {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, KIND)).collect()}


def test_thresholds_follow_the_source(judged):
    a, b = judged[0], judged[300]
    assert all(a[f"t_{m}"] != b[f"t_{m}"] for m in ("punctuation", "word_len")) and a["t_punctuation"] < b["t_punctuation"]
    # What is usual in one source is not in the other; and ordinary rows of both stay.
    assert not judged[1100]["kept"] and sum(judged[i]["kept"] for i in range(600)) >= 597


def test_each_metric_rejects(judged):
    for k, m in enumerate(ODD):
        r = judged[1000 + k]
        value = r[f"m_{m}"]
        beyond = m in rules.HIGH_SIDE and value > r[f"t_{m}"] or m in rules.LOW_SIDE and value < r[f"l_{m}"]
        assert not r["base_failed"] and not r["kept"] and beyond, m


def test_few_rows_lean_on_their_language(judged):
    """Three rows move a threshold a little only: it is near that of the whole language, not their own."""
    tiny, own = judged[1200]["t_punctuation"], judged[300]["t_punctuation"]
    assert tiny != own and tiny > judged[0]["t_punctuation"]


def test_labelled_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    got = rules.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert (1, False) not in n and n[1, True] > 100 and n[0, False] > n.get((0, True), 0)
