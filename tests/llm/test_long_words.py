"""Token counts of long words after several spaces."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import tokens


@pytest.fixture(scope="module")
def pieces():
    return tokens.pieces(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", ["a  {}", " {}", "   {}", "{}   ", "a\n        {} b"])
def test_long_word_takes_linear_memory(pieces, text):
    rnd = random.Random(5)
    text = text.format("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(6000)))
    asked, kept = [], pieces.sp
    pieces.sp = type("Counted", (), {"encode": lambda _, x, **o: asked.extend(x) or kept.encode(x, **o)})()
    tracemalloc.start()
    try:
        d, _ = pieces.deltas(pa.array([text]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pieces.sp = kept
    assert max(map(len, asked), default=0) <= 2 * pieces.most + 1 and most < 50e6
    for i in [1, 2, 3, 9, 10, 11, *range(50, len(text), 500), len(text)]:
        assert d[:i].sum() == len(kept.encode(text[:i]))


def test_runs_of_spaces(pieces):
    rnd = random.Random(8)
    texts = [" " * n for n in range(1, 120)] + ["a" + " " * n + "\n" for n in (1, 2, 15, 40, 1000)]
    texts += ["".join(rnd.choice(("  ", " " * rnd.randint(1, 40), "the", "zq", "É", "日本", "é=", "-", "\t", "0x1F")) for _ in range(8)) for _ in range(400)]
    d, rows = pieces.deltas(pa.array(texts))
    for n, t in enumerate(texts):
        assert np.cumsum(d[rows[n] : rows[n + 1]]).tolist() == [len(pieces.sp.encode(t[: i + 1])) for i in range(len(t))]
