"""Exact token counts of every prefix of a text, by dynamic programming over the tokenizer's vocabulary.

For byte-pair merges ranked by score, the tokens of a prefix are the tokens of a shorter prefix and one more piece, and only
one piece that ends there fits: one that the tokenizer would not have merged with the piece before it. So one pass over the
code points gives each prefix its count and its last piece. Spaces begin a segment and no piece crosses from one segment into
the next, so the pass runs over a chunk's distinct segments only, all of one length step at once, and every text's prefix
counts are the running sum over its segments. Truncation and budget questions are then look-ups (``tokens_at``, ``cut``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .flat import NOT_WHITE, chunks, hash_words, mix, ranges, row_sums, strings, words

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
_SLOTS, _PAIRS = 18, 21
_TRY = (2, 3, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
#: Longer segments are taken one by one, so that a chunk's table stays small.
_WIDE = 96


class Pieces:
    """The vocabulary of a sentencepiece model of merged pieces, with the prefix counts of segments."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.text.items()}
        self.most = max(map(len, self.ids))
        self.base = np.multiply.accumulate(np.array([1] + [_BASE] * (_WIDE + 1), np.uint64))
        self.back = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * (_WIDE + 1), np.uint64))
        self.slot_key, self.slot_id = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for piece, i in self.ids.items():
            cps = np.array([*map(ord, piece)], np.uint64) + np.uint64(1)
            key = mix(np.array([(cps * self.base[: len(cps)]).sum(dtype=np.uint64)]))[0]
            at, n = int(key) >> (64 - _SLOTS), 1
            while self.slot_id[at] >= 0:
                at, n = (at + 1) % (1 << _SLOTS), n + 1
            self.slot_key[at], self.slot_id[at], self.probes = key, i, max(self.probes, n)
        # Answers to "does this piece stay as it is after that one": what a slot held is worked out anew when it is asked again.
        self.pair_key, self.pair_fits = np.full(1 << _PAIRS, -1, np.int64), np.zeros(1 << _PAIRS, bool)
        self.blanks = np.zeros(0, np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        at = (key >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = np.where(self.slot_key[at] == key, self.slot_id[at], np.int32(-1))
        for n in range(1, self.probes):
            rest = np.flatnonzero((out < 0) & (self.slot_id[at] >= 0))
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) % (1 << _SLOTS)
            out[rest] = np.where(self.slot_key[at[rest]] == key[rest], self.slot_id[at[rest]], np.int32(-1))
        return out

    def encode(self, left: str, right: str) -> list[str]:
        """What is to be encoded so that it begins with left, and how many ids of that come before."""
        return left[1:] + right if left.startswith(SPACE) else "\n" + left + right

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokenizer keeps each pair of pieces apart. A piece of -1 (bytes) never merges."""
        out = np.ones(len(left), bool)
        real = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[real].astype(np.int64) << 20 | right[real]
        slot = (key.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - _PAIRS)).astype(np.int64)
        new = np.unique(key[self.pair_key[slot] != key])
        fits = self.pair_fits[slot]
        if len(new):
            names = [(self.text[k >> 20], self.text[k & 0xFFFFF], k >> 20, k & 0xFFFFF) for k in new.tolist()]
            got = self.sp.encode([self.encode(a, b) for a, b, _, _ in names], num_threads=1)
            answers = np.array([ids[0 if a.startswith(SPACE) else 2 :] == [i, j] for (a, _, i, j), ids in zip(names, got, strict=True)])
            asked = np.searchsorted(new, key)
            fresh = (asked < len(new)) & (new[np.minimum(asked, len(new) - 1)] == key)
            fits = np.where(fresh, answers[np.minimum(asked, len(new) - 1)], fits)
            where = (new.astype(np.uint64) * np.uint64(_BASE) >> np.uint64(64 - _PAIRS)).astype(np.int64)
            self.pair_key[where] = new
            kept = self.pair_key[where] == new
            self.pair_fits[where[kept]] = answers[kept]
        out[real] = fits
        return out

    def table(self, cps: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Differences of the prefix counts of each segment cps[off[i]:off[i+1]], in one array like cps."""
        out = np.zeros(len(cps), np.int32)
        length = np.diff(off)
        order = np.argsort(-length, kind="stable")
        for i in order[: int((length > _WIDE).sum())]:
            out[off[i] : off[i + 1]] = self.one("".join(map(chr, cps[off[i] : off[i + 1]].tolist())))
        order = order[int((length > _WIDE).sum()) :]
        begin = 0
        while begin < len(order):  # segments of like lengths share a table
            widest = int(length[order[begin]])
            end = begin + int(np.searchsorted(-length[order[begin:]], -(widest // 2), "right")) if widest > 8 else len(order)
            rows = order[begin : max(end, begin + 1)]
            self._steps(cps, off, rows, length[rows], out)
            begin += len(rows)
        return out

    def _steps(self, cps, off, rows, length, out) -> None:
        widest = int(length[0]) if len(length) else 0
        if not widest:
            return
        n = len(rows)
        at = off[rows][:, None] + np.arange(widest)
        total = np.zeros((widest + 1, n), np.uint64)
        chars = cps[np.minimum(at, len(cps) - 1)].T.astype(np.uint64)
        np.cumsum((chars + np.uint64(1)) * self.base[:widest, None], axis=0, out=total[1:])
        count, last = np.zeros((widest + 1, n), np.int32), np.full((widest + 1, n), -1, np.int32)
        for i in range(1, widest + 1):
            left = np.arange(int(np.searchsorted(-length, -i, "right")))
            for size in _TRY:
                if not len(left) or size > min(i, self.most):
                    continue
                piece = self.find(mix((total[i, left] - total[i - size, left]) * self.back[i - size]))
                maybe = np.flatnonzero(piece >= 0)
                if i > size and len(maybe):
                    maybe = maybe[self.fits(last[i - size, left[maybe]], piece[maybe])]
                hit = left[maybe]
                last[i, hit] = piece[maybe]
                count[i, hit] = count[i - size, hit] + 1
                still = np.ones(len(left), bool)
                still[maybe] = False
                left = left[still]
            if len(left):  # no piece has this character: it is written as its UTF-8 bytes
                c = chars[i - 1, left]
                count[i, left] = count[i - 1, left] + 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        change = np.diff(count, axis=0).T
        inside = np.arange(widest) < length[:, None]
        out[at[inside]] = change[inside]

    def one(self, segment: str) -> np.ndarray:
        """The same for one long segment, in plain steps."""
        count, last = [0], [-1]
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, len(segment) + 1):
            for size in range(min(i, self.most), 0, -1):
                piece = self.ids.get(segment[i - size : i])
                if piece is None:
                    continue
                before = last[i - size]
                if i > size and before >= 0:
                    ok = known.get((before, piece))
                    if ok is None:
                        ok = known[before, piece] = bool(self.fits(np.array([before]), np.array([piece]))[0])
                    if not ok:
                        continue
                count.append(count[i - size] + 1)
                last.append(piece)
                break
            else:
                count.append(count[-1] + len(segment[i - 1].encode()))
                last.append(-1)
        return np.diff(np.array(count, np.int32))

    def blank(self, n: int) -> np.ndarray:
        """The same for n spaces. A longer run's differences begin with those of a shorter one."""
        if n > len(self.blanks):
            self.blanks = self.one(SPACE * (2 * n))
        return self.blanks[:n]

    def deltas(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For all code points of all rows: by how much each changes its row's count; and where each row begins (n + 1)."""
        buf, off = strings(col)
        starts, ends, word_off = words(buf, off, NOT_WHITE)
        lead = (buf & 0xC0) != 0x80
        cp_at = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(lead, out=cp_at[1:])
        rows = cp_at[off]
        out = np.zeros(int(rows[-1]), np.int32)
        gap_byte = ~NOT_WHITE[buf]
        out[cp_at[:-1][gap_byte & (buf != 0x20)]] = 1
        # Spaces before each word, and whether the text begins with them (the tokenizer puts one before a text).
        before = np.zeros(len(starts), np.int64)
        row_of = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
        room = starts - off[row_of]
        more = np.flatnonzero((room > 0) & (buf[np.maximum(starts - 1, 0)] == 0x20))
        while len(more):
            before[more] += 1
            at = starts[more] - 1 - before[more]
            more = more[(before[more] < room[more]) & (buf[np.maximum(at, 0)] == 0x20)]
        opens = before == room
        spaces = before + opens
        # Spaces that no word follows.
        is_space = buf == 0x20
        nxt = np.zeros(len(buf), bool)
        nxt[:-1] = is_space[1:] | NOT_WHITE[buf[1:]]
        stop = off[1:][off[1:] > 0] - 1
        nxt[stop] = False
        for e in np.flatnonzero(is_space & ~nxt).tolist():
            row = int(np.searchsorted(off, e, "right")) - 1
            s = e
            while s > off[row] and is_space[s - 1]:
                s -= 1
            at_start = s == off[row]
            self._put(out, int(cp_at[s]), self.blank(e - s + 1 + at_start), at_start)
        # A text that begins with other white space: the tokenizer's own space is a token.
        other = off[:-1][(off[1:] > off[:-1])]
        other = other[gap_byte[other] & ~is_space[other]]
        out[cp_at[other]] += 1
        if not len(starts):
            return out, rows
        # Pieces of spaces only rank below all others and no piece has a space after another character or two before one, so a
        # word and its spaces are one segment like any other.
        h = hash_words(buf, starts, ends) + spaces.astype(np.uint64) * np.uint64(_BASE)
        _, first, uid = np.unique(h, return_index=True, return_inverse=True)
        s, e, k = starts[first], ends[first], spaces[first]
        joined = bytes(buf[ranges(s, e - s)]).decode()
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = cp_at[e] - cp_at[s]
        u_off = np.concatenate(([0], np.cumsum(size + k)))
        seg = np.full(int(u_off[-1]), ord(SPACE), np.int64)
        seg[ranges(u_off[:-1] + k, size)] = cps
        d = self.table(seg, u_off)
        # Where a text opens, the segment's first space is not in it.
        to, n = cp_at[starts] - before, (size + k)[uid] - opens
        out[ranges(to, n)] = d[ranges(u_off[:-1][uid] + opens, n)]
        out[to[opens]] += d[u_off[:-1][uid][opens]]
        return out, rows

    @staticmethod
    def _put(out: np.ndarray, at: int, d: np.ndarray, unseen: bool) -> None:
        """Write d at ``at``; unseen: its first space is not in the text, so it counts with the first character."""
        if unseen:
            d = np.concatenate(([d[0] + d[1]], d[2:])) if len(d) > 1 else d[:0]
        out[at : at + len(d)] = d


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def packed(change: np.ndarray, rows: np.ndarray) -> pa.Array:
    """A row's changes as signed bytes; one that does not fit a byte (never met: a token has few bytes) is an error."""
    small = change.astype(np.int8)
    if not np.array_equal(small, change):
        raise ValueError("a prefix count changes by more than a byte holds")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(small)])


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs to id, n_bytes (UTF-8), n_tokens and prefix_deltas: a signed byte for each code point, whose running sum is the
    exact token count of every prefix of the text (see ``tokens_at`` and ``cut``).

    model: path of a sentencepiece model, by which every executor can read it. Null and empty texts have no bytes and no tokens.
    Ids may be null or repeat: every row gives one row. Other columns are left aside.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    key = src.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, key), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_deltas", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pieces(model)
        for batch in chunks(batches, "text"):
            col = batch.column(1)
            size = np.diff(strings(col)[1])
            if pc.any(pc.match_substring(col, SPACE)).as_py():
                col = pc.replace_substring(col, SPACE, " ")  # the tokenizer's own sign for a space
            change, rows = counter.deltas(col)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(row_sums(change, rows), pa.int64()), packed(change, rows).cast(pa.binary())], [id_col, "n_bytes", "n_tokens", "prefix_deltas"])

    return src.mapInArrow(run, schema)


def tokens_at(prefix_deltas: bytes, code_points: int) -> int:
    """Tokens of the text's first so many code points."""
    return int(np.frombuffer(prefix_deltas, np.int8)[:code_points].sum(dtype=np.int64))


def cut(prefix_deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix of no more than ``budget`` tokens."""
    return int(np.max(np.flatnonzero(np.concatenate(([0], np.cumsum(np.frombuffer(prefix_deltas, np.int8), dtype=np.int64))) <= budget), initial=0))
