"""Chat formatting by columnar byte assembly.

Rows of conversations are put in order over the whole table (so one conversation may lie in many tasks). For a chunk of rows
all segment lengths are known from the Arrow offsets; their running sum says where each header, role and text goes, and the
bytes are scattered into one Arrow buffer that is allocated once. A row of the result is a piece: consecutive turns of one
conversation, with the byte spans that a loss may see.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import chunks, ranges, strings

#: The template's control strings: fixed values.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: A control string inside a text, with any number of backslashes: escaping adds one, reading back takes one away.
CONTROL = r"<\|(\\*)(im_start|im_end)\|>"
ESCAPED = r"<\|\\(\\*)(im_start|im_end)\|>"
_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def escape(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(col, CONTROL, r"<|\\\1\2|>")


def unescape(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(col, ESCAPED, r"<|\1\2|>")


def escape_role(col: pa.Array) -> pa.Array:
    for a, b in _ROLE:
        col = pc.replace_substring(col, a, b)
    return col


def unescape_role(role: str) -> str:
    for a, b in reversed(_ROLE):
        role = role.replace(b, a)
    return role


def assemble(role: pa.Array, text: pa.Array, learned: str = LEARNED) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows, each row's offsets in these (n + 1), and begin and end of each row's loss span."""
    is_learned = pc.fill_null(pc.equal(role, learned), False).to_numpy(zero_copy_only=False)
    r_buf, r_off = strings(escape_role(role))
    t_buf, t_off = strings(escape(text))
    parts = [np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END + "\n")]
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    off = np.concatenate(([0], np.cumsum(r_len + t_len + sum(map(len, parts)))))
    r_at = off[:-1] + len(parts[0])
    t_at = r_at + r_len + len(parts[1])
    buffer = pa.allocate_buffer(int(off[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for at, part in zip((off[:-1], r_at + r_len, t_at + t_len), parts, strict=True):
        out[at[:, None] + np.arange(len(part))] = part
    out[ranges(r_at, r_len)] = r_buf
    out[ranges(t_at, t_len)] = t_buf
    return buffer, off, t_at[is_learned], (t_at + t_len)[is_learned]


def format_chats(rows: DataFrame, learned: str = LEARNED) -> DataFrame:
    """conversations (conv_id, turn, role, text) to pieces: conv_id, part, seq, n_turns, formatted, loss_spans.

    A conversation's pieces in order of part and seq, joined, are its formatted text; loss_spans are byte spans [start, end) of
    the piece that hold the texts of role ``learned`` alone. Turns stand in order of turn (null first), then role, then a hash of
    the text; repeated rows are all kept. Null roles and texts are empty; rows without a conv_id are one conversation. An empty
    table gives an empty result. Other columns are left aside.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    src = rows.select("conv_id", "turn", text("role"), text("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    src = src.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    key = src.schema["conv_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("conv_id", key), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text"):
            conv = batch.column(0)
            buffer, off, begin, end = assemble(batch.column(1), batch.column(2), learned)
            n = batch.num_rows
            codes = pc.rank(conv, tiebreaker="dense").to_numpy(zero_copy_only=False) if n else np.zeros(0)
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if n else np.zeros(0, np.int64)
            edges = np.append(first, n)
            at = off[edges]
            formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int64)), buffer).cast(pa.string())
            piece = np.searchsorted(at, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(begin - at[piece], pa.int64()), pa.array(end - at[piece], pa.int64())], ["start", "end"])
            cut = np.searchsorted(piece, np.arange(len(first) + 1))
            k = len(first)
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(first)), pa.array(np.full(k, part), pa.int64()), pa.array(np.arange(seq, seq + k), pa.int64()), pa.array(np.diff(edges), pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)],
                [f.name for f in schema],
            )
            seq += k

    return src.mapInArrow(run, schema)


def turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    parts = formatted.split(END + "\n")
    if parts.pop():
        raise ValueError("formatted text ends inside a turn")
    heads, texts = zip(*(p.split("\n", 1) for p in parts), strict=True) if parts else ((), ())
    if not all(h.startswith(START) for h in heads):
        raise ValueError("a turn has no head")
    return list(zip((unescape_role(h.removeprefix(START)) for h in heads), unescape(pa.array(texts, pa.string())).to_pylist(), strict=True))


def read_back(pieces: DataFrame) -> DataFrame:
    """Pieces to one row for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, newline, text, newline of each turn; loss_sha256 of all text under the loss spans. A conversation's
    pieces pass through one running digest, so its length does not matter to memory.
    """
    src = pieces.select("conv_id", "part", "seq", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    key = src.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done, kind = None, [], None

        def row():
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def table() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for i in range(batch.num_rows):
                conv, formatted, spans = (batch.column(j)[i].as_py() for j in (0, 3, 4))
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                raw = formatted.encode()
                seen = "".join(unescape(pa.array([raw[s["start"] : s["end"]].decode() for s in spans], pa.string())).to_pylist())
                state[3] += len(seen)
                state[4].update(seen.encode())
                state[5] += len(formatted)
            if len(done) >= 1000:
                yield table()
                done = []
        if state is not None:
            done.append(row())
        if done:
            yield table()

    return src.mapInArrow(run, schema)
