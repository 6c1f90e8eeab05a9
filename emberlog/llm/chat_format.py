"""Chat formatting by columnar byte assembly.

A batch of turns is one preallocated buffer: lengths of all segments, their
cumulative offsets, and scatter indices from them, are numpy arrays, and headers
and contents are copied into place as whole columns.

A turn reads ``### role: text</turn>`` and a newline.  In texts and roles a
backslash is doubled, and one is put before ``### ``, ``</turn>`` and, in roles,
a colon; so an unescaped mark is always a real one and the output reads back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BEGIN, AFTER_ROLE, END = b"### ", b": ", b"</turn>\n"
TRAINED_ROLE = "assistant"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_begin array<long>, loss_end array<long>"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(\\|### |</turn>|:)")


def escaped(column: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", "### ", "</turn>", *([":"] if role else [])):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def _contents(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and the bytes of all values, one after the other."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if not lengths.sum():
        return lengths, np.empty(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :]
    return lengths, np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[0] + lengths.sum()]


def assembled(turns: pa.Table) -> pa.RecordBatch:
    """One row per conversation of ``turns``, which come by conversation and turn."""
    turns = turns.combine_chunks()
    ids = turns["conv_id"].combine_chunks() if turns.num_rows else turns["conv_id"]
    plain = [pc.fill_null(turns[c].combine_chunks().cast(pa.large_string()), "") for c in ("role", "text")]
    role, text = escaped(plain[0], role=True), escaped(plain[1])
    role_n, role_bytes = _contents(role)
    text_n, text_bytes = _contents(text)
    marks = len(BEGIN) + len(AFTER_ROLE) + len(END)
    turn_n = role_n + text_n + marks
    turn_at = np.cumsum(turn_n) - turn_n
    out = np.empty(int(turn_n.sum()), np.uint8)
    role_at, text_at = turn_at + len(BEGIN), turn_at + len(BEGIN) + role_n + len(AFTER_ROLE)
    for mark, at in ((BEGIN, turn_at), (AFTER_ROLE, role_at + role_n), (END, text_at + text_n)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    for lengths, data, at in ((role_n, role_bytes, role_at), (text_n, text_bytes, text_at)):
        out[np.arange(len(data)) + np.repeat(at - (np.cumsum(lengths) - lengths), lengths)] = data

    first = np.flatnonzero(_changes(ids))
    ends = np.append(turn_at[first[1:]], len(out))
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    formatted = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    # the loss mask counts code points
    role_c, text_c = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (role, text))
    turn_c = role_c + text_c + marks
    char_at = np.cumsum(turn_c) - turn_c
    in_conv = np.cumsum(_changes(ids)) - 1
    begin = char_at - char_at[first][in_conv] + len(BEGIN) + role_c + len(AFTER_ROLE)
    trained = pc.equal(plain[0], TRAINED_ROLE).to_numpy(zero_copy_only=False)
    counts = np.bincount(in_conv[trained], minlength=len(first))
    at = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x[trained])) for x in (begin, begin + text_c)]
    n_turns = np.diff(np.append(first, len(in_conv)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(n_turns.astype(np.int64)), formatted, *lists], ["conv_id", "n_turns", "formatted", "loss_begin", "loss_end"])


def _changes(ids: pa.Array) -> np.ndarray:
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([True], (value[1:] != value[:-1]) | (null[1:] != null[:-1])))


def formatted_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as they are complete; only the last of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = _changes(batch.column("conv_id"))
        if waiting:
            change[0] = waiting[-1].column("conv_id")[-1].as_py() != batch.column("conv_id")[0].as_py()
        last = np.flatnonzero(change)
        if not len(last):
            waiting.append(batch)
            continue
        done = [*waiting, batch.slice(0, int(last[-1]))]
        if any(b.num_rows for b in done):
            yield assembled(pa.Table.from_batches(done))
        waiting = [batch.slice(int(last[-1]))]
    if waiting:
        yield assembled(pa.Table.from_batches(waiting))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, n_turns, formatted, loss_begin, loss_end`` per conversation.

    ``loss_begin`` and ``loss_end`` are the ranges, in code points of
    ``formatted``, of the texts of assistant turns.

    Turns come by number, null first; equal numbers by role and then text, so
    repeated rows are repeated turns.  A null role or text is empty.  Rows with a
    null conv_id are one conversation.  Extra columns are not read; an empty table
    gives no rows.  A conversation must fit in one string of 2 GB.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(formatted_batches, FORMATTED)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")

    @F.pandas_udf("turns long, turns_sha256 string, loss_chars long, loss_sha256 string")
    def digest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, begins, ends in batches:
            rows = []
            for whole, begin, end in zip(texts, begins, ends):
                turns = read_back(whole)
                loss = "".join(unescaped(whole[b:e]) for b, e in zip(begin, end))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), _sha(said), len(loss), _sha(loss)))
            yield pd.DataFrame(rows, columns=["turns", "turns_sha256", "loss_chars", "loss_sha256"])

    out = format_chats(turns.unionByName(extra))
    out = out.select("conv_id", digest("formatted", "loss_begin", "loss_end").alias("d"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", F.col("d.turns").alias("n_turns"), "d.turns_sha256", "d.loss_chars", "d.loss_sha256", "formatted_chars")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS t,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') AS r
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(t) + 14)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
