"""Chat formatting by columnar byte assembly.

The turns of a batch become one text buffer per batch: for each turn a header (turn mark, role, line end), its content and a
footer. The lengths of all segments give the cumulative offsets; numpy index arrays then scatter constants, roles and
contents into one preallocated buffer that Arrow takes as it is. Contents are escaped, so that no control string of this or
other common templates stands in them, and the escape can be undone. Assistant contents are under the loss mask, as spans of
code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import BLOCK_BYTES, utf8

OPEN, MID, CLOSE = "<|turn|>", "\n", "<|end|>\n"
LOSS_ROLE = "assistant"
#: Control strings after their first character, which is < or [ for all of them: this template's and other common ones.
_TAILS = r"(?:\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>)"
_CONTROL = re.compile(r"([<\[])(\\*)(?=" + _TAILS + ")")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=" + _TAILS + ")")


def escape(text: str) -> str:
    """One backslash after the first character of each control string, with or without others there already."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _clean(arr: pa.Array, role: bool) -> pa.Array:
    """Escaped texts (null: empty); only rows that need it pass through Python."""
    arr = arr.cast(pa.large_string()).fill_null("")
    need = pc.match_substring_regex(arr, r"[\\\n<\[]" if role else r"[<\[]\\*" + _TAILS)
    if pc.any(need).as_py():
        f = _escape_role if role else escape
        arr = pa.array([f(x) if n else x for x, n in zip(arr.to_pylist(), need.to_pylist())], pa.large_string())
    return arr


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment i of source (offsets[i] to offsets[i + 1]) to out[at[i]:], a bounded number of bytes at a time."""
    size = np.diff(offsets)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, side="right")) - 1)
        n = size[a:b]
        if b == a + 1:
            out[at[a] : at[a] + n[0]] = source[offsets[a] : offsets[b]]
        else:
            to = np.arange(n.sum()) + np.repeat(at[a:b] - (offsets[a:b] - offsets[a]), n)
            out[to] = source[offsets[a] : offsets[b]]
        a = b


def assemble(first: np.ndarray, role: pa.Array, text: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """Formats a batch of turns. first: the row at which each conversation starts. Returns the formatted texts, and the
    code-point spans (n, 2) under the loss mask of each."""
    n = len(role)
    r_off, r_data = utf8(_clean(role, True))
    t_off, t_data = utf8(_clean(text, False))
    open_, mid, close = (np.frombuffer(x.encode(), np.uint8) for x in (OPEN, MID, CLOSE))
    r_len, t_len = np.diff(r_off), np.diff(t_off)
    turn = len(open_) + r_len + len(mid) + t_len + len(close)
    start = np.concatenate([[0], np.cumsum(turn)])
    out = np.empty(int(start[-1]), np.uint8)
    for shift, const in ((np.zeros(n, np.int64), open_), (len(open_) + r_len, mid), (turn - len(close), close)):
        out[(start[:-1] + shift)[:, None] + np.arange(len(const))] = const
    _scatter(out, start[:-1] + len(open_), r_data, r_off)
    content = start[:-1] + len(open_) + r_len + len(mid)
    _scatter(out, content, t_data, t_off)
    bounds = start[np.concatenate([first, [n]])]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    # Code points before a byte: bytes that don't continue a character.
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    loss = np.array([x == LOSS_ROLE for x in role.to_pylist()], bool)
    conv = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [n]])))
    base = points[bounds[:-1]][conv]
    spans = np.stack([points[content] - base, points[content + t_len] - base], 1)
    return formatted, _split(spans[loss], conv[loss], len(first))


def _split(spans: np.ndarray, conv: np.ndarray, n: int) -> list[np.ndarray]:
    cut = np.searchsorted(conv, np.arange(n + 1))
    return [spans[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, role, text) -> (conv_id, formatted, loss). The last conversation of a batch waits for the next."""

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        conv = t.column("conv_id")
        null = np.asarray(conv.is_null())
        key = conv.fill_null(0).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
        role, text = (t.column(c).chunk(0) if t.column(c).num_chunks else pa.array([], pa.string()) for c in ("role", "text"))
        formatted, spans = assemble(first, role, text)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        loss = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], kind)
        return pa.RecordBatch.from_arrays([conv.take(pa.array(first)).combine_chunks(), formatted.cast(pa.string()), loss], names=["conv_id", "formatted", "loss"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        last = t.column("conv_id")[-1].as_py()
        conv = batch.column(0)
        other = pc.invert(pc.is_null(conv)) if last is None else pc.fill_null(pc.not_equal(conv, last), True)
        tail = np.flatnonzero(np.asarray(other))
        if not len(tail):
            continue  # all of this batch belongs to a conversation that may go on
        cut = t.num_rows - batch.num_rows + int(tail[-1]) + 1
        yield done(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (code-point spans of assistant contents in formatted).

    Rows of one conversation go by turn (null first), then role and text, so ties have a fixed order; repeated rows are
    repeated turns. Null roles and texts are empty; rows with a null conversation id are one conversation. Other columns
    are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format, "conv_id long, formatted string, loss array<struct<start:int,end:int>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        line = formatted.index(MID, at)
        end = formatted.index(CLOSE, line + 1)
        out.append((_unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE)
    return out


def _digests(formatted: pa.Array, loss: pa.Array) -> pa.Array:
    rows = []
    for text, spans in zip(formatted.to_pylist(), loss.to_pylist()):
        turns = read_turns(text)
        body = "".join(f"{r}\n{t}\n" for r, t in turns)
        masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        rows.append({"n_turns": len(turns), "turns_sha256": hashlib.sha256(body.encode()).hexdigest(), "loss_chars": len(masked), "loss_sha256": hashlib.sha256(masked.encode()).hexdigest(), "formatted_chars": len(text)})
    return pa.array(rows, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def _digest_column(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for formatted, loss in columns:
        yield _digests(formatted, loss)


#: The conversation that the query adds: control strings of another template as plain text.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def report(turns: DataFrame) -> DataFrame:
    """Formats all conversations and EXTRA, and returns digests of what is read back from the formatted texts."""
    spark = turns.sparkSession
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_conversations(rows)
    udf = arrow_udf(_digest_column, "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>")
    return out.select("conv_id", udf("formatted", "loss").alias("d")).select("conv_id", "d.*")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(17 + length(role) + length(regexp_replace(text, '([<\[])(\\*)((?:\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>>))', '\1\\\2\3', 'g'))) AS n
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(body) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM g
"""
