r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text``, a line feed and ``</turn>`` on a line
of its own. Each rendered turn is read again by a deterministic parser; where
role and text don't come back as they were, the control strings inside the text
get one more backslash, which the parser takes away. Turns are rendered one by
one in the order of their conversation, so the longest conversation needs no
more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm.common import table

NAMED = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>"
_HEAD = r'### (?:(System|User|Assistant|Tool)|("(?:[^"\\\n]|\\.)*")): '
_HEADER = re.compile(_HEAD)
_CONTROL = re.compile(rf"(\\*)({_HEAD}|{END})")
LEARNED = "assistant"


class GrammarError(ValueError):
    """The text isn't a sequence of turns."""


def header(role: str) -> str:
    return f"### {NAMED[role] if role in NAMED else json.dumps(role)}: "


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end are where its text lies, as escaped."""
    at = 0
    while at < len(rendered):
        head = _HEADER.match(rendered, at)
        if not head:
            raise GrammarError(f"no header at {at}")
        close = next((m for m in _CONTROL.finditer(rendered, head.end()) if not m[1]), None)
        if not close or close[2] != END or rendered[close.start() - 1 : close.end() + 1] != f"\n{END}\n" or close.start() - 1 < head.end():
            raise GrammarError(f"no end for the turn at {at}")
        inner = rendered[head.end() : close.start() - 1]
        role = head[1].lower() if head[1] else json.loads(head[2])
        yield role, _CONTROL.sub(lambda m: m[0][1:], inner), head.end(), close.start() - 1
        at = close.end() + 1


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as rendered, and where its text lies. Text is escaped only if it wouldn't come back otherwise."""
    inner = text
    while True:
        whole = f"{header(role)}{inner}\n{END}\n"
        try:
            turns = list(parse(whole))
        except GrammarError:
            turns = []
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return whole, turns[0][2], turns[0][3]
        if inner != text:
            raise GrammarError("escaped text doesn't come back")
        inner = escape(text)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, place, rendered, loss_start, loss_end) per turn, in order within each task.

    The conversation is the concatenation of its turns by place (from 0); code
    points loss_start to loss_end of a turn are under the loss mask (null: none).
    Turns go by turn, then role and text; equal rows are turns of their own. A
    null text or role is empty, a null turn comes first, rows with a null conv_id
    are one conversation; an empty table gives no rows; other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = object(), 0
        for b in batches:
            rows = []
            for conv, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                place = place + 1 if conv == last else 0
                last = conv
                whole, start, end = render(role or "", text or "")
                rows.append((conv, place, whole, *((start, end) if role == LEARNED else (None, None))))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["conv_id", "place", "rendered", "loss_start", "loss_end"])

    needed = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = needed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(work, "conv_id long, place long, rendered string, loss_start long, loss_end long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation, digests of what the parser and the loss mask give back; rendered as formatted() orders it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[tuple] = []

        def close() -> None:
            if now:
                conv, n, whole, chars, loss, length = now
                done.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), length))

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*done, strict=True) if done else [()] * 6
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for b in batches:
            for conv, place, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "place", "rendered", "loss_start", "loss_end")), strict=True):
                if place == 0:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    learned = _CONTROL.sub(lambda m: m[0][1:], text[start:end])
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            yield batch()
        close()
        yield batch()

    return rendered.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    return read_back(formatted(turns.unionByName(hard)))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + len(regexp_extract_all(text, '### (System|User|Assistant|Tool): |### "([^"\\\n]|\\.)*": |</turn>')) + 9 + 6
    + CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE length(CAST(to_json(role) AS VARCHAR)) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
