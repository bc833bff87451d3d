"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn; a deterministic parser reads the
rendered text back.  Turns that do not come back as they were have their
control strings escaped, until the recovered turns equal the source.

The grammar::

    conversation = { turn }
    turn   = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"
    role   = characters other than newline; backslash escapes (see below)
    text   = characters without a control string; "<\\|", "<\\\\|", ... stand
             for "<|", "<\\|", ...: one backslash less
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

FORMATTED = "conv_id {id}, text string, n_turns long, n_escaped long, loss_spans array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def render(turns: list[tuple[str, str]]) -> str:
    """Turns of (role, text already escaped where needed)."""
    return "".join(f"{START}{_escape_role(role)}\n{text}{END}\n" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the escaped text) of each turn; None where the text breaks the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        body = rendered.find("\n", at)
        if not rendered.startswith(START, at) or body < 0:
            return None
        m = _CONTROL.search(rendered, body + 1)
        if m is None or m[0] != END or rendered[m.end() : m.end() + 1] != "\n":
            return None
        role, raw = rendered[at + len(START) : body], rendered[body + 1 : m.start()]
        turns.append((_unescape_role(role), unescape(raw), body + 1, m.start()))
        at = m.end() + 1
    return turns


def _reads_back(rendered: str, turns: list[tuple[str, str]]) -> bool:
    found = parse(rendered)
    return found is not None and [t[:2] for t in found] == turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, int]:
    """Rendered text and number of escaped turns; the text parses back to ``turns``."""
    rendered, escaped = render(turns), 0
    if not _reads_back(rendered, turns):
        conflict = [not _reads_back(render([t]), [t]) for t in turns]
        rendered, escaped = render([(r, escape(x) if bad else x) for (r, x), bad in zip(turns, conflict, strict=True)]), sum(conflict)
        if not _reads_back(rendered, turns):
            raise ValueError("a conversation does not survive the round trip")
    return rendered, escaped


def format_conversations(conversations: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Render every conversation as one training text with a loss mask.

    ``conversations`` has conv_id, turn, role and text; other columns are
    ignored.  Turns stand in order of turn, then role and text, nulls first;
    repeated rows stay.  A null role or text is empty; rows with null conv_id
    make one conversation.  Returns conv_id, text, n_turns, n_escaped and
    loss_spans, the character spans of the escaped texts of ``loss_role``.
    An empty table gives no rows.  A conversation is one row of the result and
    has to fit into one; nothing larger than that is gathered.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    turns = conversations.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, escapes, spans = [], [], [], []
            for rows in batch.column("turns").to_pylist():
                source = [(r["role"] or "", r["text"] or "") for r in rows]
                text, escaped = format_turns(source)
                texts.append(text)
                counts.append(len(source))
                escapes.append(escaped)
                spans.append([{"start": a, "end": b} for role, _, a, b in parse(text) if role == loss_role])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(escapes, pa.int64()), pa.array(spans, span)], ["conv_id", "text", "n_turns", "n_escaped", "loss_spans"])

    return turns.select("conv_id", "turns").mapInArrow(formatted, FORMATTED.format(id=kind))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations back: conv_id, turns of (role, text), and the
    unescaped text under the loss mask.  A text outside the grammar has null turns."""
    kind = dict(formatted.dtypes)["conv_id"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, masked = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                found = parse(text)
                turns.append(None if found is None else [{"role": r, "text": x} for r, x, _, _ in found])
                masked.append("".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, turn), pa.array(masked, pa.string()), batch.column("chars")], ["conv_id", "turns", "loss_text", "formatted_chars"])

    rows = formatted.select("conv_id", "text", "loss_spans", F.length("text").cast("long").alias("chars"))
    return rows.mapInArrow(parsed, f"conv_id {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")


#: DuckDB SQL for the digests of the registered query.
CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
turns AS (
  SELECT *, CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(text, '<|endoftext|>') OR regexp_matches(text, '<\\+\|')
                 THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END AS escaped,
         replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l') AS role_escaped
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(role_escaped) + 1 + length(escaped) + 10 + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
