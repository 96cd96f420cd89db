"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only the text of that reply is
trainable. Turns after the last reply (or a conversation without replies) form one more example without a target, so that the
output holds every turn. Conversations are formatted in parallel; the turns of one conversation stream through one task in
order, and what is held is the text of that conversation so far.

Template: a reply is ``<s>text</s>``; any other turn is ``[INST] role``, a line feed, ``text [/INST]``. A template mark inside a
role or text gets a backslash after its first character, and one more if it has some already, so that unescaping is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import small_batches

REPLY = "assistant"
_MARK = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
_MARKED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
_TURN = re.compile(r"<s>(.*?)</s>|\[INST\] ([^\n]*)\n(.*?) \[/INST\]", re.DOTALL)

SCHEMA = "example bigint, formatted string, target_start bigint, target_end bigint"


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2\3", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> str:
    return f"<s>{escape(text)}</s>" if role == REPLY else f"[INST] {_role(role)}\n{escape(text)} [/INST]"


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(REPLY, unescape(m[1])) if m[1] is not None else (_role_back(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def _by_conversation(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator]]:
    """Runs of equal ``conv_id`` over batches; each run is a lazy iterator of rows."""
    from itertools import groupby

    rows = (row for frame in frames for row in frame.itertuples(index=False))
    return groupby(rows, key=lambda row: row.conv_id)


def examples(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``example`` (from 0), ``formatted``, ``target_start``, ``target_end`` (code points; equal: no target).

    Reads ``conv_id, turn, role, text``. Null role and text are empty. Turns are ordered by turn (null first), then role, then
    text, so ties and repeated rows have one defined order. Rows with a null ``conv_id`` form one conversation. The examples of
    a conversation stand together and in order. Other columns are not read; an empty table gives no examples.
    """
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def expand(frames):
        for conv_id, rows in _by_conversation(frames):
            prefix, n, open_turns = "", 0, False
            for row in rows:
                turn = render(row.role, row.text)
                if row.role == REPLY:
                    start = len(prefix) + len("<s>")
                    prefix += turn
                    yield [conv_id, n, prefix, start, len(prefix) - len("</s>")]
                    n, open_turns = n + 1, False
                else:
                    prefix, open_turns = prefix + turn, True
            if open_turns:
                yield [conv_id, n, prefix, len(prefix), len(prefix)]

    columns = ["conv_id", "example", "formatted", "target_start", "target_end"]
    turns = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return _typed(turns.mapInPandas(_gathered(expand, columns), f"conv_id string, {SCHEMA}"), kind)


def _typed(df: DataFrame, kind: str) -> DataFrame:
    """Ids travel as text, since nullable integers would become floating-point numbers in pandas."""
    return df.withColumn("conv_id", F.col("conv_id").cast(kind))


def _gathered(rows_of, columns, most: int = 1 << 22):
    """Turn rows into frames of some megabytes."""
    def run(frames):
        held, size = [], 0
        for one in rows_of(frames):
            held.append(one)
            size += sum(len(v) for v in held[-1] if isinstance(v, str)) + 64
            if size >= most:
                yield pd.DataFrame(held, columns=columns)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)
    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """What the examples say, one row per conversation: turns from the last example, trainable text from all masks in order.

    ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars`` (code points of the last
    example, which holds the whole conversation), ``n_examples``, ``expanded_chars`` (of all examples). Takes the result of
    ``examples`` as it is, with a conversation's examples together and in order.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]

    def read(frames):
        for conv_id, rows in _by_conversation(frames):
            loss, chars, n, total, last = hashlib.sha256(), 0, 0, 0, ""
            for row in rows:
                target = unescape(row.formatted[int(row.target_start):int(row.target_end)])
                loss.update(target.encode())
                chars, n, total, last = chars + len(target), n + 1, total + len(row.formatted), row.formatted
            turns, digest = parse(last), hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            yield [conv_id, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(last), n, total]

    schema = "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint, expanded_chars bigint"
    held = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "target_start", "target_end")
    return _typed(held.mapInPandas(_gathered(read, columns), schema), kind)


ORACLE = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS e FROM a),
f AS (SELECT *, length(CASE WHEN role = 'assistant' THEN '<s>' || e || '</s>' ELSE '[INST] ' || role || chr(10) || e || ' [/INST]' END) AS n,
  max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_reply, max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM s),
g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') + CASE WHEN any_value(last_reply) IS NULL OR any_value(last_reply) < any_value(last_turn) THEN 1 ELSE 0 END AS n_examples,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) + CASE WHEN any_value(last_reply) IS NULL OR any_value(last_reply) < any_value(last_turn) THEN sum(n) ELSE 0 END AS BIGINT) AS expanded_chars
FROM g GROUP BY conv_id"""
