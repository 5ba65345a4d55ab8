"""Chat formatting by event sourcing: logs are folded into final messages, and messages rendered.

A log row is an event of a conversation: `open` starts message `message` with a role, `delta` appends text to
it, `edit` replaces its text, and `regenerate` empties it so that the deltas after it make a new answer. Logs
are dealt by conversation and message, sorted by sequence number, and folded in that order as a stream: a task
holds one message at a time, so a conversation of any length is spread over tasks and needs no more memory than its
longest message. Only the digests of whole conversations read one from end to end, as a stream too.

Template: `<s>[INST]` role `[/INST]` line feed, text, `</s>` line feed. A backslash in a text or role is
doubled, and a control string (`<s>`, `</s>`, `[INST]`, `[/INST]`) gets a backslash after its first character;
so every text can be read back. The loss mask is the array of [start, end) code-point ranges, within the
rendered turn, of texts of role `assistant`.

Rendered turns are written to the shared folder, a row per turn; digests are made from what is read back.

Defined results: null texts are empty, null roles are the empty role; events before any `open` of a message
open it with the empty role; events of unknown kind change nothing; rows of null conversation form one
conversation of null id; equal sequence numbers follow in the order message, kind, text; empty logs give no
row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom.llm.shared import bound_batches, stored

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
PIECE = 48  # characters of a streamed delta in events_of()


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, list[tuple[int, int]]]:
    """A turn, and the ranges of it under the loss mask."""
    head, body = f"<s>[INST]{escape(role)}[/INST]\n", escape(text)
    mask = [(len(head), len(head) + len(body))] if role == "assistant" else []
    return f"{head}{body}</s>\n", mask


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\]\n(.*?)</s>\n", re.DOTALL)


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    role, text = _TURN.fullmatch(rendered).groups()
    return unescape(role), unescape(text)


def events_of(turns: DataFrame) -> DataFrame:
    """The event log that streaming the turns (conv_id, turn, role, text) would leave: each turn is opened and
    streamed in deltas; every third one is a draft first, taken back by a regeneration, and every fifth one is
    cut short and put right by an edit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text")).withColumn("message", at)
    n = F.ceil(F.char_length("text") / PIECE).cast("int")
    event = lambda kind, body: F.struct(F.lit(kind).alias("kind"), body.alias("body"))
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: event("delta", F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))))).otherwise(F.array().cast("array<struct<kind:string,body:string>>"))
    opened = F.array(event("open", F.col("role")))
    draft = F.array(event("delta", F.reverse("text")), event("regenerate", F.lit(None).cast("string")))
    log = F.when(F.pmod("message", F.lit(3)) == 2, F.concat(opened, draft, pieces)).when(F.pmod("message", F.lit(5)) == 4, F.concat(opened, F.slice(pieces, 1, 1), F.array(event("edit", F.col("text"))))).otherwise(F.concat(opened, pieces))
    return rows.select("conv_id", "message", F.posexplode(log).alias("k", "e")).select("conv_id", (F.col("message").cast("long") * (1 << 32) + F.col("k")).alias("seq"), "message", "e.kind", "e.body")


def _by_conversation(df: DataFrame, *order: str | Column, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows dealt by conversation (and the columns `also`, where a task needs no more), in the order given."""
    return df.repartition("conv_id", *also).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


class _Out:
    """Rows gathered into Arrow batches of a bounded number of characters."""

    def __init__(self, kinds: dict[str, pa.DataType]) -> None:
        self.kinds, self.rows, self.size = kinds, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.size += size + 50
        return self.size > 1 << 22

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[] for _ in self.kinds]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, self.kinds.values(), strict=True)], names=list(self.kinds))


def fold(log: DataFrame) -> DataFrame:
    """Final messages of an event log (conv_id, seq, message, kind, body): conv_id, message, role, text."""
    bound_batches(log.sparkSession)
    rows = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message").cast("long").alias("message"), "kind", F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out({"conv_id": pa.int64(), "message": pa.int64(), "role": pa.string(), "text": pa.string()})
        key, role, parts = None, "", []
        for batch in batches:
            for conv, message, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (conv, message):
                    if key is not None and out.add((*key, role, t := "".join(parts)), len(t)):
                        yield out.take()
                    key, role, parts = (conv, message), "", []
                if kind == "open":
                    role, parts = body, []
                elif kind == "delta":
                    parts.append(body)
                elif kind == "edit":
                    parts = [body]
                elif kind == "regenerate":
                    parts = []
        if key is not None:
            out.add((*key, role, "".join(parts)), 0)
        yield out.take()

    # Events of a message may lie apart in the log: within a conversation they are sorted by message, then seq.
    ordered = _by_conversation(rows, F.col("message").asc_nulls_first(), F.col("seq").asc_nulls_first(), "kind", "body", also=("message",))
    return ordered.select("conv_id", "message", "kind", "body").mapInArrow(run, "conv_id long, message long, role string, text string")


def render_turns(messages: DataFrame) -> DataFrame:
    """conv_id, message, formatted, loss (array of ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out({"conv_id": pa.int64(), "message": pa.int64(), "formatted": pa.string(), "loss": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))})
        for batch in batches:
            for conv, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made, mask = render(role or "", text or "")
                if out.add((conv, message, made, [{"start": a, "end": b} for a, b in mask]), len(made)):
                    yield out.take()
        yield out.take()

    return messages.select("conv_id", "message", "role", "text").mapInArrow(run, "conv_id long, message long, formatted string, loss array<struct<start:int,end:int>>")


def digests(rendered: DataFrame) -> DataFrame:
    """From rendered turns, a row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})
        state, key = None, None
        for batch in batches:
            for conv, made, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None and out.add((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), 200):
                        yield out.take()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(made)
                loss = "".join(unescape(made[m["start"] : m["end"]]) for m in mask)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(made)
        if state is not None:
            out.add((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), 0)
        yield out.take()

    ordered = _by_conversation(rendered, F.col("message").asc_nulls_first())
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(log: DataFrame) -> DataFrame:
    """The rendered turns of a log, written to the shared folder and read back."""
    return stored(render_turns(fold(log)), "chats")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_chats(events_of(turns.unionByName(more))))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n, length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS r FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + r + length('<s>[INST][/INST]') + 1 + length('</s>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
