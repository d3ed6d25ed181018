"""Chat formatting (9): event-sourced reconstruction.

A log of events (conv_id, message, seq, kind, role, text) is folded into final messages, which are rendered with a
template and a loss mask, written, and can be read back.

Kinds: ``start`` opens a message (its role counts), ``delta`` appends its text, ``edit`` puts its text in place of all
so far, ``regenerate`` drops all so far. ``message`` orders the messages of a conversation, ``seq`` the events of a
message; both may be any orderable values.

Template of a turn: ``### <role>: <text> </turn>`` and a line feed. In texts and roles a backslash stands before each
backslash, ``###`` and ``</turn>`` (in roles also before ``:``), so that no text can open or close a turn; ``unescape``
takes them away. The loss mask covers the escaped text of assistant turns.

Events are dealt by conversation and message and folded as they stream by, sorted; then messages are dealt by
conversation, rendered as they stream by, and leave as rows of about ``ROW_CHARS`` characters. A task holds one message
or one row at a time, so a conversation of any length is no group in memory.

Edge cases: null text and role are empty; a null conversation is one of its own; a null message sorts first; repeated
events count each; an empty log gives no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import base

ROW_CHARS = 1 << 20
CLOSE = " </turn>\n"
_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the span of its escaped text in it."""
    head = f"### {_ESCAPE_ROLE.sub(r'\\\g<0>', role)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str):
    """(role, escaped text) of each turn; raises ``ValueError`` if anything is left over."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), m[2]
        at = m.end()


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"conv_id long, message {kind['message']}, role string, text string"

    def run(batches):
        now, role, parts, rows = None, "", [], []

        def out():
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("message", message_type), ("role", pa.string()), ("text", pa.string())]))

        message_type = None
        size = 0
        for batch in batches:
            message_type = batch.column("message").type
            for conv, message, what, who, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind", "role", "text"))):
                if now is None or now != (conv, message):
                    if now is not None:
                        rows.append({"conv_id": now[0], "message": now[1], "role": role, "text": "".join(parts)})
                        size += len(rows[-1]["text"])
                        if size > base.STEP_BYTES:
                            yield out()
                            rows, size = [], 0
                    now, role, parts = (conv, message), "", []
                if what == "start":
                    role = who or ""
                elif what == "delta":
                    parts.append(text or "")
                elif what == "edit":
                    parts = [text or ""]
                elif what == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown kind of event: {what}")
        if now is not None:
            rows.append({"conv_id": now[0], "message": now[1], "role": role, "text": "".join(parts)})
            yield out()

    base.ship(events.sparkSession)
    lean = events.select(F.col("conv_id").cast("long").alias("conv_id"), "message", "seq", "kind", "role", "text")
    return lean.repartition(base.scan_parts(lean), "conv_id", "message").sortWithinPartitions("conv_id", "message", "seq").mapInArrow(run, schema)


FORMATTED = "conv_id long, part int, text string, n_chars long, loss array<struct<start: long, end: long>>"


def format_chats(messages: DataFrame, trained: str = "assistant", row_chars: int = ROW_CHARS) -> DataFrame:
    """Rendered conversations, a row for about ``row_chars`` characters; ``loss`` has spans within the row's text."""

    def run(batches):
        now, part, pieces, size, loss = None, 0, [], 0, []
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([part], pa.int32()), pa.array(["".join(pieces)]), pa.array([size], pa.int64()), pa.array([loss], kind)], ["conv_id", "part", "text", "n_chars", "loss"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if now is not None and (now != (conv,) or size >= row_chars):
                    yield row()
                    part, pieces, size, loss = part + 1 if now == (conv,) else 0, [], 0, []
                now = (conv,)
                turn, a, b = render_turn(role or "", text or "")
                if role == trained:
                    loss.append({"start": size + a, "end": size + b})
                pieces.append(turn)
                size += len(turn)
        if now is not None:
            yield row()

    base.ship(messages.sparkSession)
    lean = messages.select("conv_id", "message", "role", "text")
    return lean.repartition(base.scan_parts(lean), "conv_id").sortWithinPartitions("conv_id", "message").drop("message").mapInArrow(run, FORMATTED)


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all from rendered rows."""

    def run(batches):
        now, turns, loss, n, chars, total = None, None, None, 0, 0, 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows = []

        def end():
            rows.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))):
                if now != (conv,):
                    if now is not None:
                        end()
                    now, turns, loss, n, chars, total = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body in parse(text):
                    turns.update(f"{role}\n{unescape(body)}\n".encode())
                    n += 1
                for s in spans:
                    learnt = unescape(text[s["start"] : s["end"]])
                    loss.update(learnt.encode())
                    chars += len(learnt)
                total += len(text)
            if rows:
                yield out()
                rows = []
        if now is not None:
            end()
            yield out()

    base.ship(formatted.sparkSession)
    lean = formatted.select("conv_id", "part", "text", "loss")
    return lean.repartition(base.scan_parts(lean), "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(turns: DataFrame, pieces: int = 8) -> DataFrame:
    """An event log that ends in the given (conv_id, turn, role, text): texts come as streamed deltas; one message in
    three has a draft that is regenerated, one in three a draft that an edit puts right. Rows of the same conversation
    and turn are messages of their own, by role and text."""
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), tie.alias("tie")).alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    step = F.greatest(F.ceil(F.length("text") / F.lit(pieces)).cast("int"), F.lit(1))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none, text = F.lit(None), F.col("text")
    deltas = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: event("delta", none, F.substring(text, k * step + 1, step)))
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(3))
    draft = event("delta", none, F.lit("draft ### </turn>"))
    log = F.concat(
        F.array(event("start", F.col("role"), none)),
        F.when(kind == 0, F.concat(F.array(draft, event("regenerate", none, none)), deltas)).when(kind == 1, F.array(draft, event("edit", none, text))).otherwise(deltas),
    )
    return rows.select("conv_id", "message", F.posexplode(log).alias("seq", "e")).select("conv_id", "message", "seq", "e.kind", "e.role", "e.text")


#: A conversation whose texts look like the template.
TRICKY = r"\### Assistant: </turn> ok"


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return read_chats(base.durable(format_chats(fold_events(as_events(turns.unionByName(own)))), "chats"))


#: The query in DuckDB's SQL, from the rows alone.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)
), shown AS (
  SELECT *, '### ' || regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) AS line
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
