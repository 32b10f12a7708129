"""Chat formatting from event logs.

A log holds what happened to the messages of conversations: events (conv_id, msg, seq, kind, role, text). It
is partitioned by conversation and sorted by message and sequence, and one pass folds each message into its
final text and renders it:

- ``open`` begins message ``msg`` with a role; what an earlier opening of it held is gone;
- ``delta`` appends a streamed piece of text;
- ``edit`` puts a text in place of what is there;
- ``regenerate`` empties the message and takes away every later message that had begun by then.

A message that has no event left after the last regeneration before it does not exist. Because messages come in
order, that last regeneration is one number: a task holds one message at a time, never a conversation.

The template marks a turn with a line ``<turn role>``, the text, and a line ``</turn>``. In texts and roles one
backslash is put before ``<turn`` or ``</turn`` and the backslashes in front of it, and taken away on reading;
everything else stays as it is. In roles, backslashes and line breaks are written ``\\\\`` and ``\\n``. The loss mask
covers the texts of assistant turns, marks excluded.

Defined results: a null text or role is empty, a null conversation is one of its own and comes first, a null ``msg`` is the
first message, a null ``seq`` comes first. Events that tie in all of conversation, message and sequence are ordered by
kind, role and text. Events of an unknown kind are an error. An empty log has no turns. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: Code points of a streamed piece in logs made from whole texts.
PIECE = 400
#: Characters of rendered turns that are handed on together.
HANDED = 4_000_000
#: Events of one sequence number in the order in which they apply.
KINDS = ("open", "regenerate", "edit", "delta")

_CONTROL = re.compile(r"\\*</?turn")
_ESCAPED = re.compile(r"\\(\\*</?turn)")
_TURN = re.compile(r"<turn ([^\n]*)>\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(said: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(said))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head, body = f"<turn {role_out(role)}>\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


class Fold:
    """The state of one message while its events go by."""

    def __init__(self) -> None:
        self.begun, self.role, self.pieces = False, "", []

    def apply(self, kind: str, role: str | None, text: str | None) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind}")
        self.begun = True
        if kind == "open":
            self.role, self.pieces = role or "", []
        elif kind == "regenerate":
            self.pieces = []
        elif kind == "edit":
            self.pieces = [text or ""]
        else:
            self.pieces.append(text or "")


_TURNS = "conv_id {0}, msg {1}, role string, text string, formatted string, start long, loss_start long, loss_end long"


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    waiting = 0
    conv = msg = object()  # equal to no value
    cut = offset = 0
    later = 0  # the cut for messages after the one at hand
    fold = Fold()

    def close() -> None:
        nonlocal offset, waiting
        if fold.begun:
            text = "".join(fold.pieces)
            turn, begins, ends = render(fold.role, text)
            loss = (offset + begins, offset + ends) if fold.role == ASSISTANT else (None, None)
            rows.append((conv, msg, fold.role, text, turn, offset, *loss))
            offset += len(turn)
            waiting += 2 * len(turn)

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema.names)

    for batch in batches:
        for c, m, seq, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if c != conv or m != msg:
                close()
                fold, cut = Fold(), later
                if c != conv:
                    cut, offset, later = float("-inf"), 0, float("-inf")
                conv, msg = c, m
                if waiting > HANDED or len(rows) > 5000:
                    yield handed()
                    rows.clear()
                    waiting = 0
            place = float("-inf") if seq is None else seq
            if place < cut:
                continue
            fold.apply(kind, role, text)
            if kind == "regenerate":
                later = max(later, place)
    close()
    yield handed()


def turns(events: DataFrame) -> DataFrame:
    """The final messages in order, rendered: conv_id, msg, role, text, formatted, its place ``start`` in the
    conversation, and the part under the loss mask (null if none), in code points of the conversation.

    The formatted conversation is the ``formatted`` of its turns, one after the other.
    """
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    lined = (
        events.select("conv_id", "msg", "seq", "kind", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "msg", "seq", kind, "role", "text")
    )
    of = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    spark_schema = _TURNS.format(of["conv_id"], of["msg"])
    arrow = pa.schema(
        [("conv_id", pa.string() if of["conv_id"] == "string" else pa.int64()), ("msg", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string())]
        + [(n, pa.int64()) for n in ("start", "loss_start", "loss_end")]
    )
    return lined.mapInArrow(lambda batches: _fold(batches, arrow), spark_schema)


def conversations(rendered: DataFrame) -> DataFrame:
    """One row per conversation: its whole formatted text and the spans of its loss mask. A conversation has to fit in a row here."""
    parts = F.array_sort(F.collect_list(F.struct("start", "formatted", "loss_start", "loss_end")))
    spans = F.transform(F.filter("parts", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    whole = rendered.groupBy("conv_id").agg(parts.alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda x: x["formatted"]), "").alias("formatted"), spans.alias("loss"))


class Reader:
    """Reads a formatted conversation back, stretch by stretch: roles, texts and what lies under the mask."""

    def __init__(self) -> None:
        self.rest, self.read = "", 0
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, mask: list[tuple[int, int]]) -> None:
        """``mask`` has the spans that end in ``text``, in code points from the beginning of the conversation."""
        self.chars += len(text)
        self.rest += text
        for start, end in mask:
            under = unescape(self.rest[start - self.read : end - self.read])
            self.loss_chars += len(under)
            self.loss.update(under.encode("utf-8", "surrogatepass"))
        at = 0
        while m := _TURN.match(self.rest, at):
            self.turns += 1
            self.said.update(f"{role_in(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            at = m.end()
        self.rest, self.read = self.rest[at:], self.read + at

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("a formatted conversation does not end with a whole turn")
        return self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_READ = ("n_turns long", "turns_sha256 string", "loss_chars long", "loss_sha256 string", "formatted_chars long")


def _read(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    conv, reader = object(), None
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", *[c.split()[0] for c in _READ]]
    handed = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    for batch in batches:
        for c, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if c != conv:
                if reader:
                    rows.append((conv, *reader.result()))
                conv, reader = c, Reader()
            reader.feed(text, [] if start is None else [(start, end)])
        if rows:
            yield handed()
            rows.clear()
    if reader:
        rows.append((conv, *reader.result()))
    yield handed()


def read_back(rendered: DataFrame) -> DataFrame:
    """Per conversation what its formatted text and mask say: number and digest of turns, size and digest of the text
    under the mask, size of the whole. ``rendered`` comes from ``turns``, whose partitions hold conversations in order;
    digests are fed turn by turn."""
    of = {f.name: f.dataType.simpleString() for f in rendered.schema.fields}
    kind = pa.string() if of["conv_id"] == "string" else pa.int64()
    return rendered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(lambda b: _read(b, kind), ", ".join((f"conv_id {of['conv_id']}", *_READ)))


#: The conversation that every run adds: control strings and escapes inside texts.
PROBE = [(-7, t, role, r"\### Assistant: </turn> ok") for t, role in enumerate(("user", ASSISTANT))]


def log_of(rows: DataFrame) -> DataFrame:
    """The event log of finished messages (conv_id, turn, role, text): each is opened and streamed in pieces of ``PIECE`` code points."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    numbered = rows.select("conv_id", F.row_number().over(order).cast("long").alias("msg"), "role", text.alias("text"))
    last = F.floor((F.char_length("text") + PIECE - 1) / PIECE).cast("int")
    event = F.explode(F.sequence(F.lit(0), last)).alias("seq")
    events = numbered.select("conv_id", "msg", "role", "text", event)
    begin = F.col("seq") == 0
    return events.select(
        "conv_id", "msg", F.col("seq").cast("long").alias("seq"), F.when(begin, F.lit("open")).otherwise(F.lit("delta")).alias("kind"),
        F.when(begin, F.col("role")).alias("role"), F.when(~begin, F.substr(F.col("text"), (F.col("seq") - 1) * PIECE + 1, F.lit(PIECE))).alias("text"),
    )


_TURNS_SQL = "concat(coalesce(role, ''), chr(10), coalesce(text, ''), chr(10))"
_ROLE_SQL = r"replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n')"
_ADDED_SQL = "len(regexp_extract_all({}, '</?turn'))"
SQL = rf"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES {", ".join(f"(-7, {t}, '{role}', '{text}')" for _, t, role, text in PROBE)}) p(conv_id, turn, role, text)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg({_TURNS_SQL}, '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
  CAST(sum({len("<turn >") + len("..</turn>.")} + length({_ROLE_SQL}) + {_ADDED_SQL.format(_ROLE_SQL)} + length(coalesce(text, '')) + {_ADDED_SQL.format("coalesce(text, '')")}) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
