"""Chat records of any known layout into canonical turns and one training text.

A record is a JSON object. Its schema fingerprint, the SHA-256 of its sorted nested
field paths, selects a declarative mapping (``LAYOUTS``) to canonical turns (role, text):

* message lists ``messages[].role/content`` and ``conversations[].from/value``,
* prompts ``prompt`` with ``completion`` or ``response``, with or without ``system``,
* instructions ``instruction`` with ``output``, with or without ``input``.

A record with another fingerprint, or one that its layout cannot read, is kept with no turns and ``layout`` null,
for the caller to see. Texts may have any length. The training text has, per turn, ``### role: text </turn>`` and a line feed. In
texts and roles a backslash, ``<`` and ``#`` (in roles also ``:``) are written as
backslash and a letter, so control strings never occur in them and every text reads
back exactly. The loss mask lists the code-point ranges of the assistant's texts.

DataFrame functions only. Null roles and texts are empty; a record that is null or no JSON
object has a null layout; empty message lists give an empty text. Repeated records are formatted
each for itself. Turns of one record are ordered as its list is; rows
of one conversation with the same turn by role, then text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
#: Written form of each control character; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
TEXT_ESCAPES, ROLE_ESCAPES = ESCAPES[:3], ESCAPES
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``paths``: nested field paths. ``items``: list field with its (role, text) names, or
    ``fields``: (role, field names joined by an empty line) in order."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.paths)).encode()).hexdigest()

    @property
    def schema(self) -> str:
        if self.items:
            name, role, text = self.items
            return f"`{name}` array<struct<`{role}`:string,`{text}`:string>>"
        return ", ".join(f"`{p}` string" for p in self.paths)


def _flat(name: str, *fields: tuple[str, tuple[str, ...]]) -> Layout:
    return Layout(name, tuple(p for _, names in fields for p in names), None, fields)


USER, ASSISTANT, SYSTEM = "user", "assistant", "system"
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("no messages", ("messages",), ("messages", "role", "content")),
    Layout("shared", ("conversations", "conversations[].from", "conversations[].value"),
           ("conversations", "from", "value")),
    Layout("no shared", ("conversations",), ("conversations", "from", "value")),
    _flat("prompt", (USER, ("prompt",)), (ASSISTANT, ("completion",))),
    _flat("prompt response", (USER, ("prompt",)), (ASSISTANT, ("response",))),
    _flat("system prompt", (SYSTEM, ("system",)), (USER, ("prompt",)), (ASSISTANT, ("response",))),
    _flat("instruction", (USER, ("instruction",)), (ASSISTANT, ("output",))),
    _flat("instruction input", (USER, ("instruction", "input")), (ASSISTANT, ("output",))),
)
LISTS = tuple(dict.fromkeys(x.items[0] for x in LAYOUTS if x.items))


#: The JSON reader refuses strings above 20,000,000 characters unless it is told otherwise.
READER = {"maxStringLen": str(2**31 - 1)}
UNREAD = "_unread"


def _read(record: Column, schema: str) -> Column:
    """The record by a schema; ``UNREAD`` holds it where it could not be read."""
    return F.from_json(record, f"{schema}, `{UNREAD}` string", READER | {"columnNameOfCorruptRecord": UNREAD})


def fingerprint(record: Column) -> Column:
    """SHA-256 of the sorted nested field paths of a JSON object.

    The paths of a list are those of all its elements; an element that is no object adds the path ``list[]``.
    """
    none = F.array().cast("array<string>")
    top = F.coalesce(F.json_object_keys(record), none)
    paths = top
    for name in LISTS:
        elements = F.coalesce(_read(record, f"`{name}` array<string>")[name], none)
        keys = F.transform(elements, lambda e: F.coalesce(
            F.transform(F.json_object_keys(e), _under(name)), F.array(F.lit(f"{name}[]"))))
        paths = F.concat(paths, F.when(F.array_contains(top, name), F.array_distinct(F.flatten(keys))).otherwise(none))
    return F.sha2(F.array_join(F.array_sort(paths), "\n").cast("binary"), 256)


def _under(name: str):
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _canonical_role(role: Column) -> Column:
    named = role
    for other, name in ROLE_NAMES.items():
        named = F.when(role == other, F.lit(name)).otherwise(named)
    return named


def _mapped(record: Column, layout: Layout) -> Column:
    parsed = _read(record, layout.schema)
    if layout.items:
        name, role, text = layout.items
        to_role = _canonical_role if role == "from" else (lambda r: r)
        return F.transform(F.coalesce(parsed[name], F.array().cast(
            f"array<struct<`{role}`:string,`{text}`:string>>")), lambda m: _turn(to_role(m[role]), m[text]))
    return F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *[F.when(parsed[f] != "", parsed[f]) for f in names]))
                     for role, names in layout.fields])


def canonical_turns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The rows with ``layout`` and ``turns``."""
    record = F.col(record_col)
    named = records.withColumn("_fingerprint", fingerprint(record))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for x in LAYOUTS:
        hit = (F.col("_fingerprint") == x.fingerprint) & _read(record, x.schema)[UNREAD].isNull()
        layout = F.when(hit, x.name).otherwise(layout)
        turns = F.when(hit, _mapped(record, x)).otherwise(turns)
    return named.withColumns({"layout": layout, "turns": turns}).drop("_fingerprint")


def escape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes=TEXT_ESCAPES) -> Column:
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def formatted(canonical: DataFrame) -> DataFrame:
    """The rows with ``formatted`` and ``loss`` (ranges start, end of the assistant's texts)."""
    written = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(COLON)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("learn")))
    text = F.array_join(F.transform("_written", lambda w: F.concat(w["head"], w["body"], F.lit(CLOSE))), "")
    none = F.array().cast("array<struct<start:long,end:long>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("ranges"))

    def step(acc, w):
        start = acc["at"] + F.length(w["head"])
        end = start + F.length(w["body"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"),
                        F.when(w["learn"], F.concat(acc["ranges"], here)).otherwise(acc["ranges"]).alias("ranges"))

    loss = F.aggregate("_written", state, step, lambda acc: acc["ranges"])
    return canonical.withColumn("_written", written).withColumns({"formatted": text, "loss": loss}).drop("_written")


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted text."""
    pieces = F.split(text, CLOSE, -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.substring(t, len(OPEN) + 1, F.length(t)), COLON, 1), ROLE_ESCAPES).alias("role"),
        unescape(F.substring(t, F.instr(t, COLON) + len(COLON), F.length(t))).alias("text")))


def loss_text(text: Column, ranges: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(ranges, lambda r: unescape(F.substring(
        text, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation's rows, by turn, as a JSON record.

    Question and answer become a prompt record, with a system text before them a system
    prompt record, and conversations of the common roles alone a ``from``/``value`` list if they start
    with a system turn, all others a message list.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])

    def text(i):
        return F.col("t")[i]["text"]

    def are(*names):
        return roles == F.array(*[F.lit(n) for n in names])

    to_from = F.transform("t", lambda x: F.struct(
        F.when(x["role"] == USER, "human").when(x["role"] == ASSISTANT, "gpt").otherwise(x["role"]).alias("from"),
        x["text"].alias("value")))
    common = F.forall(roles, lambda r: r.isin(USER, ASSISTANT, SYSTEM))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    record = (
        F.when(are(USER, ASSISTANT), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(are(SYSTEM, USER, ASSISTANT), F.to_json(F.struct(
            text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(common & (roles[0] == SYSTEM), F.to_json(F.struct(to_from.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages")))))
    return whole.select("conv_id", record.alias("record"))
