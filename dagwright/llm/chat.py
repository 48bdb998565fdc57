"""Chat formatting by schema fingerprints, in DataFrame functions only.

The field paths that a record has (`messages[].role`, `prompt`, ...) are hashed; the hash selects one
of LAYOUTS, a declarative mapping from that layout to canonical turns, an array of (role, text). Where a
column's type is one layout, that holds for all its records; where it has the fields of several, each
record's own fingerprint, of those that are not null, selects.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template's control strings.
BEGIN, END = "<|im_start|>", "<|im_end|>"
#: What could open a control string of this or another common template gets a backslash after its first character.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<?/?SYS>>)"
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts: field paths, and turns as (path of an array or None, role field or literal, text fields).
LAYOUTS = {
    "messages": (("messages[].content", "messages[].role"), "messages", "role", "content"),
    "turns": (("turns[].role", "turns[].text"), "turns", "role", "text"),
    "sharegpt": (("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    "instruction": (("input", "instruction", "output"), None, ("user", "assistant"), (("instruction", "input"), ("output",))),
    "instruction_only": (("instruction", "output"), None, ("user", "assistant"), (("instruction",), ("output",))),
    "prompt": (("completion", "prompt"), None, ("user", "assistant"), (("prompt",), ("completion",))),
    "prompt_response": (("prompt", "response"), None, ("user", "assistant"), (("prompt",), ("response",))),
    "question": (("answer", "question"), None, ("user", "assistant"), (("question",), ("answer",))),
    "system_prompt": (("completion", "prompt", "system"), None, ("system", "user", "assistant"), (("system",), ("prompt",), ("completion",))),
    "chosen": (("chosen", "prompt", "rejected"), None, ("user", "assistant"), (("prompt",), ("chosen",))),
}


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, `[]` for array elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(fields) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()[:16]


#: Fingerprint to layout.
MAPPINGS = {fingerprint(x[0]): name for name, x in LAYOUTS.items()}


def turns_by(name: str, record: Column, roles: dict[str, str]) -> Column:
    """The turns of a record of a named layout."""
    _, array, role, text = LAYOUTS[name]
    if array:
        return F.transform(F.coalesce(record[array], F.array()), lambda x: turn(x[role], x[text], roles))
    made = [turn(F.lit(r), F.concat_ws("\n", *[F.when(record[f] != "", record[f]) for f in fs]) if len(fs) > 1 else record[fs[0]], roles) for r, fs in zip(role, text, strict=True)]
    return F.array(*made)


def own_fingerprint(record: Column, fields: list[str]) -> Column:
    """The fingerprint of the paths that are not null in a record; an array's elements have all their fields."""
    there = [F.when(record[f.split("[]")[0].split(".")[0]].isNotNull(), F.lit(f)) for f in sorted(fields)]
    return F.substring(F.sha2(F.concat_ws("\n", *there), 256), 1, 16)


def canonical_turns(record: Column, kind: T.StructType, roles: dict[str, str]) -> Column:
    """The turns of a record, by the mapping that its fingerprint selects."""
    fields = paths(kind)
    name = MAPPINGS.get(fingerprint(fields))
    if name is not None:
        return turns_by(name, record, roles)
    fitting = [x for x, layout in LAYOUTS.items() if set(layout[0]) <= set(fields)]
    if not fitting:
        raise ValueError(f"no layout has the fields {sorted(fields)}")
    own = own_fingerprint(record, fields)
    out = F.when(own == fingerprint([]), F.array().cast("array<struct<role: string, text: string>>"))
    for x in fitting:
        out = out.when(own == fingerprint(LAYOUTS[x][0]), turns_by(x, record, roles).cast("array<struct<role: string, text: string>>"))
    return out.otherwise(F.raise_error(F.concat(F.lit("no layout has the fields of the record "), F.to_json(record))).cast("array<struct<role: string, text: string>>"))


def turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    role = role.cast("string")
    for a, b in roles.items():
        role = F.when(role == a, F.lit(b)).otherwise(role)
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """Turns as one string; roles are percent-encoded, so they hold no line end."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(BEGIN), F.url_encode(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))), "")


def chat_format(records: DataFrame, record: str, loss_role: str = "assistant", roles: dict[str, str] | None = None) -> DataFrame:
    """Formats records of any layout of LAYOUTS; adds `formatted` and `loss_mask` to the columns of records.

    records[record] is a struct; the fingerprint of its type, or in a type with the fields of several
    layouts that of the fields that are not null, selects the mapping; a type or record that none fits is
    an error. Role names are replaced as `roles` says, or by ROLES without it. `loss_mask` has, for each turn of loss_role, the code points [start, end) of its
    escaped text in `formatted`. A null record or array has no turns and an empty string; null roles
    and texts count as empty; empty turns keep their place. Existing columns `formatted` and
    `loss_mask` are replaced.
    """
    kind = records.schema[record].dataType
    turns = canonical_turns(F.col(f"`{record}`"), kind, ROLES if roles is None else roles)
    out = records.withColumn("formatted", F.when(F.col(f"`{record}`").isNull(), F.lit("")).otherwise(formatted(turns)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"))
    # a split at the end mark gives each turn's head and text; offsets add up from their lengths
    each = F.transform(F.slice(F.split("formatted", END.replace("|", r"\|") + "\n", -1), 1, F.greatest(F.size(F.split("formatted", END.replace("|", r"\|") + "\n", -1)) - 1, F.lit(0))), measured)

    def add(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))
        return F.struct((acc["at"] + t["head"] + t["body"] + len(END) + 1).alias("at"), F.when(t["role"] == loss_role, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return out.withColumn("loss_mask", F.aggregate(each, start, add, lambda acc: acc["spans"]))


def measured(part: Column) -> Column:
    head = F.instr(part, "\n").cast("long")
    return F.struct(F.url_decode(F.substring_index(part, "\n", 1).substr(F.lit(len(BEGIN) + 1), F.length(part))).alias("role"), head.alias("head"), (F.length(part) - head).cast("long").alias("body"))


def read_back(text: Column) -> Column:
    """The turns of a formatted string."""
    parts = F.split(text, END.replace("|", r"\|") + "\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(F.url_decode(F.substring_index(p, "\n", 1).substr(F.lit(len(BEGIN) + 1), F.length(p))).alias("role"), unescaped(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def masked_text(text: Column, mask: Column) -> Column:
    """All text under a mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def conversations_of(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as one `messages` record for each conversation, by turn, then role and text."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return got.select("conv_id", F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")).alias("record"))
