"""Chat formatting: records of many layouts become canonical turns, and turns become one marked string.

A record's layout is found by a fingerprint: the hash of the nested field paths that it fills, among
the paths that any mapping names. Each mapping is a declaration of fields; nothing is guessed. All of
it is column expressions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import pinned

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")  # broken up where texts hold them

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Flat:
    """A layout of single fields: each turn has a role and the fields whose texts it joins."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return tuple(f for _, fields in self.turns for f in fields)


@dataclass(frozen=True)
class Listed:
    """A layout with a list of messages; roles that are not renamed stay as they are."""

    name: str
    items: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"


SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS: tuple[Flat | Listed, ...] = (
    Listed("messages", "messages", "role", "content"),
    Listed("messages_text", "messages", "role", "text"),
    Listed("from_value", "conversations", "from", "value", SPOKEN),
    Flat("instruction_output", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    Flat("instruction_response", (("system", ("system",)), ("user", ("instruction", "context")), ("assistant", ("response",))), ("system", "context")),
    Flat("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    Flat("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    Flat("question_answer", (("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), ("system",)),
)


def fingerprint_of(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(mapping: Flat | Listed) -> list[str]:
    """One for each choice of the optional fields."""
    fixed = [p for p in mapping.paths if p not in mapping.optional]
    return [fingerprint_of(fixed + list(more)) for n in range(len(mapping.optional) + 1) for more in combinations(mapping.optional, n)]


def _field_source(df: DataFrame, record: str | None) -> tuple[Callable[[str], Column], Callable[[str, set[str]], Column]]:
    """How to reach a single field as text and a list's items as structs of texts, in JSON or in typed columns."""
    if record is not None:
        value = F.try_parse_json(F.col(record))

        def field(name):
            return F.try_variant_get(value, f"$.{name}", "string")

        def items(name, inner):
            return F.try_variant_get(value, f"$.{name}", f"array<struct<{','.join(f'{i}:string' for i in sorted(inner))}>>")

        return field, items
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def field(name):
        return F.col(f"`{name}`").cast("string") if isinstance(kinds.get(name), T.StringType) else F.lit(None).cast("string")

    def items(name, inner):
        kind = kinds.get(name)
        listed = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        own = set(kind.elementType.names) if listed else set()
        out = f"array<struct<{','.join(f'{i}:string' for i in sorted(inner))}>>"
        if not own & inner:
            return F.lit(None).cast(out)
        return F.transform(
            F.col(f"`{name}`"),
            lambda x: F.struct(*[(x[i].cast("string") if i in own else F.lit(None).cast("string")).alias(i) for i in sorted(inner)]),
        )

    return field, items


def _fills(name: str) -> Callable[[Column], Column]:
    return lambda item: item[name].isNotNull()


def canonical_turns(df: DataFrame, record: str | None = None, mappings=MAPPINGS) -> DataFrame:
    """Add layout, fingerprint and turns (array<struct<role,text>>).

    ``record`` names a column of JSON texts; without it the frame's own columns are the fields. A field
    is present if it is not null; in lists, if any item fills it. Fields that no mapping names are
    ignored. Where no mapping has the fingerprint, or the record is null or no JSON, layout and turns
    are null and the row is kept. A null text in a list counts as empty, a null role too.
    """
    field, items = _field_source(df, record)
    lists: dict[str, set[str]] = {}
    for m in mappings:
        if isinstance(m, Listed):
            lists.setdefault(m.items, set()).update((m.role, m.text))
    singles = sorted({p for m in mappings if isinstance(m, Flat) for p in m.paths})
    fields = F.struct(*[field(p).alias(p) for p in singles], *[items(n, inner).alias(n) for n, inner in sorted(lists.items())])

    def read(x: Column) -> Column:
        present = {p: x[p].isNotNull() for p in singles}
        for n, inner in lists.items():
            for i in inner:
                present[f"{n}[].{i}"] = F.exists(x[n], _fills(i))
        found = F.array_compact(F.array(*[F.when(present[p], F.lit(p)) for p in sorted(present)]))
        mark = F.md5(F.array_join(found, "\n").cast("binary"))
        layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
        for m in reversed(mappings):
            here = mark.isin(fingerprints(m))
            layout, turns = F.when(here, F.lit(m.name)).otherwise(layout), F.when(here, _turns(m, x)).otherwise(turns)
        return F.struct(layout.alias("layout"), mark.alias("fingerprint"), turns.alias("turns"))

    got = df.withColumn("__read", pinned(fields, read))
    return got.withColumns({c: F.col(f"__read.{c}") for c in ("layout", "fingerprint", "turns")}).drop("__read")


def _turns(m: Flat | Listed, x: Column) -> Column:
    if isinstance(m, Listed):

        def one(y: Column) -> Column:
            role = F.coalesce(y[m.role], F.lit(""))
            for old, new in m.roles:
                role = F.when(y[m.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(y[m.text], F.lit("")).alias("text"))

        return F.transform(x[m.items], one)
    out = []
    for role, names in m.turns:
        text = F.concat_ws("\n\n", *[x[n] for n in names])
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        needed = [x[n].isNotNull() for n in names]
        out.append(F.when(F.greatest(*needed, F.lit(False)), turn))
    return F.array_compact(F.array(*out))


def rows_to_messages(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation from rows by turn: (key, messages).

    Null roles and texts become empty, so that a conversation of nothing else has its fields too. Ties of
    ``order`` go by role, then text; repeated rows all stay; rows with a null key are one conversation. A
    conversation is the unit of the output and is built in one row.
    """
    turn = F.struct(F.col(order).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    return rows.groupBy(F.col(key)).agg(
        F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")
    )


def escaped(text: Column) -> Column:
    """No control string is left: backslashes are doubled, and one is put after a control string's first character."""
    heads: dict[str, list[str]] = {}
    for c in CONTROL:
        heads.setdefault(c[0], []).append(re.escape(c[1:]))
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for first, rest in heads.items():
        out = F.regexp_replace(out, f"({re.escape(first)})(?={'|'.join(rest)})", r"$1\\")
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(df: DataFrame, turns: str = "turns", learned: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``mask``.

    Every turn is its marks around role and text. mask has run lengths over the string's characters:
    struct<chars, loss>, with loss true exactly on the texts of ``learned``. A null list of turns gives
    null, an empty one an empty string. Columns with these names are replaced.
    """

    def parts(t: Column) -> Column:
        role = F.regexp_replace(escaped(F.coalesce(t["role"], F.lit(""))), "\n", "\\\\\n")
        return F.struct(
            F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == learned, F.lit(False)).alias("loss"),
        )

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    def out(p: Column) -> Column:
        whole = F.array_join(F.transform(p, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
        mask = F.flatten(
            F.transform(
                p,
                lambda t: F.array(
                    run(F.length(t["head"]), F.lit(False)), run(F.length(t["body"]), t["loss"]), run(F.lit(len(END) + 1), F.lit(False))
                ),
            )
        )
        return F.struct(whole.alias("formatted"), mask.alias("mask"))

    got = df.withColumn("__out", pinned(F.transform(F.col(turns), parts), out))
    return got.withColumns({c: F.col(f"__out.{c}") for c in ("formatted", "mask")}).drop("__out")


def parsed(whole: Column) -> Column:
    """The turns of a formatted string."""
    head = f"(?s)^{re.escape(START)}([^\\\\\n]*+(?:\\\\.[^\\\\\n]*+)*+)\n(.*)$"
    pieces = F.split(whole, re.escape(END) + "\n")
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"), unescaped(F.regexp_extract(p, head, 2)).alias("text")),
    )


def under_mask(whole: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,chars:int>>").alias("runs"))

    def add(acc: Column, r: Column) -> Column:
        here = F.array(F.struct(acc["at"].alias("at"), r["chars"].alias("chars")))
        return F.struct((acc["at"] + r["chars"]).alias("at"), F.when(r["loss"], F.concat(acc["runs"], here)).otherwise(acc["runs"]).alias("runs"))

    runs = F.aggregate(mask, start, add, lambda acc: acc["runs"])
    return F.transform(runs, lambda r: unescaped(F.substring(whole, r["at"], r["chars"])))


def digests(out: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the formatted strings and masks hold, read back from them."""
    whole, mask = F.col("formatted"), F.col("mask")
    turns = pinned(
        parsed(whole),
        lambda t: F.struct(
            F.size(t).cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        ),
    )
    loss = pinned(
        F.array_join(under_mask(whole, mask), ""),
        lambda t: F.struct(F.length(t).cast("long").alias("loss_chars"), F.sha2(t.cast("binary"), 256).alias("loss_sha256")),
    )
    return out.select(key, turns.alias("t"), loss.alias("l"), F.length(whole).cast("long").alias("formatted_chars")).select(
        key, "t.n_turns", "t.turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars"
    )
