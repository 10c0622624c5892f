"""Chat formatting by schema fingerprints.

A schema fingerprint is the SHA-256 of sorted nested field paths, such as
`messages[].role`, at every depth. A table has one, from its schema; a JSON record has
its own, from its fields. Declarative mappings are chosen by the fingerprint of those
paths that any mapping knows, so that further fields do no harm, and turn each layout
into canonical turns, an array of (role, text) in order. A field that holds values of
several shapes has a path of its own (`content?`), which no mapping takes for text.
Records of an unknown layout keep the fingerprint of all their paths and have null
turns and a null formatted string, and `unknown` lists them; a table of an unknown
layout is an error.

The template writes each turn as `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and
texts `&`, `<` and `[` become `&amp;`, `&lt;` and `&lbrack;` (in roles also newline and
`>`), so no text can hold a control string of this template or of the common ones with
angle or square brackets, and reading back restores every character. The loss mask
lists (start, end) of each assistant text in the formatted string, in code points.

Only DataFrame operations are used. Turns of one conversation meet in one row, since
they form one string; nothing else is gathered. Null texts and roles count as empty;
turns sort by turn, then role, then text, null turns first. Rows of a null conversation
id form one conversation. An empty input gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)] or [f"{at}{{}}"]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint_of(paths) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """paths identify it; turns gives the canonical turns from a record r. fields parse a JSON record; where turns are rows of a table, key and order name the columns that tell conversations apart and turns in order."""

    name: str
    paths: tuple[str, ...]
    fields: str
    turns: str
    key: str | None = None
    order: str | None = None

    @property
    def fingerprint(self) -> str:
        return fingerprint_of(self.paths)


def _pair(ask: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {ask}), named_struct('role', 'assistant', 'text', {answer}))"


#: Roles of other layouts by their canonical names.
_ROLE = "coalesce(element_at(map('human', 'user', 'gpt', 'assistant', 'bot', 'assistant', 'model', 'assistant'), {0}), {0})"
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), "messages array<struct<role:string,content:string>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("sharegpt", ("conversations[].from", "conversations[].value"), "conversations array<struct<`from`:string,value:string>>", f"transform(r.conversations, m -> named_struct('role', {_ROLE.format('m.`from`')}, 'text', m.value))"),
    Layout("prompt_response", ("prompt", "response"), "prompt string, response string", _pair("r.prompt", "r.response")),
    Layout("prompt_completion", ("prompt", "completion"), "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Layout("question_answer", ("question", "answer"), "question string, answer string", _pair("r.question", "r.answer")),
    Layout("instruction_output", ("instruction", "output"), "instruction string, output string", _pair("r.instruction", "r.output")),
    Layout("instruction_input_output", ("instruction", "input", "output"), "instruction string, input string, output string", _pair("if(coalesce(r.input, '') = '', r.instruction, concat(coalesce(r.instruction, ''), '\\n\\n', r.input))", "r.output")),
    Layout("system_prompt_response", ("system", "prompt", "response"), "system string, prompt string, response string", "concat(array(named_struct('role', 'system', 'text', r.system)), " + _pair("r.prompt", "r.response") + ")"),
)

_ROW = "array(named_struct('role', {0}, 'text', {1}))"
#: Layouts of tables with a row for each turn.
ROW_LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), "", _ROW.format("r.role", "r.text"), "conv_id", "turn"),
    Layout("sharegpt_rows", ("id", "position", "from", "value"), "", _ROW.format(_ROLE.format("r.`from`"), "r.value"), "id", "position"),
)


def known_paths(layouts: tuple[Layout, ...]) -> set[str]:
    return {p for x in layouts for p in x.paths}


#: What a variant's schema is written of: names with a colon, brackets, and types.
_PARTS = r"(?:`(?:[^`]|``)*`|\w+): |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z]+(?:\(\d+,\d+\))?"


def json_paths(record: Column) -> Column:
    """The sorted field paths of a JSON record, at every depth; none for what is no JSON."""
    parts = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(record)), F.lit(_PARTS), F.lit(0))
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("open"), F.lit("").alias("at"), F.array().cast(texts).alias("found"))

    def step(s: Column, x: Column) -> Column:
        top, named = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit("")), F.endswith(x, F.lit(": "))
        bare = F.replace(F.regexp_replace(F.substring(x, F.lit(1), F.length(x) - 2), r"^`([\s\S]*)`$", "$1"), F.lit("``"), F.lit("`"))
        inner = F.when(x == "ARRAY<", F.concat(s["at"], F.lit("[]"))).otherwise(s["at"])
        opens = F.when(x == "ARRAY<", inner).when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        stack = F.when(x.isin("OBJECT<", "ARRAY<"), F.concat(s["open"], F.array(opens))).when(x == ">", F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))).otherwise(s["open"])
        leaf = ~named & ~x.isin("OBJECT<", "ARRAY<", ">")
        sign = F.when(x == "OBJECT<>", "{}").when(x == "VARIANT", "?").otherwise("")
        found = F.when(leaf, F.concat(s["found"], F.array(F.concat(s["at"], sign)))).otherwise(s["found"])
        return F.struct(stack.alias("open"), F.when(named, F.concat(top, bare)).otherwise(inner).alias("at"), found.alias("found"))

    return F.coalesce(F.array_sort(F.array_distinct(F.aggregate(parts, start, step, lambda s: s["found"]))), F.array().cast(texts))


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of all of a JSON record's paths."""
    return F.sha2(F.array_join(json_paths(record), "\n"), 256)


def canonical(records: DataFrame, key: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """key, fingerprint, layout and turns of JSON records."""
    known = F.array(*(F.lit(p) for p in sorted(known_paths(layouts))))
    rows = records.select(F.col(key), F.col(record).alias("_json"), json_paths(F.col(record)).alias("_paths"))
    hashed = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    rows = rows.select(key, "_json", hashed(F.col("_paths")).alias("fingerprint"), hashed(F.filter("_paths", lambda p: F.array_contains(known, p))).alias("_known"))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for layout in layouts:
        mine = F.col("_known") == layout.fingerprint
        parsed = F.expr(f"transform(array(from_json(_json, '{layout.fields}')), r -> {layout.turns})[0]")
        turns, name = F.when(mine, parsed.cast(TURNS)).otherwise(turns), F.when(mine, F.lit(layout.name)).otherwise(name)
    return rows.select(key, "fingerprint", name.alias("layout"), turns.alias("turns"))


def unknown(canon: DataFrame) -> DataFrame:
    """fingerprint and number of the records that no mapping fits."""
    return canon.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("records"))


def layout_of(schema: T.StructType) -> Layout:
    """The layout whose fingerprint is that of the table's paths, among those with a row for each turn, else among those with a row for each record."""
    paths = set(field_paths(schema))
    for layouts in (ROW_LAYOUTS, LAYOUTS):
        found = {x.fingerprint: x for x in layouts}.get(fingerprint_of(paths & known_paths(layouts)))
        if found:
            return found
    raise ValueError(f"no mapping for the fields {sorted(paths)}, of fingerprint {fingerprint_of(paths)}")


def turns_of(rows: DataFrame, key: str | None = None) -> DataFrame:
    """The key and turns of a table, by the mapping that its fingerprint selects. A table with a row for each record needs the name of its key."""
    layout = layout_of(rows.schema)
    key = key or layout.key
    if key is None:
        raise ValueError(f"the layout {layout.name} has no key of its own")
    needed = list(dict.fromkeys(re.split(r"[.\[]", p)[0] for p in layout.paths))
    told = rows.select(F.col(f"`{key}`").alias("_key"), F.struct(*(F.col(f"`{c}`") for c in needed)).alias("_r"))
    turns = F.expr(f"transform(array(_r), r -> {layout.turns})[0]").cast(TURNS)
    if layout.order is None:
        return told.select(F.col("_key").alias(key), turns.alias("turns"))
    told = told.select("_key", F.col(f"_r.`{layout.order}`").alias("_order"), F.inline(turns))
    said = F.struct("_order", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    joined = told.groupBy("_key").agg(F.sort_array(F.collect_list(said)).alias("t"))
    return joined.select(F.col("_key").alias(key), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escaped(text: Column, role: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbrack;"), *((("\n", "&NewLine;"), (">", "&gt;")) if role else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescaped(text: Column) -> Column:
    """Any `&` in an escaped text begins an entity, and `&amp;` goes last, so each is undone once."""
    out = text
    for a, b in (("&NewLine;", "\n"), ("&gt;", ">"), ("&lbrack;", "["), ("&lt;", "<"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def format_turns(canon: DataFrame, key: str) -> DataFrame:
    """key, formatted and loss_mask, an array of (start, end), of canonical turns; null where turns are."""
    parts = F.transform(
        F.coalesce("turns", F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit("")), role=True), F.lit("\n")).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    rows = canon.select(key, parts.alias("parts"), F.col("turns").isNotNull().alias("known"))
    # running lengths only; the string itself is joined once
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(p["loss"], F.concat(s["mask"], one)).otherwise(s["mask"]).alias("mask"))

    mask = F.aggregate("parts", start, step, lambda s: s["mask"])
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    known = F.col("known")
    return rows.select(key, F.when(known, joined).alias("formatted"), F.when(known, mask).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as they were."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: F.startswith(p, F.lit(OPEN)))

    def one(piece: Column) -> Column:
        at = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - 1 - len(OPEN))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(piece, at + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, one)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, as they were, one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def report(formatted: DataFrame, key: str) -> DataFrame:
    """The digest, read back from the formatted strings."""
    rows = formatted.select(key, "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
