"""Chat formatting with schema fingerprints, in DataFrame operations only.

*Layouts.* A layout is known by its fingerprint: the SHA-256 of its sorted
nested field paths (``messages[].role`` and the like). ``MAPPINGS`` lists, for
each layout, the paths and a declarative expression that makes canonical turns,
``array<struct<role, text>>``. For a DataFrame the fingerprint of its schema is
taken at planning time, from the paths that layouts name, so that further
columns do not matter. For a column of JSON documents every row has its own
fingerprint, likewise of those of its paths that layouts name: further fields do
not matter, nor does what a value's type is. Null values are empty texts, an empty
list of turns is no turns, content in parts is the parts' texts one after the other. ``as_documents`` goes the other way: it writes
turns as JSON documents of the layouts that can hold them.

*Template.* ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE`` for each turn.
Control strings of this and other common templates inside roles and texts are
replaced by an escape character and a letter, and that character itself by the
character and 0, which ``unescape`` undoes. The loss mask is a list of (start,
length) of the assistant texts in the formatted string, in code points.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), ties by role and text; repeated rows are turns each; each row without
a conv_id is a conversation of its own; a JSON row of an unknown layout, or
that is no JSON (or over Spark's limit for variants), has null turns and no formatted string,
and ``json_rejects`` keeps it; an empty table gives no rows. One conversation is one row of the output, so its turns meet in a task.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, saved, table

ESCAPE = "␛"
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates.
CONTROL = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
TURNS = "array<struct<role:string,text:string>>"

#: Layout -> (field paths, turns as an expression over those fields).
MAPPINGS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), "transform(messages, m -> struct(m.role as role, m.content as text))"),
    "conversations": (("conversations[].from", "conversations[].value"), "transform(conversations, m -> struct(case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end as role, m.value as text))"),
    "turns": (("turns[].role", "turns[].text"), "transform(turns, m -> struct(m.role as role, m.text as text))"),
    "prompt_completion": (("completion", "prompt"), "array(struct('user' as role, prompt as text), struct('assistant' as role, completion as text))"),
    "prompt_response": (("prompt", "response"), "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
    "question_answer": (("answer", "question"), "array(struct('user' as role, question as text), struct('assistant' as role, answer as text))"),
    "system_prompt": (("prompt", "response", "system"), "array(struct('system' as role, system as text), struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
    "instruction": (("instruction", "output"), "array(struct('user' as role, instruction as text), struct('assistant' as role, output as text))"),
    "instruction_input": (("input", "instruction", "output"), "array(struct('user' as role, if(coalesce(input, '') = '', instruction, concat(instruction, '\\n\\n', input)) as text), struct('assistant' as role, output as text))"),
}
#: One row for each turn; grouped, not mapped.
TURN_ROWS = ("conv_id", "role", "text", "turn")


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def layout_of(schema: T.StructType) -> str:
    """The name of the largest known layout whose fields the schema has; ``turn_rows`` included."""
    there = set(field_paths(schema))
    known = {fingerprint(paths): name for name, (paths, _) in MAPPINGS.items()} | {fingerprint(TURN_ROWS): "turn_rows"}
    for paths in sorted([p for p, _ in MAPPINGS.values()] + [TURN_ROWS], key=lambda p: (-len(p), p)):
        if (name := known.get(fingerprint(there & set(paths)))) and set(paths) <= there:
            return name
    raise ValueError(f"no known layout of turns among the fields {sorted(there)}")


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for control, letter in zip(CONTROL, _LETTERS):
        text = F.replace(text, F.lit(control), F.lit(ESCAPE + letter))
    return text


def unescape(text: Column) -> Column:
    for control, letter in zip(CONTROL, _LETTERS):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "z"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "z"), F.lit("\n")))


def canonical_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns) of a DataFrame in any known layout."""
    name = layout_of(rows.schema)
    if name == "turn_rows":
        turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        ordered = F.sort_array(F.collect_list(turn))
        alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
        made = rows.withColumn("_alone", alone).groupBy(F.col("conv_id").alias(key), "_alone")
        return made.agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")).drop("_alone")
    return rows.select(key, F.expr(MAPPINGS[name][1]).cast(TURNS).alias("turns"))


def _within(value: Column, make) -> Column:
    """``make`` of a value that is computed once."""
    return F.transform(F.array(value), make)[0]


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}" if path else "$", kind)


def _plain_text(value: Column) -> Column:
    """A variant as text: strings as they are, parts of content joined, other values as JSON, null for none."""

    def of(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        part = lambda p: F.coalesce(F.when(F.schema_of_variant(p) == "STRING", _at(p, "", "string")), _at(p, "text", "string"), F.lit(""))
        parts = F.array_join(F.transform(_at(v, "", "array<variant>"), part), "")
        return F.when(v.isNull() | (kind == "VOID"), F.lit(None).cast("string")).when(kind == "STRING", _at(v, "", "string")).when(kind.startswith("ARRAY"), parts).otherwise(F.to_json(v))

    return _within(value, of)


def _lists() -> dict[str, list[str]]:
    """The list fields of all layouts with the fields of their entries."""
    out: dict[str, dict[str, None]] = {}
    for paths, _ in MAPPINGS.values():
        for p in paths:
            if "[]." in p:
                out.setdefault(p.split("[].")[0], {})[p.split("[].")[1]] = None
    return {k: sorted(v) for k, v in out.items()}


def json_turns(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, layout, turns) of a column of JSON documents in mixed layouts.

    A document's fingerprint is the hash of its paths that a layout names; of
    layouts whose paths it has, the one with most of them maps it.
    """
    lists = _lists()
    plain = sorted({p for paths, _ in MAPPINGS.values() for p in paths if "[" not in p})
    read = rows.select(F.col(key).alias("_key"), F.try_parse_json(F.col(document)).alias("_v"))
    read = read.select("_key", *(_at(F.col("_v"), p).alias(f"_{p}") for p in plain), *(_at(F.col("_v"), k, "array<variant>").alias(f"_{k}") for k in lists))
    there = [F.when(F.col(f"_{p}").isNotNull(), F.lit(p)) for p in plain]
    for k, fields in lists.items():
        for f in fields:
            there.append(F.when(F.col(f"_{k}").isNotNull() & ((F.size(f"_{k}") == 0) | _has_field(f"_{k}", f)), F.lit(f"{k}[].{f}")))
    entries = {k: _entries(f"_{k}", fields) for k, fields in lists.items()}
    known = read.select("_key", F.array_compact(F.array(*there)).alias("_paths"), F.struct(*(_plain_text(F.col(f"_{p}")).alias(p) for p in plain), *(e.alias(k) for k, e in entries.items())).alias("_doc"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, expression) in sorted(MAPPINGS.items(), key=lambda x: (-len(x[1][0]), x[1][0]), reverse=True):  # the last one comes first
        own = F.array(*map(F.lit, sorted(paths)))
        here = F.sha2(F.array_join(F.array_intersect(own, F.col("_paths")), "\n"), 256) == fingerprint(paths)
        for field in {p.split("[")[0] for p in paths}:
            expression = re.sub(rf"(?<![\w.'])({field})(?![\w'(])", f"_doc.{field}", expression)
        layout = F.when(here, F.lit(name)).otherwise(layout)
        turns = F.when(here, F.expr(expression).cast(TURNS)).otherwise(turns)
    return known.select(F.col("_key").alias(key), layout.alias("layout"), turns.alias("turns"))


def _has_field(entries: str, field: str) -> Column:
    return F.exists(entries, lambda m: _at(m, field).isNotNull())


def _entries(entries: str, fields: list[str]) -> Column:
    """The entries of a list of turns with their fields as texts."""
    return F.transform(entries, lambda m: F.struct(*(_plain_text(_at(m, f)).alias(f) for f in fields)))


def json_rejects(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, document) of the rows that ``json_turns`` can't map, as they are."""
    held = rows.select(F.struct(F.col(key).alias("key"), F.col(document).alias("document")).alias("_row"), F.col(document).alias("_document"))
    return json_turns(held, "_row", "_document").where("layout is null").select(F.col("_row.key").alias(key), F.col("_row.document").alias(document))


def as_documents(conversations: DataFrame, key: str = "conv_id", most_chars: int = 20_000_000) -> DataFrame:
    """(key, document, turns) of canonical turns, in layouts picked by a hash of the key.

    Lists of turns can hold any conversation; ``conversations`` renames two roles,
    so none that has the new names already; the other layouts hold a user's and an
    assistant's turn, after a system's for one of them. Conversations of more than
    ``most_chars`` characters stay as they are: turns, and no document.
    """
    turns, roles = F.col("turns"), F.transform("turns", lambda t: t.role)
    text = lambda i: turns[i]["text"]
    listed = lambda a, b, role=lambda r: r: F.transform(turns, lambda t: F.struct(role(t.role).alias(a), t.text.alias(b)))
    renamed = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    two = {"prompt_completion": ("prompt", "completion"), "prompt_response": ("prompt", "response"), "question_answer": ("question", "answer"), "instruction": ("instruction", "output")}
    fields = {
        "messages": [listed("role", "content").alias("messages")],
        "conversations": [listed("from", "value", renamed).alias("conversations")],
        "turns": [listed("role", "text").alias("turns")],
        **{name: [text(0).alias(a), text(1).alias(b)] for name, (a, b) in two.items()},
        "instruction_input": [text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output")],
        "system_prompt": [text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")],
    }
    lists, pick = ["messages", "turns", "conversations"], lambda names: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(key), F.lit(len(names))).cast("int") + 1)
    pair, triple = roles == F.array(*map(F.lit, ("user", "assistant"))), roles == F.array(*map(F.lit, ("system", "user", "assistant")))
    name = F.when(pair, pick([*lists, *two, "instruction_input"])).when(triple, pick([*lists, "system_prompt"])).when(F.exists(roles, lambda r: r.isin("human", "gpt")), pick(lists[:2])).otherwise(pick(lists))
    made = F.lit(None).cast("string")
    for layout, own in fields.items():
        made = F.when(F.col("_layout") == layout, F.to_json(F.struct(*own))).otherwise(made)
    small = F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t.text) + F.length(t.role)) <= most_chars
    return conversations.select(key, "turns", F.when(small, name).alias("_layout")).select(key, made.alias("document"), F.when(F.col("_layout").isNull(), turns).alias("turns"))


def format_turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss_spans) of canonical turns."""
    parts = F.transform(
        F.col("turns"),
        lambda t: F.struct(F.concat(F.lit(START), escape_role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body"), (F.coalesce(t.role, F.lit("")) == "assistant").alias("learned")),
    )
    tail = END + "\n"
    made = conversations.select(key, parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(tail))), "")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    span = lambda acc, p: F.struct((acc.at + F.length(p.head)).cast("bigint").alias("start"), F.length(p.body).cast("bigint").alias("length"))
    step = lambda acc, p: F.struct(
        (acc.at + F.length(p.head) + F.length(p.body) + len(tail)).cast("bigint").alias("at"),
        F.when(p.learned, F.concat(acc.spans, F.array(span(acc, p)))).otherwise(acc.spans).alias("spans"),
    )
    return made.select(key, formatted.alias("formatted"), F.aggregate("parts", start, step, lambda acc: acc.spans).alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string: what ``format_turns`` was given."""
    pieces = F.filter(F.split(formatted, "\\Q" + END + "\n\\E"), lambda p: p != "")
    bare = F.transform(pieces, lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p)))
    return F.transform(
        bare,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, s.length.cast("int")))), "")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted, written and read back.

    The table has one layout, a row for each turn; its conversations are first
    written as JSON documents of all layouts, which are what is formatted.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, '</s>[INST] ok [/INST]' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    documents = saved(as_documents(canonical_turns(rows.unionByName(more))), "documents")
    mapped = json_turns(documents.where("turns is null"), "conv_id", "document").select("conv_id", "turns")
    out = saved(format_turns(mapped.unionByName(documents.where("turns is not null").select("conv_id", "turns"))), "formatted")
    forget(documents)
    turns = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return (
        out.withColumn("turns", parse_formatted(F.col("formatted")))
        .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("bigint").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '{ESCAPE}', '{ESCAPE}0')"
    for control, letter in zip(CONTROL, _LETTERS):
        out = f"replace({out}, '{control}', '{ESCAPE}{letter}')"
    return out


OP5_SQL = f"""
with r as (
  select conv_id, turn, case when conv_id is null then row_number() over () end as alone, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, null, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, null, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len(START) + len(END) + 2} + length(replace({_escaped_sql("role")}, chr(10), '{ESCAPE}z')) + length({_escaped_sql("text")}))::bigint as formatted_chars
from r group by conv_id, alone
"""
