"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a record that some layout knows are hashed; the fingerprint selects a declarative mapping to
canonical turns, an array of struct<role, text>. MAPPINGS lists the layouts. A table has the paths of its schema, JSON lines those of
each record, by the same fingerprints and mappings. Fields that no layout knows don't count; unknown fingerprints
are reported, not guessed.

Template: <|role|>NAME<|text|>TEXT<|end|> for each turn. In names and texts a backslash is doubled, and one is put
after the first character of each control string, ours and those of other common templates, so none can be read
as a mark; unescaping gives the text back exactly. The loss mask is a list of runs (code points, loss), three for each turn:
what is before the text, the text, what is after; loss is true for assistants' texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import require, result_columns

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"
RUNS = "array<struct<n:int,loss:boolean>>"
#: What follows the first character of a control string.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<?/?SYS>|/?(?:start|end)_of_turn>|/?(?:system|user|assistant)>|/?(?:bos|eos|pad|unk|mask)>|BOS\]|EOS\]|CLS\]|SEP\]|MASK\]|/?TOOL)"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


@dataclass(frozen=True)
class Mapping:
    """paths that make the fingerprint ([] after a list's name); the turns as SQL over the record's fields, each after {r}.

    grouped: the turns are those of all rows with the same conv_id.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    grouped: bool = False


def pair(prompt: str, response: str) -> str:
    return f"array(struct('user' as role, {{r}}{prompt} as text), struct('assistant' as role, {{r}}{response} as text))"


MAPPINGS = (
    Mapping("prompt_response", ("prompt", "response"), pair("prompt", "response")),
    Mapping("prompt_completion", ("prompt", "completion"), pair("prompt", "completion")),
    Mapping("question_answer", ("question", "answer"), pair("question", "answer")),
    Mapping("instruction", ("instruction", "output"), pair("instruction", "output")),
    Mapping("instruction_input", ("instruction", "input", "output"), "array(struct('user' as role, concat_ws('\\n\\n', {r}instruction, nullif({r}input, '')) as text), struct('assistant' as role, {r}output as text))"),
    Mapping("system_instruction", ("system", "instruction", "output"), "array(struct('system' as role, {r}system as text), struct('user' as role, {r}instruction as text), struct('assistant' as role, {r}output as text))"),
    Mapping("messages", ("messages[].role", "messages[].content"), "transform({r}messages, m -> struct(m.role as role, m.content as text))"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), "transform({r}conversations, m -> struct(m.from as role, m.value as text))"),
    Mapping("turn_rows", ("turn", "role", "text"), "transform(array_sort(collect_list(struct({r}turn as turn, coalesce({r}role, '') as role, coalesce({r}text, '') as text))), t -> struct(t.role as role, t.text as text))", True),
)
KNOWN = sorted({p for m in MAPPINGS for p in m.paths})
LISTS = sorted({p.split("[].")[0] for p in KNOWN if "[]." in p})


def fingerprint(found) -> str:
    """Hash of the paths that some layout knows, in order."""
    return sha256("\n".join(sorted(set(found))).encode()).hexdigest()


#: Mapping by fingerprint; a list without elements is known by its name alone.
BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS} | {fingerprint([f"{a}[]"]): m for m in MAPPINGS for a in LISTS if m.paths[0].startswith(f"{a}[].")}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, list elements as []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def below(name: str):
    return lambda field: F.concat(F.lit(f"{name}[]."), field)


def record_fingerprint(value: Column) -> Column:
    """The fingerprint of a JSON record, from its own nested fields; null if it isn't an object."""
    keys = F.json_object_keys(value)
    found = [F.array_intersect(keys, F.array(*(F.lit(p) for p in KNOWN if "[]." not in p)))]
    for a in LISTS:
        each = F.from_json(F.get_json_object(value, f"$.{a}"), "array<map<string,string>>")
        names = F.array_intersect(F.flatten(F.transform(each, F.map_keys)), F.array(*(F.lit(p.split("[].")[1]) for p in KNOWN if p.startswith(f"{a}[]."))))
        inner = F.when(F.size(each) == 0, F.array(F.lit(f"{a}[]"))).otherwise(F.transform(names, below(a)))
        found.append(F.coalesce(F.when(F.array_contains(keys, a), inner), F.array().cast("array<string>")))
    return F.when(keys.isNotNull(), F.sha2(F.array_join(F.array_sort(F.concat(*found)), "\n"), 256))


def canonical(turns: Column) -> Column:
    """Turns with known role names, lower case; a null list is empty, null roles and texts are empty strings."""
    role = lambda r: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), r), r)
    return F.transform(F.coalesce(turns, F.array().cast(TURNS)), lambda m: F.struct(role(F.lower(F.coalesce(m["role"], F.lit("")))).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))


def from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """df plus layout (null if unknown), fingerprint and turns of the JSON records in column value.

    Field order and fields that no layout knows don't count, so a very long or repeated record is as any other. Null or malformed records and
    unknown layouts have layout null and no turns; an empty list of messages has its layout and no turns; null fields
    are empty texts. An empty table gives an empty one; names that clash get a suffix.
    """
    require(df, value)
    layout, shape, turns, record = result_columns(df, "layout", "fingerprint", "turns", "record")
    fields = [f"{p} string" for p in KNOWN if "[]." not in p]
    fields += [f"{a} array<struct<{','.join(p.split('[].')[1] + ':string' for p in KNOWN if p.startswith(f'{a}[].'))}>>" for a in LISTS]
    df = df.withColumns({shape: record_fingerprint(F.col(value)), record: F.from_json(value, ", ".join(fields))})
    name, found = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for h, m in BY_FINGERPRINT.items():
        if not m.grouped:
            name, found = F.when(F.col(shape) == h, F.lit(m.name)).otherwise(name), F.when(F.col(shape) == h, F.expr(m.turns.format(r=f"{record}."))).otherwise(found)
    return df.withColumns({layout: name, turns: canonical(found)}).drop(record)


def from_table(df: DataFrame) -> DataFrame:
    """conv_id and turns of a table, by the fingerprint of its schema: one turn a row, or one record a row with a key conv_id.

    Columns that no layout knows don't count. Of one turn a row: turns are in the order of turn, equal ones by role and text, and
    keep their role names; null roles and texts are empty strings; a null conv_id is a conversation. A conversation is one row of
    the result; its turns meet in one task, which is the most that a group can be. An empty table gives an empty one.
    """
    require(df, "conv_id")
    have = schema_paths(df.schema)
    if not (m := BY_FINGERPRINT.get(fingerprint(p for p in have if p in KNOWN))):
        raise ValueError("unknown layout: " + ", ".join(sorted(have)))
    turns = F.expr(m.turns.format(r=""))
    return df.groupBy("conv_id").agg(turns.alias("turns")) if m.grouped else df.select("conv_id", canonical(turns).alias("turns"))


def formatted(df: DataFrame) -> DataFrame:
    """df (with turns) plus formatted and runs; null turns give null, no turns an empty string. Names that clash get a suffix."""
    text, runs = result_columns(df, "formatted", "runs")
    one = lambda t: F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    run = lambda n, loss: F.struct(n.cast("int").alias("n"), loss.alias("loss"))
    three = lambda t: F.array(run(F.length(escape(t["role"])) + len(ROLE + TEXT), F.lit(False)), run(F.length(escape(t["text"])), t["role"] == "assistant"), run(F.lit(len(END)), F.lit(False)))
    return df.withColumns({text: F.array_join(F.transform("turns", one), ""), runs: F.flatten(F.transform("turns", three))})


def read_back(df: DataFrame, formatted: str = "formatted", runs: str = "runs") -> DataFrame:
    """df plus read (turns) and loss (the text under the mask, unescaped), from these two columns alone.

    The string is split once at its end marks, and a turn's runs lie within its piece, so the time is linear. Null gives null. Names
    that clash get a suffix.
    """
    read, loss, pieces = result_columns(df, "read", "loss", "pieces")
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(len(ROLE) + 1)), TEXT, 1))
    text = lambda p: unescape(F.substring_index(p, TEXT, -1))
    df = df.withColumn(pieces, F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != ""))
    masked = F.transform(pieces, lambda p, i: F.when(F.get(runs, 3 * i + 1)["loss"], unescape(F.substr(p, F.get(runs, 3 * i)["n"] + 1, F.get(runs, 3 * i + 1)["n"]))).otherwise(F.lit("")))
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    return df.withColumns({read: turns, loss: F.array_join(masked, "")}).drop(pieces)
