"""Chat formatting by schema fingerprint, in DataFrame functions only.

A record's nested field paths, of those that any layout knows, are hashed to a
fingerprint; each known fingerprint selects a declarative mapping to canonical
turns (role, text).  Paths that no layout knows do not count, so further keys
change nothing; where paths of several layouts meet, the first layout all of
whose paths are there is taken.  Tables of turn rows are fingerprinted once by
their schema, JSON payloads row by row.  The template writes

    <|im_start|>ROLE \\n TEXT <|im_end|> \\n

for each turn.  Control strings inside roles and texts are broken up by a
backslash after their first character, and backslashes are doubled, so that
taking one backslash off every escaped character restores the text.

Defined cases: a null text or role counts as empty; turns are ordered by
turn, role, text, nulls first, and repeated rows are turns of their own; a
payload of unknown fingerprint, or none, gives null turns, one with an empty
list of messages none; extra columns are ignored; a conversation without rows does not exist.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Turns put together first, so that one long conversation is not gathered row by row in one task.
CHUNK = 64

_CONTROL_RE = r"(\\|<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|\[(?=/?INST\]))"
TURNS = "array<struct<role: string, text: string>>"


# -- fingerprints and mappings ------------------------------------------------


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, sorted; [] stands for the elements of an array."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> int:
    """Hash of a set of paths; the types at the leaves do not count."""
    digest = hashlib.sha256("\n".join(sorted(set(paths))).encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def _messages(path: str, role: str, text: str):
    def turns(v: Column) -> Column:
        got = F.try_variant_get(v, path, f"array<struct<{role}: string, {text}: string>>")
        known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        return F.transform(got, lambda m: F.struct(F.coalesce(known[m[role]], m[role]).alias("role"), m[text].alias("text")))

    return turns


def _pair(ask: tuple[str, ...], answer: str, system: str | None = None):
    """A prompt of one or more fields, joined by line feeds where not empty, and its answer."""

    def turns(v: Column) -> Column:
        field = lambda f: F.try_variant_get(v, f"$.{f}", "string")
        turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
        prompt = F.array_join(F.filter(F.array(*map(field, ask)), lambda x: x != ""), "\n")
        both = [turn("user", prompt), turn("assistant", field(answer))]
        return F.array(*([turn("system", field(system))] if system else []), *both)

    return turns


#: The paths of each layout and the mapping that their fingerprint selects.
LAYOUTS = (
    (("messages[].role", "messages[].content"), _messages("$.messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), _messages("$.conversations", "from", "value")),
    (("turns[].speaker", "turns[].text"), _messages("$.turns", "speaker", "text")),
    (("instruction", "input", "output"), _pair(("instruction", "input"), "output")),
    (("instruction", "output"), _pair(("instruction",), "output")),
    (("prompt", "completion"), _pair(("prompt",), "completion")),
    (("system_prompt", "question", "response"), _pair(("question",), "response", "system_prompt")),
    (("prompt", "response"), _pair(("prompt",), "response")),
)


def _hashed(paths: Column) -> Column:
    """``fingerprint`` of a column of path arrays."""
    return F.conv(F.substring(F.sha2(F.encode(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), "UTF-8"), 256), 1, 16), 16, -10).cast("long")


def payload_paths(payload: Column, layouts=LAYOUTS) -> Column:
    """The paths of a JSON record that any layout knows; a list stands for the paths of all its elements, an empty one for itself."""
    known = sorted({p for paths, _ in layouts for p in paths})
    lists = sorted({p.split("[].")[0] for p in known if "[]." in p})
    keys = F.json_object_keys(payload)
    parts = [F.filter(keys, lambda k: k.isin([p for p in known if "[]" not in p]))]
    for name in lists:
        elements = F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>")
        inner = F.array_distinct(F.flatten(F.transform(elements, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))))
        own = F.filter(F.transform(inner, lambda k: F.concat(F.lit(f"{name}[]."), k)), lambda p: p.isin(known))
        empty = F.get_json_object(payload, f"$.{name}") == "[]"
        parts.append(F.when(empty, F.array(F.lit(f"{name}[]"))).otherwise(own))
    nothing = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(p, nothing) for p in parts])


def turns_of_payload(payload: Column, layouts=LAYOUTS) -> Column:
    """Canonical turns of a JSON record, by the mapping its fingerprint selects."""
    v = F.try_parse_json(payload)
    paths = payload_paths(payload, layouts)
    fp = _hashed(paths)
    out = F.lit(None).cast(TURNS)
    for own, mapping in reversed(layouts):  # where paths of several meet: the first that is there whole
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, own)), paths)) == 0, mapping(v).cast(TURNS)).otherwise(out)
    for own, mapping in layouts:
        keys = [fingerprint(own)] + [fingerprint([own[0].split(".")[0]])] * ("[]." in own[0])
        out = F.when(fp.isin(keys), mapping(v).cast(TURNS)).otherwise(out)
    return out


#: Paths of turn-row tables: their columns for conversation, turn, role and text.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "index", "from", "value"), ("dialog_id", "position", "speaker", "utterance"))


def canonical_rows(df: DataFrame, layouts=ROW_LAYOUTS) -> DataFrame:
    """Turn rows under the names conv_id, turn, role, text, by the mapping that the fingerprint of the table's own paths selects."""
    paths = schema_paths(df.schema)
    known = [p for p in paths if any(p in own for own in layouts)]
    cols = {fingerprint(own): own for own in layouts}.get(fingerprint(known)) or next((own for own in layouts if set(own) <= set(known)), None)
    if cols is None:
        raise ValueError(f"no mapping for a table with the paths {paths}")
    return df.select(*[F.col(f"`{c}`").alias(name) for c, name in zip(cols, ("conv_id", "turn", "role", "text"))])


# -- the template ---------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_RE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    role = F.regexp_replace(escape(F.coalesce(role, F.lit(""))), "\n", "\\\\\n")
    return F.concat(F.lit(START), role, F.lit("\n"), escape(F.coalesce(text, F.lit(""))), F.lit(END + "\n"))


def format_rows(rows: DataFrame) -> DataFrame:
    """conv_id, formatted: one string a conversation.

    Put together in two steps, chunks of turns first; the last step gathers one
    string for every CHUNK turn numbers, as its result is one string.
    """
    part = F.floor(F.col("turn") / CHUNK)
    chunks = rows.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: format_turn(t["role"], t["text"])), "")
    whole = chunks.select("conv_id", "part", text.alias("formatted")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "formatted"))).alias("parts"))
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    head = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(b: Column) -> Column:
        role = F.regexp_extract(b, head, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(b, F.length(role) + len(START) + 2)).alias("text"))

    return F.transform(blocks, turn)


def loss_spans(formatted: Column) -> Column:
    """What the loss mask covers: start and stop (code points) in the formatted string of assistants' texts, and what stands there."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")
    nothing = F.array().cast("array<struct<start: int, stop: int, text: string>>")
    head = START + "assistant\n"

    def step(acc: Column, b: Column) -> Column:
        n = F.length(b)
        span = F.struct((acc["at"] + len(head)).alias("start"), (acc["at"] + n).alias("stop"), F.substr(b, F.lit(len(head) + 1)).alias("text"))
        spans = F.when(F.startswith(b, F.lit(head)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + n + len(END) + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nothing.alias("spans")), step, lambda acc: acc["spans"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    rows = canonical_rows(C.table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = format_rows(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(loss_spans(F.col("formatted")), lambda s: unescape(s["text"])), "")
    return out.withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
QUERIES = {"op7_chat_format": op7_chat_format}
ORACLE_SQL = {
    "op7_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
clean AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t,
         length({_sql_escape("coalesce(text, '')")}) + length(replace({_sql_escape("coalesce(role, '')")}, chr(10), '\\' || chr(10))) + {len(START + END) + 2} AS n FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {_ORDER})) AS turns_sha256,
       coalesce(sum(CASE WHEN r = 'assistant' THEN length(t) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' {_ORDER}), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM clean GROUP BY conv_id"""
}
