"""Operator 8: chat formatting by schema fingerprints. DataFrame functions only.

A record is any nested value (a struct, or JSON text). Its fingerprint is a
hash of its nested field paths without the types of the leaves; it selects a
declarative mapping from the record's layout to canonical turns (turn, role,
text). A record with further fields takes the mapping of the most paths that it
has all of (the first declared of equally many): the hash of those of the
mapping's paths that it has is the mapping's own; its other fields are left out. Turns of one conversation are joined in order and written with the
template

    <|im_start|>ROLE NEWLINE TEXT <|im_end|> NEWLINE

Control strings inside texts and roles are escaped reversibly: a backslash is
put behind every ``<``, ``[`` and backslash, so that no control string survives
and reading back drops it again; a line break in a role becomes ``[n``, which
nothing else does, so that a role ends at the first line break. The
loss mask is a list of [start, end) in code points of the formatted text, one
for each assistant text.

Null text and null role count as empty; a null turn sorts first; turns that tie
are ordered by role, then text. Repeated rows are turns each. A record that has
the paths of no mapping, or that isn't JSON, gives no turns and is counted in
``unknown``; one with an empty list of messages is known and has none. An empty table gives no rows. Other columns are ignored. A
conversation is one value, so one task formats it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURNS = "array<struct<turn: bigint, role: string, text: string>>"
#: Names of roles in message layouts; others are kept as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_LEAVES = r"(:\s*)(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID|DECIMAL\(\d+,\s*\d+\))"
_ITEMS = r"(ARRAY<)(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID|DECIMAL\(\d+,\s*\d+\))"


@dataclass(frozen=True)
class Mapping:
    """A layout by an example of its paths, and how its turns are built from the record ``r``."""

    name: str
    example: str
    turns: str
    paths: tuple[str, ...]


def _get(path: str, kind: str = "string") -> str:
    return f"try_variant_get(r, '$.{path}', '{kind}')"


def _dialogue(*pairs: tuple[str, str]) -> str:
    parts = ", ".join(f"named_struct('turn', {i}L, 'role', '{role}', 'text', {text})" for i, (role, text) in enumerate(pairs))
    return f"array({parts})"


def _messages(path: str, role: str, text: str) -> str:
    known = ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items())
    return f"transform({_get(path, f'array<struct<`{role}`: string, `{text}`: string>>')}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', coalesce(element_at(map({known}), m.`{role}`), m.`{role}`), 'text', m.`{text}`))"


def _after_system(turns: str) -> str:
    """A system turn, where the record's field has a text, before the others."""
    said = _get("system")
    return f"concat(if(coalesce({said}, '') = '', array(), array(named_struct('turn', -1L, 'role', 'system', 'text', {said}))), {turns})"


_ASK = f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"
_MESSAGES, _CONVERSATIONS = _messages("messages", "role", "content"), _messages("conversations", "from", "value")
MAPPINGS = (
    Mapping("turn rows", '{"role":"","text":"","turn":0}', f"array(named_struct('turn', {_get('turn', 'bigint')}, 'role', {_get('role')}, 'text', {_get('text')}))", ("turn", "role", "text")),
    Mapping("prompt and response", '{"prompt":"","response":""}', _dialogue(("user", _get("prompt")), ("assistant", _get("response"))), ("prompt", "response")),
    Mapping("prompt and completion", '{"completion":"","prompt":""}', _dialogue(("user", _get("prompt")), ("assistant", _get("completion"))), ("prompt", "completion")),
    Mapping("question and answer", '{"answer":"","question":""}', _dialogue(("user", _get("question")), ("assistant", _get("answer"))), ("question", "answer")),
    Mapping("instruction", '{"instruction":"","output":""}', _dialogue(("user", _get("instruction")), ("assistant", _get("output"))), ("instruction", "output")),
    Mapping("instruction with input", '{"input":"","instruction":"","output":""}', _dialogue(("user", _ASK), ("assistant", _get("output"))), ("instruction", "input", "output")),
    Mapping("messages", '{"messages":[{"content":"","role":""}]}', _MESSAGES, ("messages[].role", "messages[].content")),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', _CONVERSATIONS, ("conversations[].from", "conversations[].value")),
    Mapping("messages after a system text", '{"messages":[{"content":"","role":""}],"system":""}', _after_system(_MESSAGES), ("messages[].role", "messages[].content", "system")),
    Mapping("conversations after a system text", '{"conversations":[{"from":"","value":""}],"system":""}', _after_system(_CONVERSATIONS), ("conversations[].from", "conversations[].value", "system")),
)


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant."""
    paths = F.schema_of_variant(record)
    return F.xxhash64(F.regexp_replace(F.regexp_replace(paths, _LEAVES, "$1_"), _ITEMS, "$1_"))


def _has(path: str) -> Column:
    """Whether ``r`` has a path; an empty list has those of its items."""
    head, _, item = path.partition("[].")
    if not item:
        return F.expr(f"try_variant_get(r, '$.{head}', 'variant') is not null")
    items = f"try_variant_get(r, '$.{head}', 'array<variant>')"
    return F.expr(f"coalesce(size({items}) = 0 or exists({items}, m -> try_variant_get(m, '$.{item}', 'variant') is not null), false)")


def _paths_hash(paths: tuple[str, ...]) -> Column:
    """Hash of those of the paths that ``r`` has."""
    return F.xxhash64(F.concat_ws("\n", *(F.when(_has(p), F.lit(p)) for p in sorted(paths))))


def canonical_turns(records: DataFrame, record_col: str = "r") -> DataFrame:
    """``records`` with ``turns`` by the mapping that the fingerprint of the variant column selects; null if none does."""
    out = F.lit(None).cast(_TURNS)
    for m in sorted(reversed(MAPPINGS), key=lambda m: len(m.paths)):  # the last one asked is the most specific
        out = F.when(_paths_hash(m.paths) == F.xxhash64(F.lit("\n".join(sorted(m.paths)))), F.expr(m.turns).cast(_TURNS)).otherwise(out)
    for m in MAPPINGS:
        known = fingerprint(F.parse_json(F.lit(m.example)))
        out = F.when(F.col("layout") == known, F.expr(m.turns).cast(_TURNS)).otherwise(out)
    return records.withColumn("r", F.col(record_col)).withColumn("layout", fingerprint(F.col("r"))).withColumn("turns", out)


def escape(text: Column, role: bool = False) -> Column:
    marked = F.regexp_replace(text, r"([<\[\\])", r"$1\\")
    return F.replace(marked, F.lit("\n"), F.lit("[n")) if role else marked


def unescape(text: Column, role: bool = False) -> Column:
    plain = F.replace(text, F.lit("[n"), F.lit("\n")) if role else text
    return F.regexp_replace(plain, r"([<\[\\])\\", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns`` (canonical, any number of rows) to conv_id, formatted, loss_mask, unknown."""
    rows = turns.select("conv_id", F.coalesce(F.size("turns"), F.lit(-1)).alias("known"), F.explode_outer("turns").alias("t"))
    text = lambda c: F.coalesce(c, F.lit(""))
    shown = F.struct("t.turn", text(F.col("t.role")).alias("role"), text(F.col("t.text")).alias("text"))
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), shown))).alias("turns"), F.sum((F.col("known") < 0).cast("long")).alias("unknown"))
    piece = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"], True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    pieces = joined.select("conv_id", "unknown", piece.alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["body"])
        spans = F.when(p["loss"], F.concat(state["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), spans.alias("spans"))

    formatted = F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))))
    return pieces.select("conv_id", formatted.alias("formatted"), F.aggregate("pieces", start, step)["spans"].alias("loss_mask"), "unknown")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role, text) and ``loss`` (the unescaped texts under the mask), from the output alone; ``unknown`` as it was."""
    chunks = F.expr(r"filter(split(formatted, '<\\|im_start\\|>'), (c, i) -> i > 0)")
    parts = F.transform(chunks, lambda c: F.split(c, "\n", 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.element_at(p, 1), True).alias("role"), unescape(F.substring_index(F.element_at(p, 2), "<|im_end|>", 1)).alias("text")))
    loss = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"), "unknown")


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Formats rows by turn and returns what the output says: counts, digests, lengths; and how many records no mapping knew."""
    rows = conversations.select("conv_id", F.to_variant_object(F.struct(F.col("turn"), F.col("role"), F.col("text"))).alias("r"))
    done = read_back(format_turns(canonical_turns(rows).select("conv_id", "turns")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    under = F.concat_ws("", F.col("loss"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.col("unknown").alias("n_unknown"),
    )


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7: a user, then an assistant row, both saying control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(regexp_replace(role, '[<\[\\\n]', 'xx', 'g')) + 1 + length(regexp_replace(text, '[<\[\\]', 'xx', 'g')) + 11) AS chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_unknown FROM joined
"""
