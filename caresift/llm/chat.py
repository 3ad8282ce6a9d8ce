"""Chat records of many layouts as canonical turns, and turns as training text.

A record's nested field paths are hashed, and the hash selects one of the declared mappings, which says where roles and
texts stand.  DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: In this order forwards and in the other one back; afterwards no text holds "<" or "[".
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Either ``items`` (path, role field, text field), or ``turns`` of (role or path of a role, path of a text)."""

    name: str
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.items:
            return [f"$.{self.items[0]}[0].{x}" for x in self.items[1:]]
        return [x for pair in self.turns for x in pair if x.startswith("$")]


def _single() -> list[Layout]:
    asked = {
        "prompt_response": (("user", "$.prompt"), ("assistant", "$.response")),
        "prompt_completion": (("user", "$.prompt"), ("assistant", "$.completion")),
        "question_answer": (("user", "$.question"), ("assistant", "$.answer")),
        "instruction_output": (("user", "$.instruction"), ("assistant", "$.output")),
        "instruction_input_output": (("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    }
    plain = [Layout(name, turns=turns) for name, turns in asked.items()]
    return plain + [Layout(f"system_{x.name}", turns=(("system", "$.system"), *x.turns)) for x in plain]


LAYOUTS = (
    Layout("row", turns=(("$.role", "$.text"),)),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    *_single(),
)


def _fingerprint(paths: list[str]) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """SHA-256 of those declared field paths that a variant has, joined in order; other fields don't count."""
    every = sorted({p for x in layouts for p in x.paths()})
    there = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in every]
    return F.sha2(F.concat_ws("\n", *there), 256)


def _fields(turn, role: str, text: str):
    return lambda item: turn(item[role], item[text])


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout string`` and ``turns array<struct<role, text>>`` for JSON text in the column ``record``.

    Null or malformed JSON, and paths of no declared layout, give a null layout and no turns; a null role or text is "".
    Role names in ROLES are replaced; others stay.  An empty ``input`` beside an instruction stays a turn.
    """
    parsed = df.withColumn("__record", F.try_parse_json(F.col(record)))
    parsed = parsed.withColumn("__print", fingerprint(F.col("__record"), layouts))
    made, name = F.array().cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(role: Column, text: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        return F.struct(F.coalesce(F.element_at(known, role), role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    string = lambda path: F.try_variant_get(F.col("__record"), path, "string")
    for x in layouts:
        if x.items:
            path, role, text = x.items
            items = F.try_variant_get(F.col("__record"), f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = F.transform(items, _fields(turn, role, text))
        else:
            turns = F.array(*[turn(string(r) if r.startswith("$") else F.lit(r), string(t)) for r, t in x.turns])
        hit = F.col("__print") == F.lit(_fingerprint(x.paths()))
        made, name = F.when(hit, turns).otherwise(made), F.when(hit, F.lit(x.name)).otherwise(name)
    return parsed.withColumns({"layout": name, "turns": F.coalesce(made, F.array().cast("array<struct<role:string,text:string>>"))}).drop("__record", "__print")


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def render(turns: DataFrame, conversation: str, order: list[str], learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation from rows with ``role`` and ``text``: ``formatted string`` and ``mask``.

    ``mask`` is an array of (chars int, loss boolean) runs that add up to the formatted text: loss holds on texts of the
    ``learned`` roles.  Turns stand by ``order``, nulls first, equal ones by role and text; a null role or text is "".
    Each turn is written before the grouping, which only joins them; a conversation has to fit in one row.
    """
    role, text = escape(F.coalesce(F.col("role"), F.lit(""))), escape(F.coalesce(F.col("text"), F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))
    loss = F.coalesce(F.col("role").isin(*learned), F.lit(False))
    written = F.struct(*[F.col(c) for c in order], head.alias("__head"), text.alias("__text"), run(F.length(head), F.lit(False)).alias("__before"), run(F.length(text), loss).alias("__own"))
    rows = turns.select(F.col(conversation), written.alias("__turn")).groupBy(conversation).agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))
    tail = run(F.lit(len(END)), F.lit(False))
    return rows.select(
        conversation,
        F.array_join(F.transform("__turns", lambda t: F.concat(t["__head"], t["__text"], F.lit(END))), "").alias("formatted"),
        F.flatten(F.transform("__turns", lambda t: F.array(t["__before"], t["__own"], tail))).alias("mask"),
    )


def read_back(formatted: Column, mask: Column) -> Column:
    """array<struct<role, text, loss>>: what ``render`` was given, from what it wrote."""
    parts = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: p != "")

    def turn(part: Column, i: Column) -> Column:
        fields = F.split(F.substring(part, len(TURN) + 1, 1 << 30), r"<\|text\|>", 2)
        return F.struct(unescape(fields[0]).alias("role"), unescape(fields[1]).alias("text"), F.get(mask, i * 3 + 1)["loss"].alias("loss"))

    return F.transform(parts, turn)


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = table.select("conv_id", "turn", F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("record"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )
    turns = canonical_turns(rows.unionByName(extra), "record")
    turns = turns.select("conv_id", "turn", F.posexplode("turns").alias("place", "said")).select("conv_id", "turn", "place", "said.role", "said.text")
    out = render(turns, "conv_id", ["turn", "place"]).withColumn("back", read_back(F.col("formatted"), F.col("mask")))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("back", lambda t: t["loss"]), lambda t: t["text"]), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = """
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, turn, coalesce(map {'human': 'user', 'prompter': 'user', 'gpt': 'assistant', 'bot': 'assistant', 'model': 'assistant'}[role], role) AS role, text FROM said
), written AS (
    SELECT *, length(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + 8 + 8 + 7 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""
