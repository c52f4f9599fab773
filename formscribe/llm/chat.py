"""Chat formatting: schema fingerprints select declarative mappings, turns go into one marked and escaped text."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: What may not stand inside a text: an opening character and one of these endings, with any backslashes between.
_TAILS = r"(/?s>|/?INST\]|\|(?:turn|text|end|im_start|im_end|endoftext)\|>)"
CONTROL = r"([<\[])(\\*)" + _TAILS
ESCAPED = r"([<\[])\\(\\*)" + _TAILS


@dataclass(frozen=True)
class Layout:
    """How one record layout becomes turns. `example` has the layout's fields; its fingerprint is computed from it.

    Either `turns` lists (role, path of the text), where a role starting with `$` is a path too, or `items` is the path
    of a list whose elements hold the role and text under `role` and `text`. `roles` renames roles.
    """

    name: str
    example: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("turn row", '{"conv_id":0,"turn":0,"role":"","text":""}', turns=(("$.role", "$.text"),)),
    Layout("messages", '{"messages":[{"role":"","content":""}]}', items="$.messages"),
    Layout(
        "from and value",
        '{"conversations":[{"from":"","value":""}]}',
        items="$.conversations",
        role="from",
        text="value",
        roles={"human": "user", "gpt": "assistant"},
    ),
    Layout("prompt and response", '{"prompt":"","response":""}', turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("prompt and completion", '{"prompt":"","completion":""}', turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("question and answer", '{"question":"","answer":""}', turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", '{"instruction":"","output":""}', turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout(
        "instruction with input",
        '{"instruction":"","input":"","output":""}',
        turns=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
    Layout(
        "system and prompt",
        '{"system":"","prompt":"","response":""}',
        turns=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")),
    ),
)


def fingerprint(record: Column) -> Column:
    """Hash of a JSON record's nested field paths, without value types; null for text that is no JSON."""
    kinds = F.schema_of_variant(F.try_parse_json(record))
    paths = F.regexp_replace(kinds, r": (?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?", "")
    paths = F.regexp_replace(paths, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]+\))?>", "ARRAY")
    return F.substring(F.sha2(paths, 256), 1, 16)


def _turns(layout: Layout, record: Column) -> Column:
    def named(role: Column) -> Column:
        out = F.coalesce(role, F.lit(""))
        for old, new in layout.roles.items():
            out = F.when(role == old, F.lit(new)).otherwise(out)
        return out

    def turn(role: Column, text: Column) -> Column:
        return F.struct(named(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.items:
        items = F.from_json(F.get_json_object(record, layout.items), "array<map<string,string>>")
        return F.transform(items, lambda m: turn(m[layout.role], m[layout.text]))
    return F.array(
        *[turn(F.get_json_object(record, r) if r.startswith("$") else F.lit(r), F.get_json_object(record, p)) for r, p in layout.turns]
    )


def canonical_turns(
    records: DataFrame, keys: list[str], record_col: str, layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """keys, layout (its name) and turns (array of role and text) of every JSON record.

    The record's fingerprint is looked up among the layouts' own; a record of an unknown layout, or no JSON, keeps its
    row with a null layout and no turns. Null roles and texts are empty strings. The fingerprint ignores value types, so
    a null text does not change the layout. Field order does not matter.
    """
    mapped = records.select(*keys, F.col(record_col).alias("record"), fingerprint(F.col(record_col)).alias("print"))
    name, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for layout in reversed(layouts):
        hit = F.col("print") == fingerprint(F.lit(layout.example))
        name = F.when(hit, F.lit(layout.name)).otherwise(name)
        turns = F.when(hit, _turns(layout, F.col("record"))).otherwise(turns)
    return mapped.select(*keys, name.alias("layout"), F.coalesce(turns, F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))


def escape(c: Column) -> Column:
    """One more backslash inside every control string, so that none is left; undone by `unescape`."""
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def format_turns(turns: DataFrame, id_col: str, order_cols: list[str], learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: id, `formatted` and `loss_mask`, the (start, length) spans of the texts to learn from.

    `turns` has one row per turn with role and text; `order_cols` order them, ties by role and text. Starts count code
    points from 1. Null roles and texts are empty; rows with a null id are one conversation.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    order = W.partitionBy("id").orderBy(*order_cols, "role", "text")
    lead = F.length("e_role") + len(OPEN) + len(MID)
    pieces = (
        turns.select(F.col(id_col).alias("id"), *order_cols, "role", "text", role.alias("e_role"), text.alias("e_text"))
        .withColumn("size", lead + F.length("e_text") + len(CLOSE))
        .select(
            "id",
            F.row_number().over(order).alias("n"),
            F.concat(F.lit(OPEN), "e_role", F.lit(MID), "e_text", F.lit(CLOSE)).alias("piece"),
            (F.col("role") == learn_from).alias("learn"),
            (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.length("e_text") - len(CLOSE) + 1).cast("int").alias("start"),
            F.length("e_text").alias("chars"),
        )
    )
    rows = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "learn", "start", "chars"))).alias("rows"))
    return rows.select(
        F.col("id").alias(id_col),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("rows", lambda r: F.coalesce(r["learn"], F.lit(False))),
            lambda r: F.struct(r["start"].alias("start"), r["chars"].alias("length")),
        ).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    parts = F.split(formatted, CLOSE.replace("|", r"\|"), -1)
    mark = rf"(?s)^{OPEN}(.*?){MID}(.*)$".replace("|", r"\|")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, mark, 1)).alias("role"), unescape(F.regexp_extract(p, mark, 2)).alias("text")
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"], m["length"]))), "")
