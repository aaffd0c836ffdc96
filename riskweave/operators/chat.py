"""Chat records: flatten dynamic JSON to turns and audit what an assistant said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import emit
from ..tables import contexts as values
from .verdicts import add_verdict, guard_envelope


def _variant(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    """'STRING', 'ARRAY', 'OBJECT' or another type name; NULL for a missing value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _has(value: Column, key: str) -> Column:
    """Key presence; a JSON null counts as present."""
    return _variant(value, f"$.{key}", "variant").isNotNull()


# Keys of a content object that carry text, in reading order.
_TEXT_KEYS = ("text", "content", "output_text", "message")


def json_depth(text: Column) -> Column:
    """How deep the containers of a JSON text are nested: the highest running count of open brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"?', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, char: Column) -> Column:
        now = state.now + F.when(char.isin("[", "{"), 1).when(char.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state.most, now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda state: state.most)


def text_fragments(content: Column, depth: Column, max_depth: int | None = None) -> Column:
    """Texts of a nested content value in reading order, as ``array<string>``.

    Each step replaces containers by their children in place, so after ``depth`` steps, the nesting of the record,
    all texts stand in one flat list. ``max_depth`` stops earlier (8 as published) and loses what lies below.
    """
    def open_one(item):
        kind = _kind(item)
        inner = F.array_compact(F.array(*[_variant(item, f"$.{key}", "variant") for key in _TEXT_KEYS]))
        return (F.when(kind == "STRING", F.array(item))
                .when(kind == "ARRAY", F.array_compact(_variant(item, "$", "array<variant>")))
                .when(kind == "OBJECT", inner))

    def opened(items):
        return F.flatten(F.array_compact(F.transform(items, open_one)))

    steps = depth if max_depth is None else F.least(depth, F.lit(max_depth))
    # The first step sets the type: a list of values.
    items = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), F.array(content), lambda items, _: opened(items))
    return F.transform(F.filter(items, lambda item: _kind(item) == "STRING"), lambda item: _variant(item, "$", "string"))


def flatten_chat(df: DataFrame, *, keys: list[str], json_col: str = "record", max_bytes: int | None = None,
                 max_depth: int | None = None, keep_bad: bool = False) -> DataFrame:
    """Chat records of any shape and depth to ``(*keys, role, text)``.

    Takes ``{role, content}`` and ``{message: {role, content}}``; content may be
    text, a list or nested objects. Role and content of the message come before
    those of the record. Records that are no objects give an empty text. JSON
    that does not parse, or is longer than ``max_bytes`` if given, raises; with ``keep_bad`` it fails nothing, and a column
    ``problem`` says what is wrong (the JSON parser itself takes about 1000 levels).
    """
    record = F.col("_r")
    df = df.select(*keys, F.col(json_col).alias("_json"))
    too_long = F.octet_length("_json") > max_bytes if max_bytes is not None else F.lit(False)
    if keep_bad:
        df = df.withColumn("_r", F.when(~too_long, F.try_parse_json("_json")))
        df = df.withColumn("problem", F.when(too_long, "too long").when(record.isNull(), "not JSON"))
    else:
        df = df.withColumn("_r", F.when(too_long, F.raise_error(F.lit("chat record exceeds size limit")).cast("variant")).otherwise(F.parse_json("_json")))
    message = F.when(_kind(_variant(record, "$.message", "variant")) == "OBJECT", _variant(record, "$.message", "variant"))
    outer_role = _variant(record, "$.role", "variant")
    df = df.withColumns({"_m": message, "_role": outer_role, "_depth": json_depth(F.col("_json"))})
    in_message = F.col("_m").isNotNull()
    role = F.when(in_message & _has(F.col("_m"), "role"), _variant(F.col("_m"), "$.role", "variant")).otherwise(F.col("_role"))
    own = _variant(record, "$.content", "variant")
    content = (F.when(in_message, F.coalesce(_variant(F.col("_m"), "$.content", "variant"), own))
               .otherwise(F.coalesce(own, _variant(record, "$.output", "variant"))))
    df = df.withColumns({"_role": role, "_content": content})
    fragments = F.filter(text_fragments(F.col("_content"), F.col("_depth"), max_depth), lambda t: t != "")
    return emit(df, [*keys, "problem"] if keep_bad else keys, F.struct(
        F.when(_kind(F.col("_role")) == "STRING", F.lower(_variant(F.col("_role"), "$", "string"))).alias("role"),
        F.coalesce(F.array_join(fragments, "\n"), F.lit("")).alias("text")))


def assistant_turns(flat: DataFrame) -> DataFrame:
    """Turns with text that an assistant wrote."""
    return flat.filter(F.lower("role").isin(*values.ASSISTANT_ROLES) & (F.length("text") > 0))


def audit_conversations(turns: DataFrame, *, keys: list[str], **options) -> DataFrame:
    """Guard verdicts of the assistant turns in ``(*keys, role, text)``."""
    return guard_envelope(assistant_turns(turns), keys=keys, **options)


def audit_rollup(audited: DataFrame, *, by: list[str]) -> DataFrame:
    """Turns scanned, flagged and the highest code per group and over all (NULL group)."""
    return audited.rollup(*by).agg(
        F.count("*").alias("scanned"), F.count_if(F.col("code") > 0).alias("flagged"),
        F.max("code").alias("highest_code"))


def strict_content(df: DataFrame, *, keys: list[str], json_col: str = "record") -> DataFrame:
    """The guard's input form: ``(*keys, text, valid)``.

    Content must be text or a list of texts and ``{text}`` objects; anything
    else, and JSON that does not parse, is invalid.
    """
    parsed = F.try_parse_json(F.col(json_col))
    df = df.select(*keys, parsed.alias("_r"))
    has_message = _has(F.col("_r"), "message")
    holder = F.when(has_message, _variant(F.col("_r"), "$.message", "variant")).otherwise(F.col("_r"))
    df = df.withColumn("_h", F.when(_kind(F.col("_r")) == "OBJECT", holder))
    df = df.withColumn("_c", F.when(_kind(F.col("_h")) == "OBJECT", _variant(F.col("_h"), "$.content", "variant")))
    kind = _kind(F.col("_c"))

    def part(item):
        inner = _variant(item, "$.text", "variant")
        return (F.when(_kind(item) == "STRING", _variant(item, "$", "string"))
                .when((_kind(item) == "OBJECT") & (_kind(inner) == "STRING"), _variant(inner, "$", "string")))

    parts = F.transform(_variant(F.col("_c"), "$", "array<variant>"), part)
    df = df.withColumn("_parts", F.when(kind == "STRING", F.array(_variant(F.col("_c"), "$", "string")))
                       .when(kind == "ARRAY", parts))
    valid = F.col("_parts").isNotNull() & ~F.exists("_parts", lambda p: p.isNull())
    valid = F.coalesce(valid, F.lit(False))
    return df.select(*keys, F.when(valid, F.array_join("_parts", "\n")).alias("text"), valid.alias("valid"))


def guard_json(df: DataFrame, *, keys: list[str], json_col: str = "record", **options) -> DataFrame:
    """Guard verdicts of JSON messages; invalid input is dangerous."""
    strict = strict_content(df, keys=keys, json_col=json_col)
    judged = add_verdict(strict, "text", "_v", **options)
    code = F.when(F.col("valid"), F.col("_v.code")).otherwise(F.lit(2))
    return judged.select(
        *keys, (code == 0).alias("allowed"),
        F.when(F.col("valid"), F.col("_v.action")).otherwise(F.lit("DANGEROUS")).alias("verdict"), code.alias("code"),
        F.when(F.col("valid"), F.col("_v.reasons")).otherwise(F.array(F.lit(values.INPUT_ERROR_REASON))).alias("reasons"),
        F.when(F.col("valid"), F.col("_v.matched")).alias("matched"))


def chat_export(turns: DataFrame, *, order: list[str], role: str = "assistant") -> DataFrame:
    """A message table as export records ``(*order, record)``, one JSON object each."""
    return (turns.filter(F.col("role") == role)
            .select(*order, F.to_json(F.struct("role", F.col("text").alias("content"))).alias("record")))
