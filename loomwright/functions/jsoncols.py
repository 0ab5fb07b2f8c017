"""JSON text columns, parsed by Spark with a declared schema."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGE_SCHEMA = "allow_unknown boolean, ages array<struct<low: bigint, high: bigint>>"
EMPTY_LONGS = "array<bigint>"


def text_or(text: Column, instead: str) -> Column:
    return F.when(text.isNull() | (F.trim(text) == ""), F.lit(instead)).otherwise(text)


def age_targets(text: Column) -> tuple[Column, Column, Column]:
    """Allow-unknown flag, low ends and high ends; nothing given means true and no ranges."""
    parsed = F.from_json(text_or(text, "{}"), AGE_SCHEMA)
    none = F.array().cast(EMPTY_LONGS)
    ages = parsed["ages"]
    return (
        F.coalesce(parsed["allow_unknown"], F.lit(True)),
        F.coalesce(F.transform(ages, lambda a: a["low"]), none),
        F.coalesce(F.transform(ages, lambda a: a["high"]), none),
    )


def typed_text(types: Column, texts: Column, kind: str, separator: str = ". ") -> Column:
    """Texts whose type is ``kind``, joined; empty when either list is missing."""
    kinds = F.from_json(types, "array<string>")
    words = F.from_json(texts, "array<string>")
    pairs = F.zip_with(kinds, words, lambda t, x: F.struct(t.alias("t"), x.alias("x")))
    kept = F.transform(F.filter(pairs, lambda p: p["t"] == F.lit(kind)), lambda p: p["x"])
    return F.coalesce(F.array_join(kept, separator), F.lit(""))


def object_ids(text: Column, field: str = "id") -> Column:
    """The ids of a JSON list of objects; NULL when empty text or no list."""
    items = F.from_json(F.when(F.length(text) > 0, text), f"array<struct<`{field}`: bigint>>")
    return F.when(F.try_parse_json(text).isNotNull(), F.transform(items, lambda x: x[field]))


def string_list(text: Column) -> Column:
    """A list from JSON, from a quoted literal, or from comma-separated words; never evaluated.

    Only text in brackets is handed to the parser, and text in braces is no list.
    """
    quoted = F.replace(text, F.lit("'"), F.lit('"'))
    bracketed = text.rlike(r"^\s*\[[\s\S]*\]\s*$")
    words = F.when(
        F.contains(text, F.lit(",")) & ~text.rlike(r"^\s*\{"),
        F.split(F.regexp_replace(text, F.lit(r"[\[\] ]"), F.lit("")), ","),
    )
    return (
        F.when(bracketed & F.try_parse_json(text).isNotNull(), F.from_json(text, "array<string>"))
        .when(bracketed & F.try_parse_json(quoted).isNotNull(), F.from_json(quoted, "array<string>"))
        .otherwise(words)
    )


def json_list(text: Column, element: str = "string") -> Column:
    return F.from_json(text, f"array<{element}>")


SHAPE_TOKEN = re.compile(r"`(?:[^`]|``)*`|[A-Za-z0-9_]+|[<>,:()]")
# How inferred kinds of JSON values become column types; whatever is mixed or unknown stays text.
SHAPE_TYPES = {"BIGINT": T.LongType(), "DECIMAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def shape_type(shape: str | None) -> T.DataType:
    """The inferred shape of JSON values (as Spark's variant functions write it) as a column type.

    Objects become structs and lists arrays, at any depth; fractions are doubles; names are taken as they are.
    """
    tokens = SHAPE_TOKEN.findall(shape or "VOID")
    at = 0

    def taken() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def kind() -> T.DataType:
        word = taken()
        if word == "ARRAY":
            taken()
            inner = kind()
            taken()
            return T.ArrayType(inner)
        if word == "OBJECT":
            taken()
            fields = []
            while tokens[at] != ">":
                name = taken()
                name = name[1:-1].replace("``", "`") if name.startswith("`") else name
                taken()
                fields.append(T.StructField(name, kind()))
                if tokens[at] == ",":
                    taken()
            taken()
            return T.StructType(fields) if fields else T.StringType()
        if at < len(tokens) and tokens[at] == "(":
            while taken() != ")":
                pass
        return SHAPE_TYPES.get(word, T.StringType())

    return kind()


def shape_of(text: Column) -> Column:
    """Aggregate: the merged shape of JSON texts; texts that are no JSON are skipped."""
    return F.schema_of_variant_agg(F.try_parse_json(text))
