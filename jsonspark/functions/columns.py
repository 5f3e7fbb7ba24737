"""Column functions, SQL functions and the table function."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import BooleanConversion, Config, DateConversion, NullConversion, NumberConversion
from ..kernel import kernel
from ..operators.documents import document_column, entries_column

ALL = {"dates": DateConversion(True), "nulls": NullConversion(True), "booleans": BooleanConversion(True), "numbers": NumberConversion(True)}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_flatten(c: Column | str, config: Config = Config()) -> Column:
    """JSON text to flat JSON text."""
    return document_column(replace(config, mode="flatten"))(_column(c))


def json_unflatten(c: Column | str, config: Config = Config()) -> Column:
    """Flat JSON text to nested JSON text."""
    return document_column(replace(config, mode="unflatten"))(_column(c))


def json_normal(c: Column | str, config: Config = Config()) -> Column:
    """JSON text to JSON text of the same structure, filtered and rewritten."""
    return document_column(replace(config, mode="normal"))(_column(c))


def json_convert(c: Column | str, config: Config = Config(**ALL)) -> Column:
    """A plain string to the JSON text of its converted value, by expressions alone."""
    from .exprs import bound, converted

    def shown(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        listed = F.to_json(F.array(text))
        return F.when(kind == 0, F.lit("null")).when(kind.isin(1, 2, 4), text).otherwise(F.substr(listed, F.lit(2), F.length(listed) - 2))

    return bound(converted(_column(c), config), shown)


def json_entries(c: Column | str, config: Config = Config()) -> Column:
    """JSON text to array<struct<key, value>> of its leaves."""
    return entries_column(replace(config, mode="flatten"))(_column(c))


def entries_table(config: Config = Config()):
    """A table function json_entries(doc): (pos, key, kind, value), one row a leaf."""
    wire = replace(config, mode="flatten").to_json()

    @F.udtf(returnType="pos int, key string, kind string, value string")
    class Entries:
        def eval(self, doc: str):
            if doc is None:
                return
            for pos, (key, value) in enumerate(kernel(wire).entries(doc)):
                first = value[:1]
                kind = "string" if first == '"' else "object" if first == "{" else "array" if first == "[" else "null" if value == "null" else "boolean" if first in "tf" else "number"
                yield pos, key, kind, value

    return Entries


def register(spark: SparkSession, config: Config = Config()) -> None:
    """Registers json_flatten, json_unflatten, json_normal, json_clean_convert and the table function json_entries for SQL."""
    for mode in ("flatten", "unflatten", "normal"):
        spark.udf.register(f"json_{mode}", document_column(replace(config, mode=mode)))
    spark.udf.register("json_clean_convert", document_column(replace(config, mode="normal", **ALL)))
    spark.udtf.register("json_entries", entries_table(config))
