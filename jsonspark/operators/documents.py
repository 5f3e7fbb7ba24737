"""Document operators over a column of JSON text: one Arrow-batched pass, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..errors import JsonSparkError
from ..kernel import kernel

ERROR = "struct<code:string,message:string>"


def document_column(config: Config):
    """A Column function that applies the configured mode to JSON text; a null stays null, an error fails the query."""
    wire = config.checked().to_json()

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        run = kernel(wire)
        return pa.array([run(t) for t in texts.to_pylist()], pa.string())

    return apply


def tolerant_column(config: Config):
    """The same with the error in place of an exception: struct<value, error>."""
    wire = config.checked().to_json()
    kind = pa.struct([("value", pa.string()), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])

    @F.arrow_udf(f"struct<value:string,error:{ERROR}>")
    def apply(texts: pa.Array) -> pa.Array:
        run, out = kernel(wire), []
        for t in texts.to_pylist():
            try:
                out.append({"value": run(t), "error": None})
            except JsonSparkError as e:
                out.append({"value": None, "error": {"code": e.code, "message": str(e)}})
        return pa.array(out, kind)

    return apply


def entries_column(config: Config):
    """A Column function: JSON text to array<struct<key, value>>, the leaves in order (value is JSON text)."""
    wire = config.checked().to_json()
    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))

    @F.arrow_udf("array<struct<key:string,value:string>>")
    def apply(texts: pa.Array) -> pa.Array:
        k = kernel(wire)
        return pa.array([None if t is None else [{"key": a, "value": b} for a, b in k.entries(t)] for t in texts.to_pylist()], kind)

    return apply


def transform_documents(df: DataFrame, column: str, config: Config, permissive: bool = False) -> DataFrame:
    """Replaces a column of JSON text by its result; ``permissive`` adds ``_error`` and nulls the bad documents."""
    quoted = F.col(f"`{column}`")
    if not permissive:
        return df.withColumn(column, document_column(config)(quoted))
    done = df.withColumn("__done", tolerant_column(config)(quoted))
    return done.withColumn(column, F.col("__done.value")).withColumn("_error", F.col("__done.error")).drop("__done")


def long_form(df: DataFrame, column: str, config: Config) -> DataFrame:
    """One row a leaf: the other columns, then pos, key and value (JSON text)."""
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, entries_column(config)(F.col(f"`{column}`")).alias("__e")).select(
        *others, F.posexplode("__e").alias("pos", "__x")
    ).select(*others, "pos", F.col("__x.key").alias("key"), F.col("__x.value").alias("value"))


def by_place(df: DataFrame) -> DataFrame:
    """The frame with columns c0, c1, ...: names may differ in case alone, or be the same."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def rows_as_documents(df: DataFrame) -> DataFrame:
    """Every row as one JSON document in the column doc, null fields included."""
    fields = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    return by_place(df).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("doc"))


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


