"""Streams of documents: every operator but schema discovery is stateless, so it runs on them as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..config import Config
from ..operators.documents import transform_documents
from ..operators.normalise import normalise


def read_ndjson_stream(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """A stream of the lines of the files that arrive in a folder."""
    return spark.readStream.format("text").load(path).withColumnRenamed("value", column)


def transform_stream(stream: DataFrame, column: str, config: Config, permissive: bool = True) -> DataFrame:
    """A stream with its documents transformed; a bad one gets an _error instead of ending the stream."""
    return transform_documents(stream, column, config, permissive)


def normalise_stream(stream: DataFrame, column: str, config: Config, schema: T.StructType) -> DataFrame:
    """A stream as typed columns; the schema has to be known."""
    return normalise(stream, column, config, schema)


def normalise_batches(column: str, config: Config, write):
    """A function for foreachBatch: each batch gets the schema of its own documents and goes to write(df, batch_id)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write(normalise(batch, column, config), batch_id)
        finally:
            batch.unpersist()

    return handle
