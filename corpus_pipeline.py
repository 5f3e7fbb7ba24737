"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next one's docs; all but the last return documents' columns.
Stages need one id a document; a row with a null id passes every filter.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonspark.llm.common import free_prefix, shared_folder
from jsonspark.llm.decontaminate import contamination
from jsonspark.llm.language_id import UNKNOWN, predict, train
from jsonspark.llm.near_dedup import near_duplicates
from jsonspark.llm.secret_scan import redacted, secret_scan
from jsonspark.llm.sentencepiece_bpe import encode_decode

#: Share of posterior that the language must reach; a text of two languages in equal parts stays.
LEAST_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language of that share, go."""
    own = free_prefix(docs.columns)
    labelled = predict(docs, train(docs), carry=tuple(docs.columns), prefix=own)
    return labelled.where((F.col(f"{own}lang_pred") != UNKNOWN) & (F.col(f"{own}score") >= LEAST_SHARE)).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, Jaccard similarity of 0.8) the document with the smallest id stays."""
    gone = near_duplicates(docs).where("doc_id > component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark, and n_chars follows; no document goes."""
    own = free_prefix(docs.columns)
    found = F.col(f"{own}found")
    scanned = secret_scan(docs, carry=tuple(docs.columns), prefix=own)
    clean = F.when(F.size(found) > 0, redacted(F.col("text"), found)).otherwise(F.col("text"))
    out = scanned.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    coded = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("sentencepiece", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None
