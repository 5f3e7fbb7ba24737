"""Pieces that several operators share: word splitting, checkpoints, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a class of a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = re.compile("[^\x20\x09-\x0d]+")
#: Maps A-Z to a-z and leaves every other character.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words_column(text: Column) -> Column:
    """Array of the words of a text; an empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower_column(text: Column) -> Column:
    """Lower-cases A-Z alone.

    Spark's lower() follows Unicode; it is safe where the text is ASCII, which
    is what most rows are, and the slower character map serves the others.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one that ``spark.checkpoint.dir`` names.

    Where neither the setting nor the context has any, a session on one machine
    (tests) gets a temporary one, removed at exit; a cluster must name its own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            named = tempfile.mkdtemp(prefix="jsonspark-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is made and run inside go as soon as it has run, and not when the driver collects its garbage.

    For chains of ``saved`` steps, whose shuffles nothing reads again.  Make a
    DataFrame that is returned after the block: it may run more than once.  The
    setting is the session's, so what another thread makes meanwhile and runs twice
    is worked out twice.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column has, for names of a step's own."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, by one cheap aggregation."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def group_count(total_bytes: int, each: int, least: int = 1) -> int:
    """How many groups of about ``each`` bytes hold ``total_bytes``."""
    return max(least, -(-total_bytes // each))


def grown(total_bytes: int, least: int, most: int, known: int = 50_000_000_000) -> int:
    """A size that is ``least`` up to ``known`` bytes of text and then grows with their root, up to ``most``.

    Groups and buckets both grow so: what a group sends to a bucket stays about
    as large, and the number of such cells grows no faster than the input.
    """
    return int(min(most, least * max(1.0, (total_bytes / known) ** 0.5)))


def connected_components(links: DataFrame, max_rounds: int = 64, each: int | None = None) -> DataFrame:
    """Smallest node that each node reaches, as rows (node, root); roots themselves left out.

    ``links`` has two orderable columns ``a`` and ``b``.  Alternates large-star
    and small-star steps (Kiveris et al., 2014).  Every step is an aggregation
    with map-side combine and a join back whose skewed side AQE may split, so a
    hub with millions of neighbours is not gathered anywhere.  Each round ends
    in a checkpoint, so a lost executor costs at most one round.  With ``each``
    a checkpoint has a file for so many edges, and not one for each partition
    of a shuffle.
    """

    def gathered(df: DataFrame, rows: int) -> DataFrame:
        return saved(df.coalesce(rows // each + 1) if each else df)

    edges = saved(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = gathered(small.union(low.select("a", F.col("m").alias("b"))).distinct(), before[0])
        now = digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
