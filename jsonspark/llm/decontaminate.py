"""Benchmark decontamination [native]: item-sized windows where shingles are shared, exact similarity.

The similarity is the weighted share of an item's five-word shingles that a
window of as many words has; a shingle that fewer items have weighs more.  A
document can hold an item only if the whole document has that share, which a
join on the shingles tells exactly.  Windows of such documents are placed where
a shingle is shared, at the offset the two shingles give, and each is verified
exactly; elsewhere the similarity is zero, so no window is left out.  The 64-bit
SimHash of a window found is reported as differing bits; it drops nothing.  The items' tables are broadcast up to ``max_broadcast`` rows and
shuffled beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .shingles import SIZE, window, with_shingles


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    blocks: int = 5
    each: int = 3
    max_broadcast: int = 500_000  #: rows

    @property
    def radius(self) -> int:
        """Differing bits within which unweighted windows mostly lie; no limit."""
        return self.blocks * (self.each + 1) - 1


def simhash(sh: Column) -> Column:
    """A bit is 1 if over half of the hashes have it."""
    bit = lambda b: F.when(2 * F.size(F.filter(sh, lambda x: F.getbit(x, b) == 1)) > F.size(sh), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, n_words and sh of the items that have a word."""
    named = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return with_shingles(named.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "text"))).where("n_words > 0").select("item", "item_id", "n_words", "sh")


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, start_word, n_words, bits, similarity.

    The row is of the best window, the first on a tie.  Words are runs of letters
    and digits in lower case, numbered from 0 over the whole text.  An item of
    fewer than five words is found only in a document of exactly those words;
    null and empty texts and items, and documents with a null id, are never found.
    Repeated rows are found once; of items that share an id (or have none) each
    text counts, and the best is told.  Other columns are ignored.
    """
    items = items_of(benchmark)
    total = items.count()
    each = items.select("item", "n_words", F.posexplode("sh").alias("q", "h"))
    weights = each.groupBy("h").agg(F.log1p(F.lit(float(total)) / F.count_distinct("item")).alias("weight"))
    terms = each.groupBy("item", "n_words", "h").agg(F.collect_list("q").alias("qs")).join(weights, "h")
    summed = lambda t: F.aggregate(F.array_sort(t), F.lit(0.0), lambda a, x: a + x["weight"])
    whole = terms.groupBy("item").agg(summed(F.collect_list(F.struct("h", "weight"))).alias("whole"))
    shares = terms.join(whole, "item").select("h", "item", F.col("n_words").alias("size"), "qs", "weight", "whole")
    small = lambda df: F.broadcast(df) if df.limit(settings.max_broadcast + 1).count() <= settings.max_broadcast else df

    base = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    hits = (
        with_shingles(base).select("doc_id", "row", F.col("n_words").alias("doc_words"), F.posexplode("sh").alias("p", "h"))
        .join(small(shares), "h")
        .groupBy("doc_id", "row", "doc_words", "item", "size", "whole").agg(F.collect_set(F.struct("h", "weight", "p", "qs")).alias("hits"))
    )
    weight = lambda hits: summed(F.array_distinct(F.transform(hits, lambda x: F.struct(x["h"], x["weight"]))))
    able = hits.where(weight(F.col("hits")) >= (settings.similarity - 1e-9) * F.col("whole"))
    # A window that starts nowhere else can be moved on to its first shared shingle without losing any.
    starts = F.flatten(F.transform("hits", lambda x: F.concat(F.array(x["p"]), F.transform(x["qs"], lambda q: x["p"] - q))))
    clipped = F.transform(starts, lambda s: F.greatest(F.lit(0), F.least(s, F.col("doc_words") - F.col("size"))))
    inside = F.filter("hits", lambda x: (x["p"] >= F.col("s")) & (x["p"] < F.col("s") + F.greatest(F.col("size") - SIZE + 1, F.lit(1))))
    best = F.max(F.struct("similarity", (-F.col("s")).alias("first"), "size", "row", "item"))
    found = saved(
        able.select("*", F.explode(F.array_distinct(clipped)).alias("s"))
        .withColumn("similarity", F.round(weight(inside) / F.col("whole"), 12)).where(F.col("similarity") >= settings.similarity)
        .join(small(items.select("item", "item_id")), "item")
        .groupBy("doc_id", "item_id").agg(best.alias("b"))
        .select("doc_id", "item_id", (-F.col("b.first")).alias("s"), "b.size", "b.similarity", "b.row", "b.item")
    )
    prints = items.select("item", simhash(F.col("sh")).alias("item_fp"))
    windows = with_shingles(base.join(small(found), ["doc_id", "row"])).withColumn("fp", simhash(window(F.col("sh"), F.col("s"), F.col("size"))))
    return (
        windows.join(small(prints), "item").select(
            "doc_id", "item_id", F.col("s").cast("long").alias("start_word"), F.col("size").cast("long").alias("n_words"),
            F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("long").alias("bits"), "similarity",
        ).dropDuplicates(["doc_id", "item_id"])  # of repeated rows one
    )
