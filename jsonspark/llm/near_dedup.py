"""Near-duplicates by SimHash blocks and the exact Jaccard similarity of word shingles.

Texts with equal sets of shingles are merged before.  The SimHash of a set links it
to those within ``distance`` bits, found by pigeonhole blocks (see ``simhash``); every
link is verified on the whole sets, and what holds makes components.

A pair of similarity 0.8 differs in some ten of 64 bits, out of the blocks' reach.  So
that none is lost, texts also meet by MinHash: ``BANDS`` keys of ``ROWS`` minima each,
so a pair of similarity s shares a key with probability 1 - (1 - s**ROWS)**BANDS (all
but 5 in 100 million at 0.8).  In a key the hub is the member that meets most others in
all keys: of a family of near copies that is the text they come from.  Members are
compared with it, in the same pass as the pairs of close fingerprints and each pair
once; where some are not in the key's largest component then, they alone are compared
with the others, in blocks of a bounded number of hashes (all of a block's similarities
are one pass over its shingles).  So no pair that could join two groups is left out,
no pairs are rows, and a large group of near copies costs as many comparisons as it
has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, saved, shuffles_dropped
from .simhash import fingerprint_links, folded, shingle_hashes

BANDS, ROWS = 32, 4
FILE_LINKS = 20_000  # links of a file, so that a few thousand do not make a file for each partition of a shuffle
_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, different bands apart; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[k : k + 2048, None] * FACTORS + TERMS).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in low.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, fp, bands): node names the shingle set, fp is its SimHash."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("node", T.LongType()),
        T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in batch.column(1)]
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            prints = np.fromiter((folded(s) for s in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(prints), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))], schema.names)

    return docs.mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                made = [shingle_set(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def close_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all of rows (node, fp) whose fingerprints differ in at most ``distance`` bits."""
    first = prints.groupBy("fp").agg(F.min("node").alias("first"))
    one, two = (first.select(F.col("fp").alias(f"{n}_fp"), F.col("first").alias(n)) for n in "ab")
    links = fingerprint_links(first.select("fp"), distance).select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp"))
    same = prints.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return links.distinct().join(one, "a_fp").join(two, "b_fp").select("a", "b").union(same)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that Jaccard similarity."""
    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(f"{n}_set"), F.size("hashes").alias(f"{n}_size")) for n in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    alike = both >= similarity * (F.col("a_size") + F.col("b_size") - both) - 1e-9
    near = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size") - 1e-9
    return pairs.join(one, "a").join(two, "b").where(F.when(near, alike).otherwise(False)).select("a", "b")


def block_links(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs (a, b) of roots that links between the asking rows and the others join; of links that join the same roots one is enough."""
    ask = np.array(table.column("ask").to_pylist(), bool)
    root = table.column("root").to_numpy()
    hashes = table.column("hashes").combine_chunks()
    ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy()
    size = np.diff(ends)
    asking, others = np.flatnonzero(ask), np.flatnonzero(~ask)
    words = np.concatenate([flat[ends[i] : ends[i + 1]] for i in asking]) if len(asking) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(asking)), size[asking])
    order = np.argsort(words, kind="stable")
    words, owner = words[order], owner[order]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for j in others.tolist():
        own = flat[ends[j] : ends[j + 1]]
        low, high = np.searchsorted(words, own, "left"), np.searchsorted(words, own, "right")
        times = high - low
        at = np.arange(times.sum()) + np.repeat(low - (np.cumsum(times) - times), times)
        both = np.bincount(owner[at], minlength=len(asking))
        for i in asking[both >= similarity * (size[asking] + size[j] - both) - 1e-9].tolist():
            a, b = top(int(root[i])), top(int(root[j]))
            if a != b:
                above[a] = b
                out.append((int(root[i]), int(root[j])))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 3, block_hashes: int = 1_000_000) -> DataFrame:
    """One row a document: doc_id and component_id, the smallest id of its group.

    Two documents link if the Jaccard similarity of their sets of word shingles
    is at least ``similarity``; a group is what links connect.  ``distance`` is
    that of fingerprints: which step finds a link, not what a link is.  Texts without a
    word are equal.  Rows with a null id are left out; ids are unique.
    """
    docs = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    with shuffles_dropped(docs.sparkSession):
        prints = saved(sketches(docs, shingle))
        groups = saved(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
        nodes, tops = _components(docs, groups, shingle, similarity, distance, block_hashes)

    roots = nodes.select("root").union(tops.select("node")).union(tops.select("top")).distinct()
    linked = nodes.union(roots.select(F.col("root").alias("node"), "root"))
    linked = linked.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lows = linked.join(groups.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    chosen = linked.join(lows, "root").select("node", "component_id")
    alone = groups.where("n > 1").join(linked.select("node"), "node", "left_anti").select("node", F.col("low").alias("component_id"))
    return prints.select("doc_id", "node").join(chosen.union(alone), "node", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def _components(docs: DataFrame, groups: DataFrame, shingle: int, similarity: float, distance: int, block_hashes: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of what fingerprints and hubs link, then (node, top) of the roots that blocks join; each leaves its own roots out."""
    close = saved(close_pairs(groups.select("node", "fp"), distance))
    dealt = groups.select("node", F.explode("bands").alias("key"))
    met = saved(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key").select("key", "node", "n"))
    central = met.groupBy("node").agg(F.sum("n").alias("c"))
    asked = central.select("node").union(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    named = asked.join(groups, "node").select("node", "low")
    sets = saved(_sets(docs.join(named, docs.doc_id == named.low).select("node", "text"), shingle))
    # Members with their key's hub, beside the pairs that the fingerprints give; a pair of both is verified once.
    hubs = met.join(central, "node").groupBy("key").agg(F.max(F.struct("c", "node"))["node"].alias("a"))
    tried = close.union(met.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b")))
    links = _verified(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, similarity)
    nodes = connected_components(links, each=FILE_LINKS)

    # Keys whose members are not one component yet; of keys with the same members one is enough.
    rooted = met.join(nodes, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    rest = saved(rooted.join(main, "key").join(sets.select("node", F.size("hashes").alias("size")), "node").withColumn("far", F.col("root") != F.col("main")))
    members = rest.groupBy("key").agg(
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"), F.count("*").alias("n"),
        F.sum(F.when(F.col("far"), F.col("size")).otherwise(0)).alias("asking"), F.sum("size").alias("all"),
    )
    blocks = lambda c: F.ceil(F.col(c) / block_hashes).cast("int")
    chosen = members.groupBy("x", "y", "n").agg(F.min_by(F.struct("key", "asking", "all"), "key").alias("k")).select("k.*").select(
        "key", F.greatest(blocks("asking"), F.lit(1)).alias("q_blocks"), F.greatest(blocks("all"), F.lit(1)).alias("m_blocks")
    )
    here = rest.join(chosen, "key").join(sets, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = here.where("far").select("key", deal("q_blocks").alias("q"), every("m_blocks").alias("m"), F.lit(True).alias("ask"), "node", "root", "hashes")
    others = here.select("key", every("q_blocks").alias("q"), deal("m_blocks").alias("m"), F.lit(False).alias("ask"), "node", "root", "hashes")
    found = asking.union(others).groupBy("key", "q", "m").applyInArrow(lambda t: block_links(t, similarity), "a long, b long")
    return nodes, connected_components(found, each=FILE_LINKS).withColumnRenamed("root", "top")
