"""SimHash near-duplicate detection by pigeonhole blocks.

A 64-bit fingerprint is cut into d + 3 blocks.  Two fingerprints that differ in
at most d bits agree on three blocks at least, so they meet under one of the
C(d + 3, 3) keys made of three blocks each.  Only fingerprints that meet are
compared, and only the links that hold a group together are emitted, never all
of its pairs.  Equal fingerprints are merged before, so a group of copies is one
fingerprint here.  A key with more than ``max_bucket`` different fingerprints is
never gathered: its members are dealt again by three blocks of the bits that are
still free (the same pigeonhole argument), until the groups are small; after
three levels only eight bits are free, so no group has over 256 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, saved

SEED = 42
ALL = (1 << 64) - 1


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and .split know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def folded(hashes: np.ndarray) -> int:
    """SimHash of hashes: a bit is 1 if over half of them have it; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included; zero without words."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=None)
def masks(free: int, distance: int) -> tuple[int, ...]:
    """The keys' masks: three of distance + 3 blocks of the free bits each."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(bits, distance + 3)]
    return tuple(sum(c) for c in combinations(blocks, 3))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed longs; numpy counts those of a negative number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _linked(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of the components of a small group; each member is compared until it is reached."""
    left, members, roots = values, [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        stack = [root]
        while stack and len(left):
            near = _apart(left, stack.pop()) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                stack.extend(reached)
                members.append(reached)
                roots.append(np.full(len(reached), root))
    none = np.empty(0, np.int64)
    return (np.concatenate(members), np.concatenate(roots)) if members else (none, none)


def _bucket_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cols = cols if rest is None else np.concatenate([rest, cols], axis=1)
            change = np.flatnonzero((cols[0, 1:] != cols[0, :-1]) | (cols[1, 1:] != cols[1, :-1])) + 1
            cut = change[-1] if len(change) else 0  # the last group may go on in the next batch
            rest = cols[:, cut:]
            if cut:
                yield from links(cols[:, :cut], change[:-1])
        if rest is not None and rest.shape[1]:
            yield from links(rest, np.empty(0, np.int64))

    def links(cols: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate([[0], change, [cols.shape[1]]])
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        a, b = cols[2, two], cols[2, two + 1]
        near = _apart(a, b) <= distance
        found = [(b[near], a[near])]
        for k in np.flatnonzero(size > 2):
            found.append(_linked(cols[2, edges[k] : edges[k + 1]], distance))
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _dealt_again(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = [], [], []
            for m in np.unique(mask):
                own = fp[mask == m]
                for sub in masks(ALL & ~(int(m) & ALL), distance):
                    whole = np.int64(_signed((int(m) & ALL) | sub))
                    for o, x in zip(out, (np.full(len(own), whole), own & whole, own)):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["mask", "key", "fp"])

    return run


def fingerprint_links(fps: DataFrame, distance: int = 3, max_bucket: int = 8192) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``distance`` bits, directly or through others."""
    made = [_signed(m) for m in masks(ALL, distance)]
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in made])).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp"
    )
    links = None
    for level in range(3):
        hot = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > max_bucket).select("mask", "key")
        crowded = level < 2 and not (hot := saved(hot)).isEmpty()
        cold = dealt.join(hot, ["mask", "key"], "left_anti") if crowded else dealt
        found = cold.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_bucket_links(distance), "a long, b long")
        links = found if links is None else links.union(found)
        if not crowded:
            break
        dealt = dealt.join(hot, ["mask", "key"], "left_semi").select("mask", "fp").mapInArrow(_dealt_again(distance), "mask long, key long, fp long").distinct()
    return links


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, max_bucket: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fp (hex) and component_id, the smallest id that it reaches.

    Two documents link if their fingerprints differ in at most ``distance``
    bits.  A null or blank text has fingerprint zero and links like any other; a
    null id never is a component_id unless all of the group's are null.
    Repeated rows give repeated rows.  Other columns are ignored.
    """
    prints = saved(fingerprints(docs, shingle, id_col, text_col))
    groups = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    nodes = connected_components(fingerprint_links(groups.select("fp"), distance, max_bucket))
    named = groups.join(nodes, groups.fp == nodes.node, "left").select("fp", "low", "n", F.col("root"))
    linked = named.where("root is not null").select("fp", "root")
    linked = linked.union(linked.select(F.col("root").alias("fp"), "root").distinct())
    lows = linked.join(groups.select("fp", "low"), "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    chosen = linked.join(lows, "root").select("fp", "component_id")
    alone = groups.where("n > 1").join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"))
    return (
        prints.join(chosen.union(alone), "fp", "left")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )
