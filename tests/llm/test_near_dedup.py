import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from jsonspark.llm import near_dedup
from jsonspark.llm.common import shuffles_dropped
from jsonspark.llm.near_dedup import block_links, close_pairs, near_duplicates, shingle_set
from jsonspark.llm.simhash import folded

RNG = random.Random(11)
DATA = "/root/testdata/sf0.1"


def brute_pairs(sets, similarity=0.8):
    """All pairs of that Jaccard similarity: they share one of the rarest 1 - similarity of their shingles."""
    often = Counter(h for s in sets for h in s)
    holders, found = defaultdict(list), set()
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sorted(sets[i], key=lambda h: (often[h], h))[: int(len(sets[i]) * (1 - similarity) + 1e-9) + 1]
        for j in {j for h in own for j in holders[h] if len(sets[j]) >= similarity * len(sets[i]) - 1e-9}:
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                found.add((min(i, j), max(i, j)))
        for h in own:
            holders[h].append(i)
    return found


def lowest(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_groups(spark):
    word = lambda: RNG.choice("abcdefgh") + str(RNG.randint(0, 300))
    texts = ["", None, "one", "One  ", "one two three four"]
    for _ in range(12):
        base = [word() for _ in range(RNG.randint(5, 150))]
        for _ in range(8):
            copy = base.copy()
            for _ in range(RNG.randint(0, 4)):
                copy[RNG.randint(0, len(copy) - 1)] = word()
            texts.append(" ".join(copy))
    RNG.shuffle(texts)
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    assert {p for p in pairs if sets[p[0]]} == {p for p in brute_pairs(sets) if sets[p[0]]}
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[3], 0)], "doc_id long, text string, node int")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == lowest(range(len(texts)), pairs)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, block_hashes=60).collect()} == got  # keys in many blocks
    assert near_duplicates(docs.limit(0)).count() == 0


def test_chains_and_families(spark):
    """Copies far from the text they come from and near each other, and chains whose ends are far apart."""
    word = lambda: RNG.choice("abcdefgh") + str(RNG.randint(0, 9999))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(120)]
        texts += [" ".join(base)]
        for _ in range(15):  # most share so many shingles that they meet, and are under the similarity
            copy = base.copy()
            for at in RNG.sample(range(120), RNG.randint(1, 6)):
                copy[at] = word()
            texts.append(" ".join(copy))
        chain = base.copy()
        for k in range(12):
            chain[5 + 9 * k] = word()
            texts.append(" ".join(chain))
    RNG.shuffle(texts)
    sets = [set(shingle_set(t, 5).tolist()) for t in texts]
    wanted = lowest(range(len(texts)), brute_pairs(sets))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (1_000_000, 300):
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, block_hashes=size).collect()} == wanted


def test_pairs_of_close_fingerprints(spark):
    """Nodes of one fingerprint and of fingerprints within the distance are connected, and no others."""
    prints = [RNG.getrandbits(64) for _ in range(20)]
    for x in prints[:10]:
        prints += [x, x ^ 1 << RNG.randint(0, 63), x ^ 7 << RNG.randint(0, 60), x ^ 15 << RNG.randint(0, 60)]
    rows = [(k + 100, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    near = [(i, j) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    got = close_pairs(spark.createDataFrame(rows, "node long, fp long"), 3).collect()
    assert lowest(range(len(prints)), [(r["a"] - 100, r["b"] - 100) for r in got]) == lowest(range(len(prints)), near)


def test_fingerprints_link_without_other_keys(spark, monkeypatch):
    """Near copies within three bits are found by SimHash alone, and their links are verified."""
    word = lambda: RNG.choice("abcdefgh") + str(RNG.randint(0, 9999))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(3000)]
        copy = base.copy()
        copy[RNG.randint(0, 2999)] = word()
        texts += [" ".join(base), " ".join(copy)]
    sets = [shingle_set(t, 5) for t in texts]
    close = [(i, i + 1) for i in range(0, len(texts), 2) if (folded(sets[i]) ^ folded(sets[i + 1])).bit_count() <= 3]
    assert len(close) > 6
    made = near_dedup.sketches
    monkeypatch.setattr(near_dedup, "sketches", lambda docs, shingle: made(docs, shingle).withColumn("bands", F.array().cast("array<long>")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = lambda similarity: {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, similarity=similarity).collect()}
    assert groups(0.8) == lowest(range(len(texts)), close)
    assert groups(0.9999) == {i: i for i in range(len(texts))}


def test_steps_leave_no_shuffle_files(spark):
    """Shuffle files of the steps go without the driver's garbage collection, the setting is as before and the result can run twice."""
    word = lambda: RNG.choice("abcdefgh") + str(RNG.randint(0, 9999))
    base = [word() for _ in range(200)]
    texts = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 200, 10)] + [" ".join(word() for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {x for top in folders for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    groups = near_duplicates(docs)
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == setting
    first, second = ({r["doc_id"]: r["component_id"] for r in groups.collect()} for _ in range(2))
    assert first == second == {i: 0 if i < 20 else i for i in range(40)}
    with pytest.raises(ValueError), shuffles_dropped(spark):
        raise ValueError
    assert spark.conf.get(key) == setting


def test_block_links_join_roots():
    """A block gives pairs of roots, so what it finds needs no second look at the links before."""
    hashes = [list(range(10)), list(range(10)), list(range(1, 11)), list(range(50, 60))]
    block = {"ask": [True, False, False, False], "node": [1, 2, 3, 4], "root": [10, 20, 20, 40], "hashes": pa.array(hashes, pa.list_(pa.int64()))}
    assert block_links(pa.table(block), 0.8).to_pylist() == [{"a": 10, "b": 20}]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_recall_on_the_table(spark):
    """The stage keeps exactly the smallest document of each group that brute force finds."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.where("doc_id is not null and text is not null").collect())
    same = defaultdict(list)
    for i, t in rows:
        same[shingle_set(t, 5).tobytes()].append(i)
    kinds = list(same)
    sets = [set(np.frombuffer(k, np.uint64).tolist()) for k in kinds]
    pairs = {(same[kinds[a]][0], same[kinds[b]][0]) for a, b in brute_pairs(sets)}
    assert len(pairs) > 40
    alike = [(ids[0], i) for ids in same.values() for i in ids[1:]]
    wanted = lowest([i for i, _ in rows], [*pairs, *alike])
    kept = {r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs.where("text is not null"), DATA).collect()} - {None}
    assert kept == {i for i, low in wanted.items() if i == low}
