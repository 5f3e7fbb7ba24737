import random
import re

import numpy as np
import pytest
import xxhash

from jsonspark.llm.common import connected_components
from jsonspark.llm.simhash import ALL, fingerprint, fingerprint_links, masks, simhash_groups

RNG = random.Random(4)


def slow_fingerprint(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


TEXTS = [None, "", " \n", "One", "one two", "ONE two three", "É one two three", "a b c d " * 2000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_pigeonhole(distance):
    """Any two fingerprints within the distance agree under some mask."""
    for _ in range(300):
        x = RNG.getrandbits(64)
        y = x
        for b in RNG.sample(range(64), distance):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks(ALL, distance))


@pytest.mark.parametrize("max_bucket", [8192, 4])
def test_groups_of_fingerprints(spark, max_bucket):
    centres = [RNG.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres[:4]:
        for _ in range(40):
            y = c
            for b in RNG.sample(range(64), RNG.randint(1, 6)):
                y ^= 1 << b
            values.add(y)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, max_bucket)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    wanted = slow_groups(values, 3)
    got = [roots.get(v, v) for v in signed]
    assert len(set(zip(wanted, got))) == len(set(wanted)) == len(set(got))


def test_documents(spark):
    base = [" ".join(RNG.choice("alpha beta gamma delta eps zeta eta".split()) + str(RNG.randint(0, 50)) for _ in range(120)) for _ in range(10)]
    texts = TEXTS + base + base[:5] + [b.replace(" ", "  ", 3).upper() for b in base[5:]] + [b + " tail" for b in base]
    docs = spark.createDataFrame([(i + 5, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    out = {r["doc_id"]: r for r in simhash_groups(docs).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    groups = slow_groups(prints, 3)
    for i in range(len(texts)):
        assert out[i + 5]["fingerprint"] == f"{prints[i]:016x}"
        assert out[i + 5]["component_id"] == min(j for j, g in enumerate(groups) if g == groups[i]) + 5


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    out = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_groups(docs).collect())
    assert out == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash_groups(docs.limit(0)).count() == 0


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 201)) and all(out[1000 + i] == 1000 for i in range(1, 300)) and 5000 not in out
    assert np.array_equal(sorted(out), sorted([*range(1, 201), *range(1001, 1300)]))
