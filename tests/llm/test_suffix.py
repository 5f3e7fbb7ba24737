import hashlib
import random

import numpy as np
import pytest

from jsonspark.llm import suffix_array as module
from jsonspark.llm.suffix_array import suffix_array, suffix_arrays
from jsonspark.llm.suffix_dedup import LENGTH, Settings, suffix_dedup

RNG = random.Random(2)
CASES = [b"", b"a", b"a" * 300, b"ab" * 200, b"abaababa" * 40, b"the cat the cat sat the cat " * 20, bytes(range(256)) * 2, b"ba" * 50 + b"c", b"\x00\x00a\x00"]


@pytest.mark.parametrize("text", CASES)
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_random_suffix_arrays():
    for _ in range(1500):
        text = bytes(RNG.randint(97, 96 + RNG.choice([1, 2, 3, 26])) for _ in range(RNG.randint(0, 40)))
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("one_by_one", [0, 3])
def test_suffix_arrays_in_step(one_by_one, monkeypatch):
    """Many texts in step, with few and many symbols, repeated blocks and empty texts, against sorting."""
    monkeypatch.setattr(module, "STEP_TEXTS", one_by_one)
    for symbols in (10, 400_000):
        monkeypatch.setattr(module, "STEP_SYMBOLS", symbols)
        for _ in range(150):
            texts = []
            for _ in range(RNG.randint(1, 12)):
                most = RNG.choice([0, 1, 2, 25])
                texts.append([RNG.randint(0, most) for _ in range(RNG.randint(0, 50))])
                if RNG.random() < 0.2:
                    texts.append(([0] + [1] * RNG.randint(0, 5)) * RNG.randint(0, 9))
            flat = np.array([x for t in texts for x in t], np.int64)
            want, at = [], 0
            for t in texts:
                want += [at + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
                at += len(t)
            assert suffix_arrays(flat, np.cumsum([len(t) for t in texts])).tolist() == want


def brute(rows):
    """(n_bytes, n_removed, spans, kept) of each (id, text) row."""
    seen, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - LENGTH + 1) if i is not None else ():
            s = b[k : k + LENGTH]
            seen[s] = min(seen.get(s, i), i)
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1) if i is not None else ():
            if seen[b[k : k + LENGTH]] < i:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def words(n):
    return " ".join("".join(RNG.choice("abcdé") for _ in range(RNG.randint(1, 6))) for _ in range(n))


def corpus():
    passages = [words(30) for _ in range(4)]
    texts = [None, "", "short", "x" * 49, "x" * 50, "x" * 300, "y" * 51]
    for _ in range(60):
        parts = [words(RNG.randint(1, 25))]
        for _ in range(RNG.randint(0, 3)):
            p = RNG.choice(passages)
            a = RNG.randint(0, len(p) // 2)
            parts += [p[a : a + RNG.randint(20, len(p))], words(RNG.randint(0, 10))]
        texts.append(" ".join(parts))
    near = list(words(200))
    for _ in range(15):
        copy = near.copy()
        copy[RNG.randint(0, len(copy) - 1)] = "#"
        texts.append("".join(copy))
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    return rows + rows[10:14] + [(rows[20][0], rows[21][1]), (None, rows[22][1]), (None, rows[22][1])]


@pytest.mark.parametrize("settings", [Settings(), Settings(group_bytes=2000, bucket_anchors=100, max_contexts=4), Settings(group_bytes=3000, max_contexts=1)])
def test_removal(spark, settings):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    out = suffix_dedup(docs, settings).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out), key=repr)
    assert got == brute(rows)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out)


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = suffix_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [(r["n_bytes"], r["n_removed"], r["kept"]) for r in only] == [(0, 0, b"")]


def test_tiny_chunks(spark):
    """A chunk of 1 to 30 bytes in all has no anchors; neither has a tiny text after one that fills a chunk."""
    from jsonspark.llm.suffix_dedup import anchors

    for n in range(1, 31):
        at, hashes = anchors(np.full(n, 97, np.uint8), np.array([n]))
        assert len(at) == len(hashes) == 0
    for rows in ([(1, "short")], [(1, "x" * 1_000_001), (2, "abc")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup(docs).collect()}
        assert out == {i: (len(t), 0, t.encode()) for i, t in rows}
