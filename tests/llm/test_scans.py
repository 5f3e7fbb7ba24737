import math
import random
import re

import pytest

from jsonspark.llm.decontaminate import Settings as Blocks
from jsonspark.llm.decontaminate import contamination
from jsonspark.llm.license_scan import TEMPLATES, Settings, license_scan

RNG = random.Random(6)
WORD = re.compile(r"[^\W_]+")


def prose(n):
    return " ".join(RNG.choice("la re mi fa so ti do ka".split()) + RNG.choice("xyzuvw") + str(RNG.randint(0, 99)) for _ in range(n))


def shingles(words):
    return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]


def test_licenses(spark):
    texts = [None, "", "MIT License", prose(50)]
    for name, template in TEMPLATES.items():
        texts += [template, prose(RNG.randint(1, 90)) + " " + template.upper() + "\n" + prose(20), prose(7) + " " + template + " " + template]
        words = template.split()
        if len(words) > 30:
            words[len(words) // 2] = "changed"
            texts.append(prose(12) + " " + " ".join(words) + " " + prose(3))
        texts.append(prose(5) + " " + " ".join(template.split()[: max(4, len(words) // 2)]) + " " + prose(5))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, license string")
    out = license_scan(docs).collect()
    got = {(r["doc_id"], r["license"]) for r in out}
    wanted = set()
    for i, t in enumerate(texts):
        own = shingles(WORD.findall((t or "").lower()))
        for name, template in TEMPLATES.items():
            words = WORD.findall(template.lower())
            held = set(shingles(words))
            size = Settings().span(len(words)) - 4
            if any(len(set(own[a : a + size]) & held) >= 0.8 * len(held) for a in range(len(own))):
                wanted.add((i, name))
    assert got == wanted and len(out) == len(got)
    assert license_scan(docs.limit(0)).count() == 0


def test_band_guarantee():
    with pytest.raises(ValueError):
        Settings(bands=2).check([30])
    Settings().check([5, 8, 13, 30, 60, 200])


def test_contamination(spark):
    items = [prose(n) for n in (18, 25, 40, 46, 60)] + ["only three words", None, ""]
    texts = [None, "", prose(100), "only three words", "Only THREE, words!", "with only three words more"]
    for k, item in enumerate(items[:5]):
        words = item.split()
        edited = words.copy()
        edited[1] = "changed"
        texts += [item, prose(30) + "\n" + item.upper().replace(" ", ", ") + " " + prose(20), prose(9) + " " + " ".join(edited) + " " + prose(9), prose(4) + " " + " ".join(words[: len(words) // 2]) + " " + prose(9)]
    texts.append(items[0] + " " + prose(5) + " " + items[2])
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2 + [(None, items[0], 1)], "doc_id long, text string, item_id int")
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0]), (None, prose(20))], "item_id long, text string")
    out = contamination(docs, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out}
    wanted = {(3, 5), (4, 5)}
    for i, t in enumerate(texts):
        own = shingles(WORD.findall((t or "").lower()))
        for j, item in enumerate(items[:5]):
            words = WORD.findall(item.lower())
            held = set(shingles(words))
            size = len(words) - 4
            if any(len(set(own[a : a + size]) & held) >= 0.8 * len(held) - 1e-9 for a in range(max(1, len(own)))):
                wanted.add((i, j))
    assert got == wanted and len(out) == len(got)
    assert all(r["bits"] <= Blocks().radius and r["similarity"] >= 0.8 for r in out)
    assert contamination(docs, benchmark, Blocks(max_broadcast=0)).count() == len(out)
    assert contamination(docs.limit(0), benchmark).count() == 0 and contamination(docs, benchmark.limit(0)).count() == 0


def weighted(items, texts):
    """(doc, item) -> similarity of the best of all windows, without SimHash."""
    held = [set(shingles(t.split())) for t in items]
    weight = {x: math.log1p(len(items) / sum(x in other for other in held)) for own in held for x in own}
    found = {}
    for i, t in enumerate(texts):
        own = shingles(t.split())
        for j, item in enumerate(items):
            size = len(item.split()) - 4
            whole = sum(map(weight.get, held[j]))
            best = max(sum(map(weight.get, set(own[a : a + size]) & held[j])) / whole for a in range(max(1, len(own))))
            if best >= 0.8 - 1e-9:
                found[i, j] = best
    return found


def test_contamination_without_a_radius(spark):
    """Items with a common prompt in documents without it, and edited, torn and borderline passages."""
    prompt = prose(16)
    items = [prompt + " " + prose(RNG.randint(18, 28)) for _ in range(120)] + [prose(RNG.randint(20, 60)) for _ in range(30)]
    texts = []
    for item in items:
        words = item.removeprefix(prompt).split()
        texts.append(prose(30) + " " + " ".join(words) + " " + prose(30))
        cut = RNG.randint(8, len(words) - 8)
        texts.append(prose(9) + " " + " ".join(words[:cut]) + " " + prose(RNG.randint(1, 3)) + " " + " ".join(words[cut:]) + " " + prose(9))
        texts.append(prose(9) + " " + " ".join(words[RNG.randint(0, 10):]) + " " + prose(40))
    wanted = weighted(items, texts)
    out = contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out}
    assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert any(r["bits"] > Blocks().radius for r in out)


def test_items_that_share_an_id(spark):
    items = [(1, prose(30)), (1, prose(25)), (1, prose(40)), (None, prose(20)), (2, prose(35))]
    docs = spark.createDataFrame([(i, prose(9) + " " + t + " " + prose(9)) for i, (_, t) in enumerate(items)], "doc_id long, text string")
    out = contamination(docs, spark.createDataFrame(items * 2, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in out} == {(0, 1, 30), (1, 1, 25), (2, 1, 40), (3, None, 20), (4, 2, 35)} and len(out) == 5
