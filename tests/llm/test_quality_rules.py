import math
import re
from collections import Counter

from pyspark.sql import functions as F

from jsonspark.llm.quality_rules import Settings, binomial_tail, certified_cutoffs, features, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "x\nx\ny\n\nx", "la la la la la", "#### $$ %% <a|b>", "é" * 5 + "   z z", "w " * 70, "a b c d " * 30,
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(20000)) + " w0 w1 w2", "\x0b\x0cx y",
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    got = {r["doc_id"]: r for r in features(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_binomial_tail(spark):
    cases = [(k, n) for n in (0, 1, 7, 50, 400) for k in (0, 1, 3, 20) if k <= n]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.03).alias("p")).collect()
    for r in rows:
        wanted = sum(math.comb(r["n"], j) * 0.03**j * 0.97 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert math.isclose(r["p"], wanted, rel_tol=1e-9), r


def brute_cutoffs(rows, settings):
    """rows: (stratum, quality, value by rule)."""
    strata = {s for s, q, _ in rows if q == 1}
    tests = len(strata) * len(settings.rules) * max(map(len, settings.rules.values()))
    each, found = settings.alpha / len(settings.rules), {}
    for s in strata:
        good = [v for x, q, v in rows if q == 1 and s == x]
        for rule, cutoffs in settings.rules.items():
            for c in cutoffs:
                lost = sum(v[rule] > c for v in good)
                p = sum(math.comb(len(good), j) * each**j * (1 - each) ** (len(good) - j) for j in range(lost + 1))
                if p <= settings.delta / tests:
                    found[s, rule] = c
                    break
    return found


def test_cutoffs_and_verdicts(spark):
    settings = Settings(alpha=0.4, rules={"symbol_share": (0.02, 0.1, 0.5), "upper_share": (0.1, 0.6)})
    base = " ".join(f"w{i}" for i in range(60))
    data, rows = [], []
    for i in range(400):
        lang = "en" if i % 3 else "fr"
        quality = 1 if i % 5 else 0
        marks = 100 if not quality else 8 if i % 40 == 1 else 0
        text = base + " " + "#" * marks if marks else base
        data.append((i, text, lang, quality))
        chars = len(text.replace(" ", ""))
        rows.append((lang, quality, {"symbol_share": marks / chars, "upper_share": 0.0}))
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in data], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in data] + [(None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in certified_cutoffs(features(docs), labels, settings).collect() if r["cutoff"] is not None}
    assert got == brute_cutoffs(rows, settings)
    out = {r["doc_id"]: r for r in quality_rules(docs, labels, settings).collect()}
    for i, _, lang, quality in data:
        value = rows[i][2]["symbol_share"]
        assert out[i]["kept"] == (value <= got.get((lang, "symbol_share"), math.inf))


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, None, "c") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules(docs, labels).collect()
    assert len(out) == 2 * len(TEXTS)
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality_rules(docs.limit(0), labels).count() == 0


def test_every_stratum_has_its_own_tests(spark):
    """1500 strata and a null one: each is tested by itself, and what is not certified has no cutoff."""
    settings = Settings(alpha=0.9, delta=0.9, rules={"upper_share": (0.2,)})
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base, f"s{i % 1500}") for i in range(1500)]
    many = [(10_000 + i, base.upper() if i == 0 else base, None) for i in range(40)] + [(20_000, base.upper(), "alone"), (20_001, base.upper(), "")]
    docs = spark.createDataFrame(rows + many, "doc_id long, text string, lang string")
    labels = docs.where("doc_id < 20000").selectExpr("doc_id", "1 as quality")
    cutoffs = certified_cutoffs(features(docs), labels, settings).collect()
    assert len(cutoffs) == 1501 and [r["stratum"] for r in cutoffs if r["cutoff"] is not None] == [None]  # one document proves nothing
    for limit in (100_000, 1):  # broadcast or shuffled
        out = {r["doc_id"]: r["failed_rules"] for r in quality_rules(docs, labels, Settings(**{**settings.__dict__, "max_broadcast": limit})).collect()}
        assert len(out) == docs.count() and {i for i, x in out.items() if x} == {10_000}
