import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np

from jsonspark.llm.common import group_count, grown, text_bytes
from jsonspark.llm.language_id import Settings, fit, forward_backward, language_id, predict, train, words_of
from jsonspark.llm.lm_score import Settings as LmSettings
from jsonspark.llm.lm_score import ASKED, _asks, lm_scores
from jsonspark.llm.packs import each_pack, pack

RNG = random.Random(8)
SYLLABLES = {"aa": "ba ko lu mi ta re".split(), "bb": "sch zug wer ich tzk ung".split(), "cc": "éau ção ñor été ção lhe".split()}


def text(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randint(1, 3))) for _ in range(n))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 4])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    posterior, expected = forward_backward(scores, sizes, moves)
    wanted, total, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in sizes:
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T if n else np.zeros((0, 0), int)
        weight = np.array([math.exp(sum(scores[at + t, p[t]] for t in range(n)) + sum(moves[p[t - 1], p[t]] for t in range(1, n))) for p in paths])
        for p, w in zip(paths, weight / weight.sum() if n else []):
            for t in range(n):
                wanted[at + t, p[t]] += w
                if t:
                    total[p[t - 1], p[t]] += w
        at += n
    assert np.allclose(posterior, wanted) and np.allclose(expected, total)


def test_words():
    assert words_of("Ab1c_d É²") == ["ab", "c", "d", "é²"] and words_of("12 ½ ²") == [] and words_of(None) == []


def test_language_id(spark):
    rows = [(i, text(lang := list(SYLLABLES)[i % 3], RNG.randint(1, 60)), lang) for i in range(240)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34!", None), (903, text("cc", 5), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + rows[:5]], "doc_id long, text string, lang string, lang_pred string")
    out = language_id(docs, Settings(docs_each=50)).collect()
    assert len(out) == len(rows) + 5
    truth = {r[0]: r for r in rows}
    held = [r for r in out if r["held_out"] and truth[r["doc_id"]][1] and truth[r["doc_id"]][2] and r["doc_id"] < 900]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert sum(r["lang_pred"] == truth[r["doc_id"]][2] for r in held) / len(held) > 0.97
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902)) and by_id[903]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id(docs.where("lang is null")).collect()} == {"und"}


def test_code_switching(spark):
    model = fit([(text(lang, 40), lang) for lang in list(SYLLABLES) * 30])
    mixed = text("aa", 12) + ". " + text("bb", 15) + " " + text("cc", 9)
    row = predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, segments=True).first()
    assert [s["lang"] for s in row["segments"]] == ["aa", "bb", "cc"] and abs(row["segments"][1]["words"] - 15) <= 2


def test_lm(spark):
    rows = [(i, text("aa", RNG.randint(0, 40)) + RNG.choice(["", " Same SAME same"])) for i in range(120)] + [(500, None), (501, ""), (502, "neverseen É é")]
    rows += rows[:3] + [(None, "null id")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    counts, tokens = Counter(), []
    for i, t in rows:
        own = [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
        tokens.append((i, own))
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for settings in (LmSettings(), LmSettings(group_bytes=300, bucket_entries=50)):
        out = lm_scores(docs, settings).collect()
        got = sorted(((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 8)) for r in out))
        wanted = sorted(
            (i or (-1 if i is None else 0) or (-1 if i is None else i), i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(counts[w] > 0 for w in own), n,
             round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 8)) for i, own in tokens
        )
        assert got == [(-1 if x[0] == 0 else x[0], *x[1:]) for x in wanted] or got == sorted((-1 if x[0] == 0 else x[0], *x[1:]) for x in wanted)
        held = [r for r in out if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in out)
    assert lm_scores(docs.limit(0)).count() == 0
    assert all(r["train_tokens"] == 0 for r in lm_scores(docs, LmSettings(train="false")).collect())


def brute_scores(rows, learnt):
    """(score by id, probability(word or None, context or None)) of a plain model: dictionaries, loops, the same levels of the histogram."""
    docs = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    uni, bi = Counter(), Counter()
    for i, own in docs:
        if learnt(i):
            uni.update(own)
            bi.update(zip([None, *own], own))  # an end stands before the first word
    n, v = sum(uni.values()), len(uni)
    level = lambda p: min(max(121 + round(4 * math.log2(p)), 1), 121) if p else 0
    value = lambda k: 2 ** ((k - 121) / 4) if k else 0.0
    bucket = lambda c: min(int(math.log2(c + 1)), 15)
    cells = Counter()
    for i, own in docs:
        for a, b in zip([None, *own], own) if learnt(i) else ():
            c = uni[a] - 1
            cells[bucket(c), level((bi[a, b] - 1) / c if c else 0), level((uni[b] - 1) / (n - 1))] += 1
    weights = {k: [1 / 3] * 3 for k in range(16)}
    for _ in range(40):
        found = {k: [1e-3] * 3 for k in range(16)}
        for (k, x, y), times in cells.items():
            parts = [w * p for w, p in zip(weights[k], (value(x), value(y), 1 / (v + 1)))]
            for j in range(3):
                found[k][j] += times * parts[j] / sum(parts)
        weights = {k: [x / sum(own) for x in own] for k, own in found.items()}

    def probability(word, before):
        two, one, none = weights[bucket(uni[before])]
        if not uni[before]:
            two, one = 0, one + two
        return (two * bi[before, word] / uni[before] if two else 0) + one * uni[word] / n + none / (v + 1)

    return {i: sum(math.log10(probability(b, a)) for a, b in zip([None, *own], own)) for i, own in docs}, probability, list(uni)


def test_lm_against_brute_force(spark):
    """Scores equal a plain model's, one or many groups; given any context its probabilities add up to one."""
    words = ["a", "b", "c", "d", "rare"]
    rows = [(i, " ".join(RNG.choices(words, [9, 5, 3, 2, 0.1], k=RNG.randint(0, 30)))) for i in range(60)]
    rows += [(1000 + k, f"{c} {w}") for k, (c, w) in enumerate((c, w) for c in ["a", "zz"] for w in [*words, "new"])] + [(2000, None), (2001, "zz")]
    scores, probability, known = brute_scores(rows, lambda i: i < 1000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in (LmSettings(train="doc_id < 1000"), LmSettings(train="doc_id < 1000", group_bytes=200, bucket_entries=4)):
        # Where one group ends the next begins with an end too, so the groups do not show.
        out = {r["doc_id"]: r["score"] for r in lm_scores(docs, settings).collect()}
        assert out.keys() == scores.keys() and all(abs(out[i] - s) < 1e-6 for i, s in scores.items())
    for before in [*known, "zz"]:
        assert abs(sum(probability(w, before) for w in known) + probability("never seen", before) - 1) < 1e-9


def test_lm_sends_in_proportion(spark):
    """Cells that groups send grow as the input does: a bucket that nothing falls into is sent nothing."""
    sent = []
    for k in (1, 4):
        rows = [(i, " ".join(f"w{RNG.randint(0, 400)}" for _ in range(60))) for i in range(60 * k)]
        settings = LmSettings(group_bytes=2000, bucket_entries=200)
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        bits = (group_count(text_bytes(docs) // 8, settings.bucket_entries) - 1).bit_length()
        packs = pack(docs.selectExpr("true as train", "doc_id", "text"), settings.group_bytes)
        cells = packs.mapInArrow(each_pack(_asks(bits)), ASKED).selectExpr("count(*)", "sum(length(small))").first()
        assert cells[0] <= packs.count() * 2 << bits
        sent.append(packs.count())
    assert 3 <= sent[1] / sent[0] <= 5
    assert grown(10**9, 4, 64) == 4 and grown(2 * 10**11, 4, 64) == 8 and grown(10**15, 4, 64) == 64


def test_many_languages(spark):
    """Every label is learnt and has a lexicon feature of its own, however many there are."""
    for k in (20, 70):
        names = [f"l{i:02d}" for i in range(k)]
        own = {lang: ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for lang in names}
        rows = [(i, " ".join(RNG.choice(own[names[i % k]]) for _ in range(30)), names[i % k]) for i in range(12 * k)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = train(docs, Settings(docs_each=6, train="true"))
        assert model.languages == names
        word = {lang: next(w for w in own[lang] if model.lexicon.get(w) == (i,)) for i, lang in enumerate(names)}
        cells = [set(model.features([word[lang]])[0][-1:].tolist()) for lang in names]
        assert cells == [{model.table + i} for i in range(k)] and all(model.weights[model.table + i, i] > 0 for i in range(k))
        out = predict(docs, model).collect()
        assert sum(r["lang_pred"] == names[r["doc_id"] % k] for r in out) / len(out) > 0.97


def test_copies_and_clashing_names(spark):
    """A text that occurs a thousand times is learnt from once; extra columns may have the names of results."""
    rows = [(i, text(lang := list(SYLLABLES)[i % 3], 20), lang) for i in range(60)] + [(100 + i, "ba ko lu mi", "aa") for i in range(1000)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, lang string, score int, __text int")
    seen = []
    module = sys.modules["jsonspark.llm.language_id"]
    whole, module.fit = module.fit, lambda samples, settings: seen.extend(samples) or whole(samples, settings)
    try:
        model = train(docs, Settings(docs_each=30, chars_each=2000, train="true"))
    finally:
        module.fit = whole
    assert len(set(seen)) == len(seen) <= 61 and sum(t == "ba ko lu mi" for t, _ in seen) <= 1
    assert all(sum(len(t) for t, lang in seen if lang == k) <= 2000 for k in SYLLABLES)
    out = predict(docs, model, carry=("text", "score", "__text"), prefix="own_").collect()
    assert len(out) == len(rows) and all(r["score"] == 7 and r["__text"] == 8 and r["own_lang_pred"] for r in out)
    assert train(docs, Settings(chars_each=1, train="true")).languages == []
