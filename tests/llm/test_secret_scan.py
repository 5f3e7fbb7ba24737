import random
import re
import string

from jsonspark.llm.secret_scan import labelled_samples, ratio, redacted, secret_scan, span_text, train
from pyspark.sql import functions as F

PATTERNS = [
    (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]
RNG = random.Random(3)
RANDOM = ["".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(30)]
WORDS = ["internationalisation", "ordinaryidentifiername", "get_user_profile_by_id", "straightforwardly", "some-long-hyphenated-word"]
TEXTS = [
    None, "", "no secrets here", "token = \"abcdef123456\" end", "PASSWORD:short password: longenough", "password=token:abcdefgh secret=x", "éé😀 api_key='k" + "9" * 10 + "' AKIA" + "Z" * 16,
    "AKIA" + "A" * 15 + " x AKIAAKIA" + "B" * 14, "f" * 23 + " " + "0af" * 8, "token=" + "ab" * 20 + " tail", "ſecret=abcdefgh", 'apikey"  :  "aaaaaa"token=bbbbbb', "secret=" * 5 + "abcdef",
    " ".join(["token=abcdef"] * 300),
]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return sorted(spans)


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, found string")
    out = {r["doc_id"]: r for r in secret_scan(docs).select("doc_id", "base", "found").collect()}
    for i, t in enumerate(TEXTS):
        assert [tuple(x)[:3] for x in out[i]["base"]] == brute(t), t
        assert {tuple(x) for x in out[i]["base"]} <= {tuple(x) for x in out[i]["found"]}


def test_model_adds_random_tokens_alone(spark):
    texts = [f"token={r} and" for r in RANDOM[:25]] + [f"the {w} of {w}" for w in WORDS] * 40 + [f"look at {r} there" for r in RANDOM[28:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = secret_scan(docs).select("doc_id", span_text(F.col("found")).alias("s"), redacted(F.col("text"), F.col("found")).alias("t")).collect()
    for r in out:
        if "look at" in texts[r["doc_id"]]:
            assert r["s"] == "markov:8:48" and r["t"] == "look at [secret] there"
        elif "the " in texts[r["doc_id"]]:
            assert r["s"] == "" and r["t"] == texts[r["doc_id"]]
        else:
            assert r["t"] == "[secret] and"


def test_train_and_ratio(spark):
    samples = spark.createDataFrame([(r, 1) for r in RANDOM] + [(w, 0) for w in WORDS] + [(None, 1), ("x", None)], "value string, label int")
    table = train(samples)
    rows = spark.createDataFrame([(RANDOM[0],), (WORDS[0],)], "v string").select(ratio(F.col("v"), table).alias("r")).collect()
    assert rows[0]["r"] > 0 > rows[1]["r"]
    assert not any(train(samples.limit(0)))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "token=abcdef"), (1, "token=abcdef")], "doc_id long, text string")
    assert secret_scan(docs.limit(0)).count() == 0
    assert [span_text(F.col("found")) is not None for _ in secret_scan(docs).collect()] == [True, True]


def test_letters_alone_are_judged(spark):
    letters = ["".join(RNG.choice(string.ascii_letters) for _ in range(40)) for _ in range(5)]
    known = [f"token={r} and" for r in RANDOM] + [f"the {w} of {w}" for w in WORDS] * 40
    table = train(labelled_samples(spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")))
    texts = [f"the {w} of {w}" for w in WORDS] + [f"look at {r} there" for r in letters]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["s"] for r in secret_scan(docs, table=table).select("doc_id", span_text(F.col("found")).alias("s")).collect()}
    assert all(out[i] == "markov:8:48" for i, t in enumerate(texts) if t.startswith("look"))
    assert all(out[i] == "" for i, t in enumerate(texts) if t.startswith("the"))


def test_very_many_matches(spark):
    """Places over block boundaries, and a text whose matches are far too many for work that grows with their square."""
    texts = [" ".join(f"token=abcd{'x' * (i % 7)}ef{i}" for i in range(n)) for n in (255, 256, 257, 513, 60_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan(docs, table=[0.0] * 128 * 128).select("doc_id", "base").collect():
        assert [tuple(x)[:3] for x in r["base"]] == brute(texts[r["doc_id"]])


def test_precision_and_recall(spark):
    """Trained from labelled samples with digit-bearing identifiers; held-out tokens of both kinds are told apart."""
    words = "user profile batch window request cache index offset stream payload customer order version session worker queue node shard".split()
    ordinary = lambda: "_".join(RNG.choice(words) + RNG.choice(["", "", str(RNG.randint(0, 99))]) for _ in range(4))
    secret = lambda: "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(RNG.randint(24, 48)))
    samples = spark.createDataFrame([(ordinary(), 0) for _ in range(400)] + [(secret(), 1) for _ in range(400)], "value string, label int")
    held = [(ordinary(), 0) for _ in range(300)] + [(secret(), 1) for _ in range(300)]
    held = [(v, label) for v, label in held if len(v) >= 20]
    docs = spark.createDataFrame([(i, f"see {v} here") for i, (v, _) in enumerate(held)], "doc_id long, text string")
    found = {r["doc_id"]: r["found"] for r in secret_scan(docs, table=train(samples)).collect()}
    hits = sum(bool(found[i]) for i, (_, label) in enumerate(held) if label)
    false = sum(bool(found[i]) for i, (_, label) in enumerate(held) if not label)
    assert hits / sum(label for _, label in held) > 0.95 and hits / (hits + false) > 0.98


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token=abcdef", 1, 2, 3, 4)], "doc_id long, text string, base int, found int, more int, __matches int")
    r = secret_scan(docs, carry=("base", "found", "more", "__matches"), prefix="own_").first()
    assert (r["base"], r["found"], r["more"], r["__matches"]) == (1, 2, 3, 4) and len(r["own_found"]) == 1
