"""Quality rules with risk-controlled thresholds [native].

Labelled documents are the holdout.  For every stratum, rule and cutoff of a
fixed grid, the rejected good documents are counted; the exact binomial tail
P(X <= rejected | good, alpha) is the p-value of "this cutoff rejects more than
alpha of the good documents".  A cutoff whose p-value is at most delta divided
by the number of all tests (Bonferroni) is certified, and each stratum and rule
uses its strictest certified cutoff, or none.  So with probability 1 - delta no
stratum's rules reject more than ``alpha`` of its good documents; a stratum that
has nothing certified (too few labelled good documents, say) has no cutoff, so
there the base rule alone rejects.  A null stratum is one of its own.

Scale: one pass over the text (a checkpoint keeps a few numbers a document), an
aggregation with map-side combine over strata x rules x bins, and a join with one
row of cutoffs a stratum, broadcast up to ``max_broadcast`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_enough, words_column

#: Rule -> cutoffs, ascending; a document is rejected if its value is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.5),
    "repeat_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "dup_line_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "upper_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8),
    "long_word": (9.0, 12.0, 15.0, 20.0, 30.0, 50.0, 100.0, 300.0),
}


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.05  #: share of a stratum's good documents that its rules may reject
    delta: float = 0.05  #: chance that any stratum exceeds alpha
    min_words: int = 50
    max_repeat_percent: int = 50
    max_broadcast: int = 100_000  #: rows of cutoffs; beyond, they are joined by a shuffle
    rules: dict = field(default_factory=lambda: dict(RULES))


def features(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, and the counts of every whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        "doc_id",
        F.col(stratum_col).cast("string").alias("stratum"),
        words_column(F.col("text")).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"),
    )
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    df = df.withColumn(
        "win",
        F.when(
            F.size("h") > 2,
            F.transform(F.slice("h", F.lit(1), F.size("h") - 2), lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + 1), F.get(F.col("h"), i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only a text with a window twice needs its windows sorted.
    df = df.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("win")) < F.size("win"),
            F.array_sort(F.transform("win", lambda x, i: F.struct(x.alias("k"), i.alias("p")))),
        ),
    )
    same = lambda e, j: F.get(F.col("s"), j)["k"] == e["k"]
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda e, j: F.coalesce((j > 0) & same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False))), lambda e: e["p"])))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return df.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper",
        F.size("lines").cast("long").alias("n_lines"),
    )


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


VALUES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "long_word": ("word_chars", "n_words"),
}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exact, summed in logarithms."""
    import math

    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))

    def step(acc: Column, j: Column) -> Column:
        term = acc["t"] + F.log((n - j + 1) / j) + F.lit(odds)
        top = F.greatest(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(F.least(acc["s"], term) - top))).alias("s"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        step,
        lambda acc: F.exp(acc["s"]),
    )
    return F.when(k >= n, F.lit(1.0)).otherwise(total)


def certified_cutoffs(feats: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (stratum, rule, cutoff): the strictest certified cutoff of each, null where none is.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows with a null or
    another value are left out, and of several labels of a document the
    lowest counts.
    """
    good = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    )
    rules = list(settings.rules)
    bins = F.array(*[
        F.struct(
            F.lit(r).alias("rule"),
            sum((F.when(_share(*VALUES[r]) > c, 1).otherwise(0) for c in settings.rules[r]), F.lit(0)).alias("bin"),
        )
        for r in rules
    ])
    counts = (
        feats.join(good, "doc_id")
        .select("stratum", bins.alias("bins"))
        .select("stratum", F.inline("bins").alias("rule", "bin"))
        .groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n"))
        .groupBy("stratum", "rule").agg(F.sum("n").alias("good"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    )
    width = max(len(c) for c in settings.rules.values())
    cutoffs = F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*[F.lit(float(c)) for c in settings.rules[r]]))])
    counts = saved(counts)
    tests = max(1, counts.where(F.col("rule") == rules[0]).count()) * len(rules) * width
    each = settings.alpha / len(rules)
    tested = (
        counts.select("stratum", "rule", "good", "bins", F.posexplode(cutoffs[F.col("rule")]).alias("j", "cutoff"))
        .withColumn("lost", F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("j")), F.lit(0).cast("long"), lambda a, b: a + b["n"]))
    )
    # Beyond alpha itself the tail is about a half or more; it needs no sum.
    tail = F.when(F.col("lost") > F.col("good") * each, F.lit(1.0)).otherwise(binomial_tail(F.col("lost"), F.col("good"), each))
    return (
        tested.withColumn("p", tail)
        .groupBy("stratum", "rule").agg(F.min(F.when(F.col("p") <= settings.delta / tests, F.col("cutoff"))).alias("cutoff"))
    )


def quality_rules(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), stratum_col: str = "lang") -> DataFrame:
    """One row a document: its counts, ``base_failed``, ``kept`` and ``failed_rules``.

    A null text is empty (so base_failed).  A stratum without a certified cutoff,
    as one without labelled good documents, is judged by the base rule alone.
    Repeated rows are judged alike; other columns are ignored.
    """
    feats = saved(features(docs, stratum_col))
    rows = certified_cutoffs(feats, labels, settings)
    own = rows.groupBy(F.col("stratum").alias("of")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in settings.rules])
    failed = F.array_compact(F.array(*[F.when(_share(*VALUES[r]) > F.col(f"c_{r}"), F.lit(r)) for r in settings.rules]))
    base = (F.col("n_words") < settings.min_words) | (100 * F.col("n_repeat_words") > settings.max_repeat_percent * F.col("n_words"))
    return (
        feats.join(small_enough(own, settings.max_broadcast), F.col("stratum").eqNullSafe(F.col("of")), "left")
        .withColumn("failed_rules", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            base.alias("base_failed"), (~base & (F.size("failed_rules") == 0)).alias("kept"),
            F.col("stratum"), F.array_join("failed_rules", ",").alias("failed_rules"),
        )
    )
