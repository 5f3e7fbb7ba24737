"""Secret scans [native]: fixed base patterns and a character Markov model.

The base rules find assignments, access keys and hex strings.  The model adds
long tokens that look random: two character Markov models, one of random
strings (the values the base rules found: the labelled positives) and one of
ordinary identifiers (long tokens of texts without any base finding, but for those
of letters and digits: the negatives), are compared by their log-likelihood ratio.

Offsets come from ``split`` and ``regexp_extract_all`` of the same pattern:
what lies between the matches and the matches themselves, whose lengths are added.
Training and scanning are one pass over the text each; the only data that meets
is the bigram table, at most (alphabet squared) rows for each of two labels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix
from .shingles import kept_whole

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # greedy: the same as any longer run that is then measured
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6  #: characters of what is assigned
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class Settings:
    min_token: int = 20  #: shortest token that the model may add
    min_training_token: int = 12  #: shortest ordinary token that it learns from
    min_ratio: float = 12.0  #: natural log-likelihood ratio from which a token is a secret
    smoothing: float = 0.5  #: added to the count of each character
    weight: float = 5.0  #: how many bigrams the prior of a character's followers counts for


ENTRY = "array<struct<s:int,k:int,e:int,v:string>>"
BLOCK = 256  #: matches whose lengths are added up at a time


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<g, n, v>> of all matches: the length of what lies before since the last, the match's own, its value."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    value = (lambda m: F.regexp_extract(m, pattern, 2)) if kind == 0 else (lambda m: m)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found, lambda g, m: F.struct(g.alias("g"), F.length(m).alias("n"), value(m).alias("v")))


def with_spans(df: DataFrame, wanted: list[tuple[str, str, int, Column | None]]) -> DataFrame:
    """Adds the columns (name, pattern, kind, test): array<struct<s, k, e, v>> in code points, e exclusive; empty where the test fails.

    Places are sums of lengths, block by block, so that a text with very many
    matches costs little more than its matches do.
    """
    free = free_prefix([*df.columns, *[w[0] for w in wanted]])
    matches, blocks = free + "matches", free + "blocks"
    text = F.col("text")
    summed = lambda array, start, n: F.aggregate(F.slice(array, start, n), F.lit(0), lambda a, x: a + x["g"] + x["n"])
    for name, pattern, kind, ok in wanted:
        none = F.array().cast("array<struct<g:int,n:int,v:string>>")
        df = df.withColumn(matches, kept_whole(F.when(text.rlike(pattern) if ok is None else ok, _matches(text, pattern, kind)).otherwise(none)))
        df = df.withColumn(blocks, kept_whole(F.transform(F.sequence(F.lit(0), F.floor(F.size(matches) / BLOCK).cast("int")), lambda b: summed(F.col(matches), F.lit(1), b * BLOCK))))

        def place(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(F.col(blocks), block) + summed(F.col(matches), block * BLOCK + 1, i - block * BLOCK) + m["g"]
            return F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + m["n"]).alias("e"), m["v"].alias("v"))

        df = df.withColumn(name, F.transform(matches, place).cast(ENTRY)).drop(matches, blocks)
    return df


MAY_ASSIGN = "(?i:password|passwd|secret|token|api_?key)"


def base_spans(docs: DataFrame, carry: tuple[str, ...] = (), name: str = "base") -> DataFrame:
    """doc_id, text, the columns of ``carry``, and ``base``, sorted by start and then kind (null text: none)."""
    kept = ["doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")]]
    free = free_prefix([*kept, name])
    names = [free + k for k in KINDS[:3]]
    df = with_spans(docs.select(*kept), [(names[0], ASSIGN, 0, F.col("text").rlike(MAY_ASSIGN)), (names[1], ACCESS, 1, None), (names[2], HEX, 2, None)])
    long = F.filter(names[0], lambda x: F.length(x["v"]) >= LEAST_VALUE)
    return df.select(*kept, kept_whole(F.array_sort(F.concat(long, *names[1:]))).alias(name))


def _mixed(value: Column) -> Column:
    """Whether a long token is likely a secret at first sight, so no negative: it has a letter and a digit."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _ordinary(text: Column, settings: Settings) -> Column:
    found = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{%d,}" % settings.min_training_token), F.lit(0))
    return F.filter(found, lambda v: (F.length(v) < settings.min_token) | ~_mixed(v))


def labelled_samples(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(value, label): 1 for what the base rules found, 0 for long tokens of texts where they found nothing."""
    text = F.col("text")
    none = F.array().cast("array<string>")
    values = lambda pattern, group, may: F.when(text.rlike(may), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none)
    assigned = F.filter(values(ASSIGN, 2, MAY_ASSIGN), lambda v: F.length(v) >= LEAST_VALUE)
    found = docs.select("text", kept_whole(F.concat(assigned, values(ACCESS, 0, ACCESS), values(HEX, 0, HEX))).alias("v"))
    return found.select(
        F.when(F.size("v") > 0, F.col("v")).otherwise(_ordinary(text, settings)).alias("v"), F.when(F.size("v") > 0, 1).otherwise(0).alias("label")
    ).select(F.explode("v").alias("value"), "label")


def train(samples: DataFrame, settings: Settings = Settings()) -> list[float]:
    """Log-likelihood ratios of all bigrams, at 128 * first + second; what is not in the alphabet counts zero.

    Two rows at most for each pair of the alphabet come to the driver.  A class
    without samples is uniform; with no samples at all every ratio is zero.
    """
    letters = F.regexp_replace("value", "[^A-Za-z0-9+/_=-]", "")
    pairs = (
        samples.where(F.col("value").isNotNull() & F.col("label").isin(0, 1))
        .select("label", letters.alias("v")).where(F.length("v") > 1)
        .select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("v") - 1), lambda i: F.substring("v", i, 2))).alias("pair"))
        .groupBy("label", "pair").agg(F.count("*").alias("n"))
    )
    counts: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for r in pairs.collect():
        counts[r["label"]][r["pair"]] = r["n"]
    table = [0.0] * (128 * 128)
    if not counts[0] and not counts[1]:
        return table
    single = {k: {b: sum(n for pair, n in own.items() if pair[1] == b) for b in ALPHABET} for k, own in counts.items()}

    def likely(k: int, a: str, b: str, row: int, whole: int) -> float:
        """P(b | a) of a class, smoothed towards the class's own P(b), and that towards uniform."""
        alone = (single[k][b] + settings.smoothing) / (whole + settings.smoothing * len(ALPHABET))
        return (counts[k].get(a + b, 0) + settings.weight * alone) / (row + settings.weight)

    whole = {k: sum(single[k].values()) for k in (0, 1)}
    for a in ALPHABET:
        row = {k: sum(counts[k].get(a + b, 0) for b in ALPHABET) for k in (0, 1)}
        for b in ALPHABET:
            table[128 * ord(a) + ord(b)] = math.log(likely(1, a, b, row[1], whole[1]) / likely(0, a, b, row[0], whole[0]))
    return table


def ratio(value: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token of ASCII characters, random against ordinary."""
    cells = F.split(F.lit(" ".join(repr(round(x, 6)) for x in table)), " ").cast("array<double>")  # folded to one literal
    return F.aggregate(
        F.sequence(F.lit(1), F.length(value) - 1),
        F.lit(0.0),
        lambda acc, i: acc + F.get(cells, 128 * F.ascii(F.substring(value, i, 1)) + F.ascii(F.substring(value, i + 1, 1))),
    )


def secret_scan(
    docs: DataFrame, settings: Settings = Settings(), table: list[float] | None = None, carry: tuple[str, ...] = (), prefix: str = ""
) -> DataFrame:
    """doc_id, text, ``base`` and ``found``: array<struct<s, k, e, v>> by start and then kind (an index of KINDS).

    Base spans stay as they are; the model adds tokens that overlap none of
    them, of ``min_token`` characters and more, whose ratio reaches ``min_ratio``.
    A null text is empty; repeated rows are scanned alike; only the columns named
    in ``carry`` come along; ``prefix`` goes before the new names where one of
    them has such a name.  Without a table it learns from ``docs``.
    """
    if table is None:
        table = train(labelled_samples(docs, settings), settings)
    token = r"[A-Za-z0-9+/_=-]{%d,}" % settings.min_token
    base, found = f"{prefix}base", f"{prefix}found"
    df = base_spans(docs, carry, base)
    more = free_prefix([*df.columns, found]) + "more"
    df = with_spans(df, [(more, token, 3, None)])
    random = F.filter(more, lambda m: ~F.exists(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])) & (ratio(m["v"], table) >= settings.min_ratio))
    return df.withColumn(found, F.array_sort(F.concat(base, random))).drop(more)


def span_text(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
