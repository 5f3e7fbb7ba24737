"""Language ID of code-switched text by a linear-chain conditional random field.

Words are labelled one by one.  A word's score for each language is a sum of
learnt weights of its features: character n-grams of one to four characters
(those that hold the start or the end mark are the affixes) and membership in a
lexicon of each language's frequent words.  Learnt transitions join neighbouring
words, and forward-backward gives every word's posterior.  A document's language
is the one with the largest sum of posteriors; its score is that share.

The model is fitted on the driver, on a bounded sample: ``docs_each`` training
documents of each language, those with the smallest hashes, whole texts and each
once; the weights are about a quarter of a MB a language.  Prediction is one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    docs_each: int = 150  #: training documents of a language
    chars_each: int = 2_000_000  #: of these documents, and of one that may be learnt from
    chars: int = 100_000_000  #: of all training documents
    table: int = 1 << 15  #: cells that n-grams are hashed to
    lexicon: int = 1000  #: frequent words of a language
    rounds: int = 25  #: of gradient ascent
    rate: float = 0.5
    ridge: float = 1e-4
    train: str = "coalesce(crc32(cast(doc_id as string)) % 4 <> 2, true)"  #: SQL of "this document may be learnt from"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; none if no character is a letter."""
    found = LETTERS.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
        return []
    return found


class Model:
    """Weights, lexicons and transitions; small enough to be sent with the task."""

    def __init__(self, languages: list[str], settings: Settings, lexicon: dict[str, tuple[int, ...]]):
        self.languages, self.table, self.lexicon = languages, settings.table, lexicon
        k = len(languages)
        self.weights = np.zeros((settings.table + k + 1, k))  # n-grams, lexicons, "in no lexicon"
        self.moves = np.zeros((k, k))

    def features(self, types: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat feature cells of the words, and where each word's begin (all have some)."""
        points = np.frombuffer("".join(f"^{w}$" for w in types).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in types], np.int64)
        end = np.repeat(np.cumsum(size), size)
        at = np.arange(len(points))
        rolled = np.zeros(len(points), np.uint64)
        cells, owner = [], []
        word = np.repeat(np.arange(len(types)), size)
        for n in range(4):
            shifted = np.zeros(len(points), np.uint64)
            shifted[: len(points) - n] = points[n:]
            rolled = (rolled ^ shifted) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            ok = at + n < end
            mixed = rolled[ok]
            cells.append(((mixed ^ (mixed >> np.uint64(31))) % np.uint64(self.table)).astype(np.int64))
            owner.append(word[ok])
        known = [self.lexicon.get(w, (len(self.languages),)) for w in types]
        cells.append(self.table + np.array([i for own in known for i in own], np.int64))
        owner.append(np.repeat(np.arange(len(types)), [len(own) for own in known]))
        cells, owner = np.concatenate(cells), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return cells[order], np.searchsorted(owner[order], np.arange(len(types)))

    def emissions(self, types: list[str], chunk: int = 20_000) -> np.ndarray:
        out = [np.zeros((0, len(self.languages)))]
        for k in range(0, len(types), chunk):
            cells, begin = self.features(types[k : k + chunk])
            out.append(np.add.reduceat(self.weights[cells], begin, axis=0))
        return np.concatenate(out)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words of several sequences laid end to end, and the expected number of each move.

    All sequences advance together, longest first, so a step is one small
    matrix product over those that still have a word there.
    """
    k = scores.shape[1]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    start, size = begins[order][sizes[order] > 0], sizes[order][sizes[order] > 0]
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    expected = np.zeros((k, k))
    if not len(size):
        return emit, expected
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
    now = emit[start] / emit[start].sum(axis=1, keepdims=True)
    ahead[start] = now
    for t in range(1, size[0]):
        n = active[t]
        at = start[:n] + t
        now = (now[:n] @ step) * emit[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    back[start + size - 1] = 1.0
    for t in range(int(size[0]) - 1, 0, -1):
        at = start[: active[t]] + t
        later = emit[at] * back[at]
        before = later @ step.T
        before /= before.sum(axis=1, keepdims=True)
        back[at - 1] = before
    after = np.ones(len(emit), bool)
    after[start] = False
    at = np.flatnonzero(after)
    later = emit[at] * back[at]
    norm = ((ahead[at - 1] @ step) * later).sum(axis=1, keepdims=True)
    expected = step * (ahead[at - 1].T @ (later / norm))
    posterior = ahead * back
    return posterior / posterior.sum(axis=1, keepdims=True), expected


def fit(samples: list[tuple[str, str]], settings: Settings = Settings()) -> Model:
    """A model of (text, language) pairs; sequences join texts of several languages, so that moves are learnt too."""
    languages = sorted({lang for _, lang in samples})
    counts = {lang: Counter() for lang in languages}
    split = [(words_of(t), lang) for t, lang in samples]
    split = [(w, lang) for w, lang in split if w]
    for words, lang in split:
        counts[lang].update(words)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, lang in enumerate(languages):
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[: settings.lexicon]:
            lexicon[w] = (*lexicon.get(w, ()), i)
    model = Model(languages, settings, lexicon)
    if len(languages) < 2 or not split:
        return model
    flat = [w for words, _ in split for w in words]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    label = np.repeat([languages.index(lang) for _, lang in split], [len(w) for w, _ in split])
    sizes = np.diff(np.append(np.arange(0, len(flat), 400), len(flat)))  # whole texts, cut evenly for even steps
    cells, begin = model.features(list(number))
    owner = np.repeat(np.arange(len(number)), np.diff(np.append(begin, len(cells))))
    k = len(languages)
    seen_moves = np.zeros((k, k))
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inside)
    np.add.at(seen_moves, (label[at - 1], label[at]), 1)
    past_w, past_m = np.full(model.weights.shape, 1e-8), np.full((k, k), 1e-8)
    for _ in range(settings.rounds):
        emitted = np.add.reduceat(model.weights[cells], begin, axis=0)
        posterior, expected = forward_backward(emitted[word], sizes, model.moves)
        error = -posterior
        error[np.arange(len(flat)), label] += 1
        by_word = np.stack([np.bincount(word, weights=error[:, j], minlength=len(number)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(cells, weights=by_word[owner, j], minlength=len(model.weights)) for j in range(k)], axis=1) / len(flat)
        grad -= settings.ridge * model.weights
        move = (seen_moves - expected) / len(flat) - settings.ridge * model.moves
        past_w += grad * grad
        past_m += move * move
        model.weights += settings.rate * grad / np.sqrt(past_w)
        model.moves += settings.rate * move / np.sqrt(past_m)
    return model


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on the documents with the smallest hashes of each language; labels and texts that are null are left out.

    At most ``docs_each`` texts of a language come to the driver, of together
    ``chars_each`` characters and ``chars`` for all languages; a longer text is
    not learnt from.  Copies of a text count once.
    """
    able = docs.where(F.expr(settings.train)).where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")
    )
    common = able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not common:
        return Model([], settings, {})
    # A bound on the hash that over twice as many pass as are needed; of those one of each text, then the smallest.
    share = lambda n: min(1.0, (2.5 * settings.docs_each + 50) / max(n, 1))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(2**63 - 1, int((share(r["n"]) - 0.5) * 2**64))) for r in common], "lang string, bound long")
    most = min(settings.chars_each, settings.chars // len(common))
    one = able.join(F.broadcast(bounds), "lang").where((F.col("h") <= F.col("bound")) & (F.length("text") <= most)).groupBy("lang", "h").agg(F.min("text").alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("h")
    first = one.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= settings.docs_each)
    rows = first.withColumn("sum", F.sum(F.length("text")).over(by_hash.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most)
    chosen = sorted(((r["h"], r["lang"], r["text"]) for r in rows.select("h", "lang", "text").collect()))
    return fit([(text, lang) for _, lang, text in chosen], settings)


def predict(docs: DataFrame, model: Model, chunk_chars: int = 1_500_000, carry: tuple[str, ...] = (), segments: bool = False, max_cached: int = 200_000, prefix: str = "") -> DataFrame:
    """doc_id, lang_pred, score, and the columns named in ``carry``; with ``segments``, the runs of words of one language.

    ``und`` with score 0 for a text that is null or has no letter, and for all if
    the model knows no language.  Repeated rows are labelled alike.  ``prefix``
    goes before the new names where a carried column has one of them.
    """
    run_type = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.LongType())]))
    kept = ["doc_id", *[c for c in carry if c != "doc_id"]]
    schema = T.StructType([
        *[T.StructField(c, docs.schema[c].dataType) for c in kept], T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType()),
        *([T.StructField(f"{prefix}segments", run_type)] if segments else []),
    ])
    names = [f.name for f in schema.fields]
    # A text that is carried along is sent once.
    place = kept.index("text") if "text" in kept and isinstance(docs.schema["text"].dataType, T.StringType) else len(kept)

    def label(texts: list[str | None], cache: dict[str, int], known: list[np.ndarray]):
        split = [words_of(t) for t in texts]
        flat = [w for words in split for w in words]
        sizes = np.array([len(w) for w in split], np.int64)
        if not flat or not model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        new = list(dict.fromkeys(w for w in flat if w not in cache))
        if len(cache) + len(new) > max_cached:
            cache.clear()
            known[0] = known[0][:0]
            new = list(dict.fromkeys(flat))
        cache.update(zip(new, range(len(cache), len(cache) + len(new))))
        known[0] = np.concatenate([known[0], model.emissions(new)])
        posterior, _ = forward_backward(known[0][np.fromiter(map(cache.__getitem__, flat), np.int64, len(flat))], sizes, model.moves)
        total = np.zeros((len(texts), len(model.languages)))
        full = sizes > 0
        begins = (np.cumsum(sizes) - sizes)[full]
        total[full] = np.add.reduceat(posterior, begins, axis=0) / sizes[full, None]
        best = total.argmax(axis=1)
        langs = [model.languages[b] if f else UNKNOWN for b, f in zip(best, full)]
        runs: list[list] = [[] for _ in texts]
        if segments:
            word_lang = posterior.argmax(axis=1)
            for i, (b, s) in enumerate(zip(np.cumsum(sizes) - sizes, sizes)):
                own = word_lang[b : b + s]
                cuts = np.flatnonzero(np.diff(own, prepend=-1))
                runs[i] = [{"lang": model.languages[own[c]], "words": int(n)} for c, n in zip(cuts, np.diff(np.append(cuts, s)))]
        return langs, np.minimum(total.max(axis=1), 1.0), runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        known = [np.zeros((0, len(model.languages)))]
        for batch in batches:
            texts, at = batch.column(place).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= chunk_chars):
                    chars += len(texts[end] or "")
                    end += 1
                langs, score, runs = label(texts[at:end], cache, known)
                cols = [batch.column(i).slice(at, end - at) for i in range(len(kept))] + [pa.array(langs, pa.string()), pa.array(score)]
                if segments:
                    cols.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(cols, names)
                at = end

    more = [F.col("text").cast("string").alias(free_prefix(names) + "text")] if place == len(kept) else []
    return docs.select(*kept, *more).mapInArrow(run, schema)


def language_id(docs: DataFrame, settings: Settings = Settings(), segments: bool = False) -> DataFrame:
    """Learns from the training documents and labels all: doc_id, held_out, lang_pred, score."""
    out = predict(docs, train(docs, settings), segments=segments)
    return out.withColumn("held_out", ~F.expr(settings.train))
