"""N-gram language-model scores by deleted interpolation.

A token's probability mixes maximum-likelihood estimates,
l2 * c(vw)/c(v) + l1 * c(w)/N + l0 / (V + 1), with weights l of the bucket of
its context's frequency c(v) (powers of two).  Expectation-maximisation learns
the weights from deleted counts: every training token is held out in turn, so
its own occurrence is taken off the counts that predict it.

Everything is counted over all texts; no table of counts is collected or
broadcast.  Neighbouring documents make groups of a few MB, checkpointed as they
are.  A group sends its distinct n-grams, with its own counts, to buckets by the
leading bits of their hash, packed in a few binary cells; a bucket adds up the
groups' counts and answers each group with the totals in the order it asked.  So
an n-gram that is in every text is one entry a group, not one a text, and an
answer costs about a byte.  The groups then keep their tokens as codes with their
counts (a checkpoint again) and make the histogram that the weights need; with the
weights the codes alone give the scores.

Unigrams are told apart by 64 bits of hash, bigrams by 40 bits more than the
number of buckets needs; see the README on what a collision would do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import group_count, grown, saved, text_bytes
from .packs import each_pack, pack, unpacked

END = xxhash.xxh64_intdigest(b" ", 42)  # no word has a space
LEVELS, STEP, BUCKETS = 122, 4, 16  # histogram: a zero level, then quarter powers of two; context buckets
LOW_BITS = 40
WIDE = np.uint64(2**32 - 1)


@dataclass(frozen=True)
class Settings:
    train: str = "coalesce(crc32(cast(doc_id as string)) % 5 <> 1, true)"  #: SQL of "this document is learnt from"
    group_bytes: int = 8_000_000  #: text of a group
    most_bytes: int = 64_000_000  #: of a group of a large input
    bucket_entries: int = 1_000_000  #: n-grams of a bucket, about
    most_entries: int = 8_000_000  #: of a bucket of a large input
    rounds: int = 40  #: of expectation-maximisation


class _Group:
    """The tokens of a group's texts as codes, and its distinct n-grams in the order of their hashes."""

    def __init__(self, packs: list[bytes], bits: int):
        table = unpacked(packs)
        self.ids, self.train = table.column("doc_id"), table.column("train").to_numpy().astype(bool)
        words, self.sizes = [], np.empty(table.num_rows, np.int64)
        for i, t in enumerate(table.column("text")):
            own = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII alone
            words += own
            words.append(b" ")
            self.sizes[i] = len(own) + 1
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in number), np.uint64, len(number))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.uni, self.word = hashes[order], place[codes]
        self.end = place[number[b" "]]
        self.before = np.concatenate([[self.end], self.word[:-1]])  # an end stands before the first word
        pair = self.uni[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.uni[self.word]
        pair ^= pair >> np.uint64(32)
        pair *= np.uint64(0xD6E8FEB86659FD93)
        pair ^= pair >> np.uint64(29)
        self.bi, self.pair = np.unique(pair >> np.uint64(64 - bits - LOW_BITS), return_inverse=True)
        self.learnt = np.repeat(self.train, self.sizes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.bincount(self.word[self.learnt], minlength=len(self.uni)),
            np.bincount(self.pair[self.learnt], minlength=len(self.bi)),
        )


def _gaps(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted numbers as their differences, 4 bytes each; the few that do not fit again in full."""
    step = np.diff(keys, prepend=np.uint64(0))
    return np.minimum(step, WIDE).astype("<u4").tobytes(), step[step >= WIDE].tobytes()


def _from_gaps(cell: bytes, wide: bytes) -> np.ndarray:
    step = np.frombuffer(cell, "<u4").astype(np.uint64)
    step[step == WIDE] = np.frombuffer(wide, np.uint64)
    return np.cumsum(step, dtype=np.uint64)


def _escaped(counts: np.ndarray) -> tuple[bytes, bytes]:
    """One byte each, and the ones of 255 and more again in full."""
    counts = counts.astype(np.uint64)
    return zstandard.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 3), counts[counts >= 255].tobytes()


def _plain(small: bytes, big: bytes) -> np.ndarray:
    out = np.frombuffer(zstandard.decompress(small), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(big, np.uint64).astype(np.int64)
    return out


ASKED = "bucket long, g long, kind int, keys binary, wide binary, small binary, big binary"
TOLD = "g long, bucket long, kind int, small binary, big binary, n long, v long"


def _asks(bits: int):
    """A group's distinct n-grams and own counts, cut by bucket."""

    def run(g: int, packs: list[bytes]) -> pa.Table:
        group = _Group(packs, bits)
        rows = []
        for kind, (keys, shift, counts) in enumerate(zip((group.uni, group.bi), (64 - bits, LOW_BITS), group.counts())):
            bucket = (keys >> np.uint64(shift)).astype(np.int64) if bits or kind else np.zeros(len(keys), np.int64)
            first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            cell = _gaps if kind else lambda k: (k.tobytes(), b"")
            low = keys & np.uint64((1 << LOW_BITS) - 1) if kind else keys  # the bucket's bits are known
            rows += [(int(bucket[x]), g, kind, *cell(low[x:y]), *_escaped(counts[x:y])) for x, y in zip(first, [*first[1:], len(keys)])]
        names = ["bucket", "g", "kind", "keys", "wide", "small", "big"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Adds up a bucket's counts over all groups and tells each group its own n-grams' totals; the bucket's N and V go to group -1."""
    out = []
    kinds = np.array(table.column("kind").to_pylist())
    rows = [table.column(c).to_pylist() for c in ("g", "bucket", "keys", "small", "big", "wide")]
    for kind in (0, 1):
        own = np.flatnonzero(kinds == kind).tolist()
        if not own:
            continue
        keys = [_from_gaps(rows[2][i], rows[5][i]) if kind else np.frombuffer(rows[2][i], np.uint64) for i in own]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        unique, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([_plain(rows[3][i], rows[4][i]) for i in own]), minlength=len(unique)).astype(np.int64)
        if kind == 0:
            out.append((-1, rows[1][own[0]], 0, b"", b"", int(total.sum()), int((total > 0).sum())))
        for i, part in zip(own, np.split(total[inverse], np.cumsum(sizes)[:-1])):
            out.append((rows[0][i], rows[1][i], kind, *_escaped(part), 0, 0))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["g", "bucket", "kind", "small", "big", "n", "v"])


KNOWN = "g long, docs binary, words binary, end int, uni_small binary, uni_big binary, pair_small binary, pair_big binary, cells binary, times binary"


def _known(bits: int, n: int):
    """All that scoring needs of a group: its documents, tokens as codes, counts of words and of the pairs; and its share of the histogram."""

    def run(key, packs: pa.Table, told: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in KNOWN.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in KNOWN.split(", ")]
        group = _Group(packs.column("pack").to_pylist(), bits)
        rows = sorted(zip(*[told.column(c).to_pylist() for c in ("kind", "bucket", "small", "big")]))
        uni, bi = (np.concatenate([_plain(r[2], r[3]) for r in rows if r[0] == kind]) for kind in (0, 1))
        on = group.learnt
        w, v, pair = uni[group.word[on]] - 1, uni[group.before[on]] - 1, bi[group.pair[on]] - 1
        cells, times = np.unique((_context(v) * LEVELS + _level(_ratio(pair, v))) * LEVELS + _level(_ratio(w, np.int64(n - 1))), return_counts=True)
        sink = pa.BufferOutputStream()
        docs = pa.table([group.ids, pa.array(group.train), pa.array(group.sizes)], names=["doc_id", "train", "n_tokens"])
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_table(docs)
        # Codes by frequency, their lowest bytes first: most of the others are zero.
        common = np.argsort(-np.bincount(group.word, minlength=len(group.uni)), kind="stable")
        code = np.empty(len(common), "<u4")
        code[common] = np.arange(len(common))
        words = zstandard.compress(code[group.word].view(np.uint8).reshape(-1, 4).T.tobytes(), 3)
        row = (key[0].as_py(), sink.getvalue().to_pybytes(), words, int(code[group.end]), *_escaped(uni[common]), *_escaped(bi[group.pair]), cells.astype(np.int64).tobytes(), times.astype(np.int64).tobytes())
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

    return run


def _context(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(count + 1).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray) -> np.ndarray:
    """0 for zero, else a quarter power of two, the least likely ones together."""
    with np.errstate(divide="ignore"):
        level = LEVELS - 1 + np.rint(np.log2(p) * STEP)
    return np.where(p > 0, np.clip(level, 1, LEVELS - 1), 0).astype(np.int64)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.where(b > 0, a / np.maximum(b, 1), 0.0)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells, times in zip(*[batch.column(c).to_pylist() for c in ("cells", "times")]):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (cells, times)], ["cell", "n"])


def learn_weights(cells: np.ndarray, times: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """(BUCKETS, 3) weights of the bigram, unigram and uniform estimates, by expectation-maximisation."""
    level = np.concatenate([[0.0], 2.0 ** ((np.arange(1, LEVELS) - LEVELS + 1) / STEP)])
    context = cells // (LEVELS * LEVELS)
    p = np.stack([level[cells // LEVELS % LEVELS], level[cells % LEVELS], np.full(len(cells), 1 / (size + 1))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(rounds):
        mixed = weights[context] * p
        mixed *= (times / mixed.sum(axis=1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(context, weights=mixed[:, k], minlength=BUCKETS) + 1e-3  # an empty bucket stays uniform
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def _scores(n: int, size: int, weights: list[list[float]], id_type: pa.DataType):
    def scored(row: dict) -> pa.RecordBatch:
        docs = pa.ipc.open_stream(row["docs"]).read_all()
        word = np.frombuffer(zstandard.decompress(row["words"]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        uni, pair = _plain(row["uni_small"], row["uni_big"]), _plain(row["pair_small"], row["pair_big"])
        w = uni[word]
        v = np.concatenate([[uni[row["end"]]], w[:-1]])  # an end stands before the first word
        ratio = w / n if n else np.zeros(len(w))
        mix = np.array(weights)[_context(v)]
        # Where the context is new its bigrams say nothing; its weight goes to the others.
        seen = (v > 0).astype(float)
        p = mix[:, 0] * _ratio(pair, v) + (mix[:, 1] + mix[:, 0] * (1 - seen)) * ratio + mix[:, 2] / (size + 1)
        base = np.log10((w + 0.5) / (n + 0.5 * (size + 1)))
        sizes = docs.column("n_tokens").to_numpy()
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return pa.RecordBatch.from_arrays(
            [docs.column("doc_id").combine_chunks().cast(id_type), pa.array(~docs.column("train").to_numpy()), pa.array(sizes), pa.array(np.add.reduceat((w > 0).astype(np.int64), at)), pa.array(np.full(len(at), n)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield scored(batch.slice(k, 1).to_pylist()[0])

    return run


def lm_scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words, A-Z in lower case, and one end a text; a null text is
    empty and has the end alone.  A null id counts as a training document.
    Without training tokens the base is uniform and the model nearly so.
    Repeated rows count and score each.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    size = text_bytes(docs)
    bits = max(0, (group_count(size // 8, grown(size, settings.bucket_entries, settings.most_entries)) - 1).bit_length())
    packs = pack(docs.select(F.expr(settings.train).alias("train"), "doc_id", F.col("text").cast("string").alias("text")), grown(size, settings.group_bytes, settings.most_bytes))
    told = saved(packs.mapInArrow(each_pack(_asks(bits)), ASKED).groupBy("bucket").applyInArrow(_answers, TOLD))
    n, v = (x or 0 for x in told.where("g = -1").agg(F.sum("n"), F.sum("v")).first())
    known = saved(packs.groupBy("g").cogroup(told.where("g >= 0").groupBy("g")).applyInArrow(_known(bits, n), KNOWN))
    cells = known.select("cells", "times").mapInArrow(_histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(float), v, settings.rounds)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return known.mapInArrow(_scores(n, v, weights.tolist(), to_arrow_type(id_type)), schema)
