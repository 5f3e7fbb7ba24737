"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes segments that no piece can cross: a run of spaces and what
follows it.  The different segments of a batch are laid out as one flat array of
symbols.  Each round finds every segment's smallest pair rank (a segmented
minimum), merges its leftmost non-overlapping occurrences at once, and compacts
the array; segments without a mergeable pair leave it.  Where a new pair would
rank as well as the pair just merged, only the leftmost occurrence is merged in
that round, so that the order is the library's: best score first, leftmost on a
tie.  Segments once encoded are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)
SPACE = "▁"


class PieceCodec:
    """Encodes and decodes with the pieces and scores of a SentencePiece BPE model file."""

    def __init__(self, model_file: str, max_cached: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only BPE models that keep the text as it is are supported")
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [p.piece for p in proto.pieces]
        self.size, self.dummy_prefix = len(pieces), norm.add_dummy_prefix
        self.bos, self.eos, self.unk = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id, proto.trainer_spec.unk_id
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.UNUSED)}
        if any(p.type == kind.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece crosses the start of a word")
        self.bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_ids = np.array([self.bytes_of.get(b, self.unk) for b in range(256)], np.int32)
        self.fallback = proto.trainer_spec.byte_fallback

        #: Symbol of a code point: its piece, or size + code point if it has none.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = -np.array([p.score for p in proto.pieces])
        ranks = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.rank = ranks[self.merged]

        newline = "" if any("\n" in p for p in normal) else "\n"  # then it is a boundary of its own
        self.segment = re.compile(f" +[^ {newline}]*|{newline and newline + '|'}[^ {newline}]+")
        self.max_cached = max_cached
        self._forget()

        text = [b"" if p.type in (kind.CONTROL,) else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        if proto.trainer_spec.unk_surface:
            text[self.unk] = proto.trainer_spec.unk_surface.encode()
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)
        self.text_pool = np.frombuffer(b"".join(text), np.uint8)

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[at] == key) & (a < self.size) & (b < self.size)
        return np.where(ok, self.rank[at], NONE), self.merged[at]

    def _merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all segments and where each segment's begin, after all merges."""
        points = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.symbol[points], np.repeat(np.arange(len(segments), dtype=np.int32), [len(s) for s in segments])
        done_sym, done_word = [], []
        fresh = None
        while len(sym):
            n = len(sym)
            if fresh is None:
                rank, new = np.full(n, NONE), np.zeros(n, np.int32)
                at = np.arange(n - 1)
            else:
                touched = np.zeros(n, bool)
                touched[fresh] = touched[np.maximum(fresh - 1, 0)] = True
                touched[n - 1] = False
                at = np.flatnonzero(touched)
                rank[n - 1] = NONE
            inside = word[at] == word[at + 1]
            rank[at[~inside]] = NONE
            at = at[inside]
            rank[at], new[at] = self._lookup(sym[at], sym[at + 1])

            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.concatenate([first, [n]]))
            low = np.minimum.reduceat(rank, first)
            if (low == NONE).any():  # finished segments leave
                keep = np.repeat(low != NONE, count)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
                count, low = count[low != NONE], low[low != NONE]
                n = len(sym)
                if not n:
                    break
            least = np.repeat(low, count)
            hit = rank == least
            # In a run of overlapping hits every other one is merged, from the left.
            place = np.arange(n)
            begins = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), place, 0))
            at = np.flatnonzero(hit & ((place - begins) % 2 == 0))
            m = new[at]
            # New pairs, as they are when each merge is made: left neighbours merged before, right ones not yet.
            chained = np.concatenate([[False], at[1:] - at[:-1] == 2])
            before = np.where(chained, np.concatenate([[0], m[:-1]]), sym[np.maximum(at - 1, 0)])
            left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
            after = np.minimum(at + 2, n - 1)
            right = (at + 2 < n) & (word[after] == word[at])
            better = (left & (self._lookup(before, m)[0] <= least[at])) | (right & (self._lookup(m, sym[after])[0] <= least[at]))
            if better.any():
                unsafe = np.isin(word[at], word[at[better]])
                leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                at = at[~unsafe | leftmost]
                m = new[at]
            sym[at] = m
            keep = np.ones(n, bool)
            keep[at + 1] = False
            fresh = (np.cumsum(keep) - 1)[at]
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int32)
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        alien = sym >= self.size
        if alien.any():  # characters without a piece become the bytes of their UTF-8 form
            if not self.fallback:
                sym = np.where(alien, self.unk, sym)
            else:
                raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[alien] - self.size).tolist()]
                times = np.ones(len(sym), np.int64)
                times[alien] = [len(r) for r in raw]
                sym, word, alien = np.repeat(sym, times), np.repeat(word, times), np.repeat(alien, times)
                sym[alien] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.searchsorted(word, np.arange(len(segments) + 1))

    def encode(self, texts: list[str | None], add_bos: bool = True, add_eos: bool = True) -> list[np.ndarray]:
        """Ids of each whole text (null: empty), begin and end ids included."""
        prefix = " " if self.dummy_prefix else ""
        parts = [self.segment.findall(prefix + t.replace(SPACE, " ")) if t else [] for t in texts]
        flat = [s for p in parts for s in p]
        got = list(map(self.cache.get, flat))
        if None in got:
            new = list(dict.fromkeys(s for s, g in zip(flat, got) if g is None))
            if len(self.cache) + len(new) > self.max_cached:
                self._forget()
                new = list(dict.fromkeys(flat))
            ids, at = self._merge(new)
            base = len(self.cache)
            self.cache.update(zip(new, range(base, base + len(new))))
            self.at = np.concatenate([self.at[:-1], at + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            got = list(map(self.cache.__getitem__, flat))
        got = np.array(got, np.int64)
        begin, size = self.at[got], self.at[got + 1] - self.at[got]
        ends = np.cumsum(size)
        all_ids = self.ids[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])]
        head, tail = ([self.bos] if add_bos else []), ([self.eos] if add_eos else [])
        return [np.concatenate([head, all_ids[a:b], tail]).astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: pieces joined, one leading space of the dummy prefix taken off, bytes read as UTF-8."""
        ids = np.asarray(ids, np.int64)
        begin, size = self.text_at[ids], self.text_at[ids + 1] - self.text_at[ids]
        ends = np.cumsum(size)
        raw = self.text_pool[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The worker's codec of a model file; it lives as long as the Python worker."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def encode_decode(docs: DataFrame, model_file: str, chunk_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, begin and end ids included) and decoded (string).

    A null text is empty: begin and end ids, decoded to "".  Rows keep their
    order and number; other columns are ignored.  ``model_file`` must be
    readable on every executor.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= chunk_chars):
                    chars += len(texts[end] or "")
                    end += 1
                ids = c.encode(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
                at = end
        c._forget()  # a reused worker keeps no more than the model

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
