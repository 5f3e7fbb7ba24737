"""Exact removal of repeated passages, by suffix arrays over what can be repeated.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  Three steps find these strings exactly:

1. Anchors.  Of the hashes of the ``GRAM``-byte substrings of a string of LENGTH
   bytes the smallest, the leftmost of equal ones, is its anchor (winnowing), so
   equal strings have the same anchor at the same place.  Groups of neighbouring
   texts of a few MB send their distinct anchors to buckets and learn which ones
   other texts have too.
2. Contexts.  An anchor that several texts have gets its context, the bytes of all
   strings whose anchor it is.  A group sends each distinct context once, with its
   smallest document.  The distinct contexts of an anchor make one text, whose
   suffix array (by Lyndon grouping, see ``suffix_array``) brings equal strings
   together; the smallest document of each run of equal strings decides.  The
   answer is a mask of the strings of each context that a smaller document has.
3. Removal.  Each group covers the bytes of the strings so found.

An anchor with more than ``max_contexts`` occurrences (a line that is in a third
of all texts, say) is not gathered: its strings are sent one by one, each to the
bucket of its own hash (128 bits), one a group, and the smallest document comes
back.  The compressed texts are checkpointed once and shuffled once; besides,
about 7 % of their bytes are shuffled as anchors of 6 bytes, and the contexts.
Nothing is collected or broadcast.
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
from .suffix_array import suffix_arrays

LENGTH, GRAM = 50, 25
REACH = LENGTH - GRAM  # bytes of a context on either side of the anchor
WINDOW = REACH + 1  # grams of a string
WIDTH = GRAM + 2 * REACH
BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Settings:
    group_bytes: int = 4_000_000  #: text of a group
    most_bytes: int = 64_000_000  #: of a group of a large input
    bucket_anchors: int = 1_500_000  #: of a bucket, about
    most_anchors: int = 24_000_000  #: of a bucket of a large input
    max_contexts: int = 5_000  #: occurrences of an anchor beyond which its strings are sent one by one


def _slid(values: np.ndarray, count: int, join, empty) -> np.ndarray:
    """join over ``count`` neighbours from each place on; places past the end are ``empty``."""

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.full(min(by, len(x)), empty, x.dtype)])

    size = 1
    while size * 2 <= count:
        values, size = join(values, shifted(values, size)), size * 2
    return join(values, shifted(values, count - size)) if size < count else values


def _grams(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each place on (those that reach over the end are wrong)."""
    with np.errstate(over="ignore"):
        one = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        one ^= one >> np.uint64(32)

        total, size, power, span = None, 0, one, 1
        left = GRAM
        while left:
            if left & 1:
                if total is None:
                    total, size = power, span
                else:
                    later = np.zeros_like(power)
                    later[: len(power) - size] = power[size:]
                    total, size = total * np.uint64(pow(int(BASE), span, 1 << 64)) + later, size + span
            left >>= 1
            if left:
                later = np.zeros_like(power)
                later[: len(power) - span] = power[span:]
                power, span = power * np.uint64(pow(int(BASE), span, 1 << 64)) + later, span * 2
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of texts that lie end to end; a text shorter than LENGTH has none."""
    if len(raw) < GRAM:  # the shifts of _grams need so many bytes
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    to_end = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(raw))
    grams = _grams(raw)
    grams[to_end < GRAM] = NEVER
    low = _slid(grams, WINDOW, np.minimum, NEVER)
    low[to_end < LENGTH] = 0  # no window starts here
    # A gram is an anchor if it is the smallest of some window that it lies in.
    high = _slid(low[::-1], WINDOW, np.maximum, np.uint64(0))[::-1]
    at = np.flatnonzero((high == grams) & (to_end >= GRAM))
    return at, grams[at]


def strings_of(at: np.ndarray, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose smallest gram is each anchor, the leftmost of equal ones; none if last < first.

    A smaller gram of a string is one of its anchors, so anchors alone are compared.
    """
    first, last = np.maximum(at - REACH, begins), np.minimum(at, ends - LENGTH)
    for by in range(1, WINDOW):
        near = np.flatnonzero(at[by:] - at[:-by] < WINDOW)
        near = near[begins[near] == begins[near + by]]
        if not len(near):
            break
        far = near + by
        less = hashes[far] < hashes[near]
        a, b = near[less], far[less]
        last[a] = np.minimum(last[a], at[b] - WINDOW)
        a, b = near[~less], far[~less]
        first[b] = np.maximum(first[b], at[a] + 1)
    return first, last


class _Group:
    """The bytes of a group's texts and their anchors."""

    def __init__(self, packs: list[bytes]):
        table = unpacked(packs)
        self.ids = table.column("doc_id").to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.begins = self.ends - [len(t) for t in texts]
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        known = np.array([i is not None for i in self.ids], bool)
        self.doc = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        places, hashes = [], []
        step, first = 1_000_000, 0
        while first < len(texts):  # some texts at a time: the arrays stay in the cache
            last = max(first + 1, int(np.searchsorted(self.ends, self.begins[first] + step, "right")))
            a, b = int(self.begins[first]), int(self.ends[last - 1])
            at, h = anchors(self.raw[a:b], self.ends[first:last] - a)
            places.append(at + a)
            hashes.append(h)
            first = last
        self.at = np.concatenate(places) if places else np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.text = np.searchsorted(self.ends, self.at, "right")
        self.first, self.last = strings_of(self.at, self.hash, self.begins[self.text], self.ends[self.text])
        on = (self.first <= self.last) & known[self.text]  # a text without an id neither loses bytes nor takes them
        self.at, self.hash, self.text, self.first, self.last = (x[on] for x in (self.at, self.hash, self.text, self.first, self.last))
        self.hash = (self.hash ^ self.hash >> np.uint64(29)) * BASE  # the smallest of many are small: deal them evenly
        self.keys, self.which, self.times = np.unique(self.hash, return_inverse=True, return_counts=True)

    def several(self) -> np.ndarray:
        """Of each distinct anchor: whether two documents of the group have it."""
        low, high = np.full(len(self.keys), 2**63 - 1), np.full(len(self.keys), -(2**63))
        np.minimum.at(low, self.which, self.doc[self.text])
        np.maximum.at(high, self.which, self.doc[self.text])
        return low < high

    def contexts(self, codes: np.ndarray) -> None:
        """Lays out the distinct contexts (and the strings of crowded anchors) of the anchors that others have."""
        code = codes[self.which]
        on = np.flatnonzero(code > 0)
        at, text = self.at[on], self.text[on]
        left, right = at - self.first[on], self.last[on] + LENGTH - at
        blob = self.raw.tobytes()
        digest = xxhash.xxh3_64_intdigest
        own = np.fromiter((digest(blob[a:b]) for a, b in zip((at - left).tolist(), (at + right).tolist())), np.uint64, len(on))
        own ^= left.astype(np.uint64) * BASE
        crowd = code[on] == 2
        self.occurs = on, at, left, right
        # Distinct contexts, in the order of their anchors.
        usual = np.flatnonzero(~crowd)
        order = usual[np.lexsort((self.doc[text[usual]], own[usual], self.hash[on[usual]]))]
        h, c, d = self.hash[on[order]], own[order], self.doc[text[order]]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(order) else np.empty(0, bool)
        self.entry_first = np.flatnonzero(new)
        self.entry = h[new], order[new], d[new]  # anchor, an occurrence that has it, smallest document
        self.order, self.entry_of = order, np.cumsum(new) - 1
        # Strings of crowded anchors, in the order of their hashes.
        many = np.flatnonzero(crowd)
        starts = [np.arange(a - lt, a + r - LENGTH + 1) for a, lt, r in zip(at[many].tolist(), left[many].tolist(), right[many].tolist())]
        sizes = np.array([len(s) for s in starts], np.int64)
        starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(blob[s : s + LENGTH]) for s in starts.tolist()), np.uint64).reshape(-1, 2)
        docs = np.repeat(self.doc[text[many]], sizes)
        order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
        new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1)) if len(order) else np.empty(0, bool)
        self.strings = keys[order][new], docs[order][new]
        self.string_at, self.string_doc, self.string_of = starts[order], docs[order], np.cumsum(new) - 1

    def context_rows(self) -> np.ndarray:
        """One row of WIDTH bytes for each distinct context, the anchor at REACH, zeros outside the text."""
        _, at, left, right = self.occurs
        pick = self.entry[1]
        span = np.arange(-REACH, GRAM + REACH)
        rows = np.zeros((len(pick), WIDTH), np.uint8)
        for k in range(0, len(pick), 50_000):
            p = pick[k : k + 50_000]
            inside = (span >= -left[p, None]) & (span < right[p, None])
            rows[k : k + 50_000] = np.where(inside, self.raw[np.clip(at[p, None] + span, 0, len(self.raw) - 1)], 0)
        return rows

    def covered(self, masks: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Bytes that go: ``masks`` of the strings of each distinct context, ``bits`` of the crowded anchors' strings."""
        _, at, left, right = self.occurs
        text = self.text[self.occurs[0]]
        starts, stops = [], []
        if len(self.order):
            o = self.order
            later = self.doc[text[o]] > self.entry[2][self.entry_of]  # not the context's smallest document
            mask = np.where(later, (1 << WINDOW) - 1, masks[self.entry_of]) & ((1 << (left + right - LENGTH + 1)[o]) - 1)
            begin = at[o] - left[o]
            for runs, out, more in ((mask & ~(mask << 1), starts, 0), (mask & ~(mask >> 1), stops, LENGTH)):
                for k in range(WINDOW):
                    out.append(begin[np.flatnonzero(runs >> k & 1)] + k + more)
        if len(self.string_at):
            gone = (self.string_doc > self.strings[1][self.string_of]) | bits[self.string_of].astype(bool)
            starts.append(self.string_at[gone])
            stops.append(self.string_at[gone] + LENGTH)
        if not starts:
            return np.zeros(len(self.raw), bool)
        change = np.bincount(np.concatenate(starts), minlength=len(self.raw) + 1) - np.bincount(np.concatenate(stops), minlength=len(self.raw) + 1)
        return np.cumsum(change[:-1]) > 0


def _cells(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, for the buckets that have any."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def _squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 3)


def _loosen(cell: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(cell), kind)


def _noted(h: np.ndarray, doc: np.ndarray, spans: np.ndarray) -> bytes:
    """Sorted anchors as their differences, smallest documents and spans, a column after the other."""
    return _squeeze(np.concatenate([np.diff(h, prepend=np.uint64(0)), doc.astype(np.uint64), spans.astype(np.uint64)]))


def _read_notes(cell: bytes) -> np.ndarray:
    """(n, 3): anchor, smallest document, span."""
    notes = _loosen(cell, np.uint64).reshape(3, -1).T.copy()
    notes[:, 0] = np.cumsum(notes[:, 0], dtype=np.uint64)
    return notes


def _table(rows: list[tuple], names: str) -> pa.Table:
    fields = [x.split() for x in names.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


ASKED = "bucket long, g long, kind int, keys binary, more binary"
TOLD = "g long, bucket long, kind int, answer binary"


def _ask_anchors(bits: int):
    def run(g: int, packs: list[bytes]) -> pa.Table:
        group = _Group(packs)
        short = np.ascontiguousarray((group.keys >> np.uint64(16 - bits)).view(np.uint8).reshape(-1, 8)[:, :6])  # the bucket's bits are known
        note = (np.minimum(group.times, 127) | group.several().astype(np.int64) << 7).astype(np.uint8)
        return _table([(b, g, 0, short[x:y].tobytes(), _squeeze(note[x:y])) for b, x, y in _cells(group.keys, bits)], ASKED)

    return run


def _answer_anchors(max_contexts: int):
    def run(table: pa.Table) -> pa.Table:
        """0: one document has the anchor; 1: several; 2: so many that its strings are sent one by one."""
        rows = list(zip(*[table.column(c).to_pylist() for c in ("g", "bucket", "keys", "more")]))
        sizes = [len(r[2]) // 6 for r in rows]
        cells = np.zeros((sum(sizes), 8), np.uint8)
        cells[:, :6] = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, 6)
        unique, which, groups = np.unique(cells.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        note = np.concatenate([_loosen(r[3], np.uint8) for r in rows]).astype(np.int64)
        several = np.bincount(which, weights=note >> 7, minlength=len(unique)) > 0
        times = np.bincount(which, weights=note & 127, minlength=len(unique))
        code = np.where((groups > 1) | several, np.where(times > max_contexts, 2, 1), 0).astype(np.uint8)[which]
        return _table([(r[0], r[1], 0, _squeeze(part)) for r, part in zip(rows, np.split(code, np.cumsum(sizes)[:-1]))], TOLD)

    return run


def _coded(packs: pa.Table, codes: list[tuple]) -> _Group:
    group = _Group(packs.column("pack").to_pylist())
    parts = [_loosen(a, np.uint8) for _, a in sorted(codes)]
    group.contexts(np.concatenate(parts) if parts else np.empty(0, np.uint8))
    return group


def _answered(told: pa.Table, kind: int) -> list[tuple]:
    return [(b, a) for b, k, a in zip(*[told.column(c).to_pylist() for c in ("bucket", "kind", "answer")]) if k == kind]


def _ask_contexts(bits: int):
    def run(key, packs: pa.Table, told: pa.Table) -> pa.Table:
        if not packs.num_rows:
            return _table([], ASKED)
        g = packs.column("g")[0].as_py()
        group = _coded(packs, _answered(told, 0))
        h, pick, doc = group.entry
        _, _, left, right = group.occurs
        spans = left[pick] | right[pick] << 8
        context = group.context_rows()
        rows = [(b, g, 1, _squeeze(context[x:y]), _noted(h[x:y], doc[x:y], spans[x:y])) for b, x, y in _cells(h, bits)]
        keys, docs = group.strings
        rows += [(b, g, 2, keys[x:y].tobytes(), docs[x:y].tobytes()) for b, x, y in _cells(keys[:, 0], bits)]
        return _table(rows, ASKED)

    return run


def smallest_documents(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For distinct contexts, a (contexts, WINDOW) array: the smallest document with each string, by suffix arrays.

    The contexts of one anchor lie side by side in ``rows`` and make one text;
    ``last`` marks where it ends.  The anchor, the same in all of them, is one
    symbol there, so a string is WINDOW symbols.
    """
    size = left + 1 + right - GRAM
    ends = np.cumsum(size + 1)  # a zero after each context, below every other symbol
    begins = ends - size - 1
    flat = np.zeros(ends[-1], np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    owner = np.repeat(np.arange(len(rows)), size)
    beside = inner - left[owner]  # the anchor is at 0
    source = REACH + np.where(beside > 0, beside + GRAM - 1, beside)
    middle = rows[:, REACH : REACH + GRAM]
    name = np.zeros(len(rows), np.int64)
    if (~last[:-1] & (middle[1:] != middle[:-1]).any(axis=1)).any():  # grams of one hash that differ
        name = np.unique(middle, axis=0, return_inverse=True)[1].ravel()
    flat[begins[owner] + inner] = np.where(beside == 0, 257 + name[owner], rows[owner, source].astype(np.int64) + 1)
    string = np.full(len(flat), -1)
    starts = size - WINDOW + 1
    inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    who = np.repeat(np.arange(len(rows)), starts)
    string[np.repeat(begins, starts) + inner] = np.arange(len(who))
    array = suffix_arrays(flat, ends[last])
    array = array[string[array] >= 0]
    found = string[array]
    text = np.cumsum(last)[who[found]] - last[who[found]]
    span, small = np.arange(WINDOW), flat.astype(np.int32)
    new = np.ones(len(array), bool)
    for k in range(1, len(array), 20_000):
        a, b = array[k - 1 : k + 19_999], array[k : k + 20_000]
        new[k : k + 20_000] = (small[a[: len(b), None] + span] != small[b[:, None] + span]).any(axis=1)
    new[1:] |= text[1:] != text[:-1]
    low = np.minimum.reduceat(doc[who[found]], np.flatnonzero(new))
    out = np.full((len(rows), WINDOW), 2**63 - 1)
    out[who[found], inner[found]] = low[np.cumsum(new) - 1]
    return out


def _answer_contexts(table: pa.Table) -> pa.Table:
    rows = list(zip(*[table.column(c).to_pylist() for c in ("g", "bucket", "keys", "more", "kind")]))
    out = []
    strings = [r for r in rows if r[4] == 2]
    if strings:
        keys = np.frombuffer(b"".join(r[2] for r in strings), np.uint64).reshape(-1, 2)
        docs = np.concatenate([np.frombuffer(r[3], np.int64) for r in strings])
        order = np.lexsort((docs, keys[:, 1], keys[:, 0]))
        new = np.append(True, (keys[order][1:] != keys[order][:-1]).any(axis=1))
        smaller = np.empty(len(docs), np.uint8)
        smaller[order] = docs[order[new]][np.cumsum(new) - 1] < docs[order]
        cuts = np.cumsum([len(r[3]) // 8 for r in strings])[:-1]
        out += [(r[0], r[1], 2, _squeeze(part)) for r, part in zip(strings, np.split(smaller, cuts))]
    asked = [r for r in rows if r[4] == 1]
    if asked:
        context = np.concatenate([_loosen(r[2], np.uint8).reshape(-1, WIDTH) for r in asked])
        parts = [_read_notes(r[3]) for r in asked]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        masks = _masks(context, np.concatenate(parts))
        out += [(r[0], r[1], 1, _squeeze(part)) for r, part in zip(asked, np.split(masks.astype(np.uint32), cuts))]
    return _table(out, TOLD)


def _masks(context: np.ndarray, notes: np.ndarray) -> np.ndarray:
    h, doc = notes[:, 0], notes[:, 1].astype(np.int64)
    left, right = (notes[:, 2] & np.uint64(255)).astype(np.int64), (notes[:, 2] >> np.uint64(8)).astype(np.int64)
    blob, digest = context.tobytes(), xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(blob[k : k + WIDTH]) for k in range(0, len(blob), WIDTH)), np.uint64, len(context))
    own ^= notes[:, 2] * BASE
    order = np.lexsort((doc, own, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])])
    first = order[new]  # one row for each distinct context, with its smallest document
    distinct = np.empty(len(h), np.int64)
    distinct[order] = np.cumsum(new) - 1
    low = np.repeat(doc[first][:, None], WINDOW, axis=1)
    # Anchors with several contexts.
    change = np.concatenate([[True], h[first][1:] != h[first][:-1]])
    last = np.append(change[1:], True)
    at = np.flatnonzero(~(change & last))
    if len(at):
        low[at] = smallest_documents(context[first[at]], left[first[at]], right[first[at]], doc[first[at]], last[at])
    mask = np.zeros(len(h), np.int64)
    for k in range(WINDOW):
        mask |= (low[distinct, k] < doc).astype(np.int64) << k
    return mask


def _remove(id_type: pa.DataType):
    def run(key, packs: pa.Table, told: pa.Table) -> pa.Table:
        group = _coded(packs, _answered(told, 0))
        masks = [_loosen(a, np.uint32) for _, a in sorted(_answered(told, 1))]
        bits = [_loosen(a, np.uint8) for _, a in sorted(_answered(told, 2))]
        gone = group.covered(np.concatenate(masks).astype(np.int64) if masks else np.empty(0, np.int64), np.concatenate(bits) if bits else np.empty(0, np.uint8))
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[group.ends] - total[group.begins]
        border = np.zeros(len(gone) + 1, bool)
        border[group.begins] = border[group.ends] = True  # a run ends with its text
        start = np.flatnonzero(gone & (border[:-1] | ~np.append(False, gone[:-1])))
        stop = np.flatnonzero(gone & (border[1:] | ~np.append(gone[1:], False))) + 1
        owner = np.searchsorted(group.ends, start, "right")
        sums = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        spans = pa.StructArray.from_arrays([pa.array(x - group.begins[owner], pa.int64()) for x in (start, stop)], names=["start", "end"])
        size = group.ends - group.begins
        kept = pa.Array.from_buffers(pa.binary(), len(size), [None, sums(size - removed).buffers()[1], pa.py_buffer(group.raw[~gone].tobytes())])
        return pa.table(
            [pa.array(group.ids, id_type), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(sums(np.bincount(owner, minlength=len(size))), spans), kept],
            names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )

    return run


def suffix_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, spans (bytes, end exclusive) and kept (binary: what remains, joined).

    Ids are integers.  A null text is empty.  A row with a null id keeps all of
    its bytes and takes none from others.  Rows with one id do not take from each
    other.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    size = text_bytes(docs)
    anchors_each = grown(size, settings.bucket_anchors, settings.most_anchors)
    bits = max(0, (group_count(size // 13, anchors_each) - 1).bit_length())
    packs = pack(docs.select("doc_id", F.col("text").cast("string").alias("text")), grown(size, settings.group_bytes, settings.most_bytes))
    cogroup = lambda told, f, schema: packs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(f, schema)
    shared = saved(packs.mapInArrow(each_pack(_ask_anchors(bits)), ASKED).groupBy("bucket").applyInArrow(_answer_anchors(settings.max_contexts), TOLD))
    # One plan from here on: both cogroups read one shuffle of the packs.
    found = cogroup(shared, _ask_contexts(bits), ASKED).groupBy("bucket").applyInArrow(_answer_contexts, TOLD)
    id_type = docs.schema["doc_id"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    return cogroup(shared.union(found), _remove(to_arrow_type(id_type)), schema)
