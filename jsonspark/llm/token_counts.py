"""Token counts of a document's sections by offset-mapped attribution.

A document is encoded once, as a whole, so its count is that of the whole text.
Tokens have byte spans (their lengths add up), which map to character spans; an
interval join by binary search finds the sections of each token's first and last
byte.  A token inside one section counts there.  A token that crosses a boundary
counts once, by rule: ``first`` (the section of its first byte), ``last`` (of its
last byte), or ``most`` (the section with most of its bytes, the earliest on a
tie).  So the sections' counts always add up to the document's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("first", "last", "most")
_encodings: dict[tuple[str, str], tuple] = {}


def encoding(ranks_file: str, pattern: str):
    """The worker's encoder of a rank file, and every token's length in bytes."""
    if (ranks_file, pattern) not in _encodings:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _encodings[ranks_file, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _encodings[ranks_file, pattern]


def attribute(lengths: np.ndarray, starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary): ``lengths`` in bytes, ``starts`` of the sections, from 0, ascending."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = last > first
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    if rule == "most":
        for t in np.flatnonzero(crossing):  # few: a token is short and a boundary must lie inside it
            edges = np.concatenate([[begins[t]], starts[first[t] + 1 : last[t] + 1], [ends[t]]])
            chosen[t] = first[t] + int(np.argmax(np.diff(edges)))
    return chosen, crossing


def token_counts(
    docs: DataFrame, ranks_file: str, pattern: str, boundary: str = r"\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a section: doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing, doc_tokens.

    A section ends after each match of ``boundary`` (an empty one at the end of
    the text is left out).  ``n_crossing`` counts the section's tokens that reach
    over a boundary.  A null or empty text is one empty section without tokens.
    Repeated rows give repeated rows; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    cut = re.compile(boundary)
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names]])

    def sections(enc, sizes: np.ndarray, text: str) -> np.ndarray:
        ends = [m.end() for m in cut.finditer(text) if m.end()]
        edges = np.array([0, *ends, *([len(text)] if not ends or ends[-1] < len(text) else [])], np.int64)
        lengths = sizes[enc.encode_ordinary(text)] if text else np.zeros(0, np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        byte_of = edges if len(raw) == len(text) else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[edges]
        chosen, crossing = attribute(lengths, byte_of[:-1], rule)
        n = len(edges) - 1
        out = np.empty((n, 6), np.int64)
        out[:, 0], out[:, 1], out[:, 2] = np.arange(n), edges[:-1], edges[1:]
        out[:, 3], out[:, 4] = np.bincount(chosen, minlength=n), np.bincount(chosen[crossing], minlength=n)
        out[:, 5] = len(lengths)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoding(ranks_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [sections(enc, sizes, t.as_py() or "") for t in part.column(1)]
                index = np.repeat(np.arange(part.num_rows), [len(m) for m in made])
                all_rows = np.concatenate(made)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(index)), *[pa.array(all_rows[:, k]) for k in range(6)]], ["doc_id", *names])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
