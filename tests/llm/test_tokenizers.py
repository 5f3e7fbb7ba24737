import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from jsonspark.llm.sentencepiece_bpe import PieceCodec, encode_decode
from jsonspark.llm.token_counts import attribute, encoding, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGES = [
    None, "", " ", "   a", "\n", "\t\n x", "▁", "▁▁a ▁", "a" * 500, "ab" * 300, " " * 77, "\x00", "😀 x", "é" * 9, "<s> </s> <0x41> <unk>", "　x", "aaa aa a", "哈哈哈", "\r\n", "x ", "=-" * 50,
    "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def cases(library):
    rng = random.Random(1)
    alphabet = "aabbcd  ▁eéth\n.,-_=1290<>😀漢"
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 31000)]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    made += ["".join(rng.choice("ab=- ") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    return EDGES + made + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)]


@pytest.mark.parametrize("max_cached", [600_000, 50])
def test_codec_is_the_library(library, max_cached):
    codec, texts = PieceCodec(MODEL, max_cached), cases(library)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        for text, ids in zip(part, codec.encode(part)):
            wanted = library.encode(text or "", add_bos=True, add_eos=True)
            assert ids.tolist() == wanted, text
            assert codec.decode(ids) == library.decode(wanted), text


def test_encode_decode_frame(spark, library):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(EDGES)] + [(None, "x", 1), (1, "", 1)], "doc_id long, text string, ids int")
    out = encode_decode(docs, MODEL, chunk_chars=50).collect()
    assert len(out) == len(EDGES) + 2
    for r in out:
        if r["doc_id"] is not None:
            wanted = library.encode(EDGES[r["doc_id"]] or "", add_bos=True, add_eos=True)
            assert hashlib.sha256(r["ids"]).digest() == hashlib.sha256(np.array(wanted, "<u4").tobytes()).digest() and r["decoded"] == library.decode(wanted)
    assert encode_decode(docs.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_attribution_rules(rule):
    rng = random.Random(2)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 6) for _ in range(rng.randint(0, 12))], np.int64)
        total = int(lengths.sum())
        starts = np.array(sorted({0, *(rng.randint(0, total) for _ in range(3))}), np.int64)
        chosen, crossing = attribute(lengths, starts, rule)
        at = 0
        for n, c, x in zip(lengths, chosen, crossing):
            homes = [max(i for i, s in enumerate(starts) if s <= b) for b in range(at, at + n)]
            wanted = {"first": homes[0], "last": homes[-1], "most": max(sorted(set(homes)), key=homes.count)}[rule]
            assert (c, x) == (wanted, len(set(homes)) > 1)
            at += n


def test_token_counts_frame(spark):
    texts = EDGES + ["line one\nline two\n\nlast", "a\n", "\n\n", "é\n漢字 text\r\nmore"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, section int")
    enc, _ = encoding(RANKS, public_tokenizers.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    rows: dict[int, list] = {}
    for r in token_counts(docs, RANKS, public_tokenizers.PATTERN, boundary=r"\n| +", rule="most").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        own = sorted(rows[i], key=lambda r: r["section"])
        assert sum(r["n_tokens"] for r in own) == len(enc.encode_ordinary(t or "")) == own[0]["doc_tokens"]
        assert own[0]["start_char"] == 0 and own[-1]["end_char"] == len(t or "") and all(a["end_char"] == b["start_char"] for a, b in zip(own, own[1:]))
    assert token_counts(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts(docs, RANKS, public_tokenizers.PATTERN, rule="none")
