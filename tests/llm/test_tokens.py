"""Token files and byte BPE against their libraries, and round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from rootspan.llm import byte_bpe, packing
from rootspan.llm import token_files as tf

WORD, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["Don't STOP’s naïve ÀÉ 12³ \x1cfoo\x85bar\xa0baz", "  lead\n\n\t trail  ", "日本語 テキスト abc<|endoftext|>def", "it's we'll 'tis $5.00 *** a.b_c", "emoji 😀 mixed Text’s é ́x", "ﬁ K​x ΣΑΣ İ", "", "a" * 3000]


def test_rank_coding():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in (0, 1, 3, 4, 9, 18):
        r = np.resize(values, n)
        control, data = tf.encode_ranks(r)
        assert len(control) == -(-n // 4) and len(data) == sum(1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF) for x in r.tolist())
        assert (tf.decode_ranks(control, data, n) == r).all()


def test_packing():
    y = np.r_[np.arange(0, 70_000, 7), 15551, 15552, 15553, 2**26 - 1, 191, 192]
    assert (packing.unpack_ranks(packing.pack_ranks(y)) == y).all() and len(packing.unpack_ranks(packing.pack_ranks(y[:0]))) == 0
    assert (packing.unpack_ints(packing.pack_ints(y)) == y).all()
    assert packing.unpack_blobs(*packing.pack_blobs([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]


def test_encoder_equals_library():
    own = tf.Encoder(WORD, memo=40)
    for t in [*TEXTS, "a1b22 c--d.e 3%%4 \xa0x\x85y²³é·ß", "\x00\x08 a", None]:
        assert own.encode(t) == np.array(own.whole.encode(t or "", add_special_tokens=False).ids, own.kind).tobytes()


def test_files_round_trip(spark, odd, tmp_path):
    tf.write_ids(odd, WORD, str(tmp_path / "f"), end_id=2)
    rows = sorted(tf.read_ids(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    whole, at = tf.Encoder(WORD).whole, 0
    for r, (doc, text) in zip(rows, want, strict=True):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (doc, at, len(ids), ids)
        at += len(ids)


@pytest.mark.parametrize("chunk,piece", [(40, 10), (1 << 20, 30)])
def test_bpe_equals_library(spark, chunk, piece, monkeypatch):
    df = spark.createDataFrame([*enumerate(TEXTS), (None, None)], "doc_id long, text string")
    library = byte_bpe.word_encoder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "PIECE", piece)
    made = byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk_bytes=chunk)
    both = [byte_bpe.decode(made, RANKS), byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, chunk_bytes=chunk)]
    for r in [r for rows in both for r in rows.collect()]:
        text = "" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_bpe_digests_of_odd_inputs(odd):
    library = byte_bpe.word_encoder(RANKS, public_tokenizers.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    got = byte_bpe.digests(byte_bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
