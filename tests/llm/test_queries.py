"""The opN queries on the smallest tables against plain Python and the libraries."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from rootspan.llm import decontaminate, queries
from tests.llm.test_native import base_spans
from tests.llm.test_similarity import by_force, tiled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, sf=SF):
    found = queries.QUERIES[name](spark, sf).collect()
    out = {r["doc_id"]: r for r in found}
    assert len(out) == len(found)
    return out


def test_op2(spark, docs):
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = rows(spark, "op2_token_output")
    assert set(got) == set(docs)
    for i in sorted(docs):
        ids = np.array([*whole.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op9(spark, docs):
    import tiktoken

    from rootspan.llm.byte_bpe import read_ranks

    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got, sha = rows(spark, "op9_byte_bpe"), lambda b: hashlib.sha256(b).hexdigest()
    assert set(got) == set(docs)
    for i, d in docs.items():
        ids = library.encode_ordinary(d["text"] or "")
        assert tuple(got[i]) == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((d["text"] or "").encode()))


def test_op5(spark, docs):
    want = by_force([(i, d["text"]) for i, d in docs.items()], 3, 85, 100)
    got = rows(spark, "op5_near_dup")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op6(spark, docs):
    got, word = rows(spark, "op6_license_scan"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, d in docs.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")
        ws = word.findall(low)
        places = [(k, label) for p, label in phrases.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        r, at = got[i], [k for k, _ in places]
        labels = {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        mine = r["labels"].split(",") if r["labels"] else []
        assert labels <= set(mine) and mine == sorted(set(mine)) and 0 <= r["score"] <= 1


def test_op7(spark, docs):
    got, right = rows(spark, "op7_language_id"), []
    for i, d in docs.items():
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i]["held_out"] == held and 0 <= got[i]["score"] <= 1
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, d["text"] or "")))
        if held and d["lang"]:
            right.append(got[i]["lang_pred"] == d["lang"])
    assert sum(right) >= 0.9 * len(right)


def test_op8(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table holds no secret
    got, kinds = rows(spark, "op8_secret_scan", sf), ("assign", "access", "hex")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = base_spans(text or "")
        written = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == written
    assert any("random" in r["spans"] for r in got.values())


def test_op4(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in table if r["embedding"] is not None}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    by = {}
    for r in queries.QUERIES["op4_nearest"](spark, SF).collect():
        by.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    ids, hit = np.array(sorted(x)), 0
    m = np.stack([x[i] for i in ids])
    asked = [i for i in x if i % 100 == 0]
    assert set(by) == set(asked)
    for q in asked:
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        want = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
        assert sorted(by[q]) == list(range(1, 11)) and [by[q][k] for k in range(1, 11)] == sorted(by[q].values())
        assert all(abs(s - np.sqrt(((x[i] - x[q]) ** 2).sum())) < 1e-12 for s, i in by[q].values())
        hit += len({i for _, i in want} & {i for _, i in by[q].values()})
    assert hit >= 9 * len(asked)


def test_op1(spark, docs):
    items = {r["item_id"]: decontaminate.words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    short = {i: w for i, d in docs.items() if len(w := decontaminate.words(d["text"])) <= 400}
    for i, w in short.items():
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, item in items.items():
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                share = tiled(w, item, 5) / len(item)
                assert ((i, j) in got) == (share >= 0.5) and abs(got.get((i, j), share) - share) < 1e-9
    assert got
