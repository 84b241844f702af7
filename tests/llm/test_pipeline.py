"""run() against the five stages done plainly on a small corpus."""

import hashlib
import random
from collections import Counter

import public_tokenizers

import corpus_pipeline
from rootspan.llm import byte_bpe, decontaminate, lines
from tests.llm.test_similarity import by_force, edited, tiled


def corpus():
    r = random.Random(5)
    words = lambda n: [r.choice("bcdfgh") + r.choice("aeiou") + r.choice(["n", "st", "re", "ll"]) + str(r.choice("xyz")) for _ in range(n)]
    item = " ".join(words(30))
    rows = []
    for i in range(70):  # some 38 pages a site: a line on two of them is below the ratio of boilerplate
        body = words(70)
        if i % 10 == 3:
            body[20:20] = item.split()
        rows.append((i, f"{'Share this page' if i % 4 == 0 else 'line ' + str(i)}\n{' '.join(body)}.", "en", f"s{i % 2}", True))
    for i in range(70, 76):
        base = rows[i - 70][1].split("\n")
        rows.append((i, f"{base[0]}\n{edited(base[1].split(), r, i % 3)}", "en", f"s{i % 2}", True))
    rows += [(i, "$$$ ".join(["BUY!!", "NOW***", "|WIN|"] * 25), "en", "s0", False) for i in range(76, 88)]
    return rows + [(88, None, "en", "s1", False)], item


def plainly(rows, item):
    docs = {i: (s, t) for i, t, _, s, good in rows if good}
    pages, seen = Counter(s for s, _ in docs.values()), Counter()
    for s, t in docs.values():
        seen.update({(s, x.strip(" \t\r")) for x in t.split("\n") if x.strip(" \t\r")})
    often = {k for k, n in seen.items() if n >= lines.MIN_PAGES and n > lines.RATIO * pages[k[0]]}
    clean = {i: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in often) for i, (s, t) in docs.items()}
    top = by_force(list(clean.items()), 5, 80, 100)
    clean = {i: t for i, t in clean.items() if top[i][1] == i}
    own = decontaminate.words(item)
    return {i: t for i, t in clean.items() if tiled(decontaminate.words(t), own, decontaminate.LEAST) < decontaminate.THRESHOLD * len(own)}


def test_pipeline(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(good), 0) for i, *_, good in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plainly(rows, item)
    assert 50 < len(want) < 70 and all("Share" not in t for t in want.values())
    library = byte_bpe.word_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r["doc_id"]: (r["ids"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}
