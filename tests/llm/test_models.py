"""Language identification, quality and the pipeline."""

import random

import numpy as np
import pytest

from rootspan.llm import language, quality


def spoken(kind, r, n):
    ends = {"xx": ["tion", "ing", "the"], "yy": ["eaux", "oir", "les"]}[kind]
    return " ".join(r.choice("bcdfg") + r.choice("aeiou") + r.choice(ends) for _ in range(n))


def test_language_network(spark, odd):
    r = random.Random(1)
    rows = [(i, spoken(k, r, r.randrange(5, 120)), k) for i in range(60) for k in [("xx", "yy")[i % 2]]]
    network = language.fit([(k, t.encode()[:256]) for _, t, k in rows[:40]])
    found = network.predict([t for _, t, _ in rows[40:]])
    assert np.mean([a == k for (a, _), (_, _, k) in zip(found, rows[40:])]) >= 0.9
    assert network.predict([None, "", "123 !"]) == [("und", 0.0)] * 3 and language.fit([]).predict(["abc"]) == [("und", 0.0)]
    assert language.predict(odd, network).count() == odd.count()


def test_network_tables_equal_the_filters():
    network = language.Network(["a", "b"]).fold()
    x = np.random.default_rng(3).integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    h = []
    for w in language.WIDTHS:
        grams = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
        z = network.p["e"][grams].reshape(5, grams.shape[1], -1) @ network.p[f"w{w}"]
        h.append(z.max(1) + network.p[f"c{w}"])
    s = np.maximum(np.hstack(h), 0) @ network.p["o"] + network.p["b"]
    q = np.exp(s - s.max(1, keepdims=True))
    assert np.allclose(network.windows(x), q / q.sum(1, keepdims=True), atol=1e-4)


def test_quality(spark, odd):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "light"]) for _ in range(60)) + "."
    bad = lambda: "!! ".join(r.choice(["BUY", "NOW$$$", "***", "WIN"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", f"s{i % 3}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(40)] + [(None, 1), (900, 0), (2, None)], "doc_id long, quality int")
    judged, name = quality.judge(docs, labels)
    assert {(r["doc_id"], r[name["posterior"]] >= 0.5) for r in judged.collect()} == {(i, i % 4 != 0) for i in range(80)}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 60
    out, _ = quality.judge(odd.withColumnRenamed("key", "evidence"), labels)
    assert out.count() == odd.count() and quality.judge(odd.limit(0), labels.limit(0))[0].count() == 0


def shares(model, rows):
    """Posteriors as the docstring has them, in numpy: rows are (host, path, text)."""
    e = [model.evidence(t) for _, _, t in rows]
    cells = {}
    for (h, p, _), x in zip(rows, e):
        if x > quality.NOTHING:
            cells.setdefault((h, p), []).append(1 / (1 + np.exp(-x)))
    hosts = {}
    for (h, _), s in cells.items():
        hosts.setdefault(h, []).extend(s)

    def strength(groups):
        n, s = np.array([len(g) for g in groups], float), np.array([sum(g) for g in groups])
        mean = s.sum() / n.sum()
        between = (s * s / n).sum() - n.sum() * mean**2
        spread = n.sum() - (n * n).sum() / n.sum()
        tau = max(0.0, (between - (len(n) - 1) * mean * (1 - mean)) / spread) if spread > 0 else 0.0
        return mean, max(1.0, mean * (1 - mean) / tau - 1) if tau else np.inf

    mean, kh = strength(list(hosts.values()))
    _, kp = strength(list(cells.values()))
    shrunk = lambda g, parent, k: parent if np.isinf(k) else (sum(g) + k * parent) / (len(g) + k)
    logit = lambda p: np.log(max(p, 1e-6) / max(1 - p, 1e-6))
    out = []
    for (h, p, _), x in zip(rows, e):
        own = shrunk(cells[h, p], shrunk(hosts[h], mean, kh), kp) if (h, p) in cells else None
        out.append(1 / (1 + np.exp(-(x + (logit(own) - logit(mean) if own is not None and x > quality.NOTHING else 0)))))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_quality_posteriors_equal_numpy(spark, spread):
    r = random.Random(3)
    good = lambda: " ".join(r.choice(["river", "stone", "walks", "under", "light", "9"]) for _ in range(r.randrange(8, 60))) + "."
    bad = lambda: "! ".join(r.choice(["BUY", "now", "***", "win", "river"]) for _ in range(r.randrange(8, 60)))
    rows = []
    for i in range(300):
        host, path = r.choice(["a", "b", "c", "d", None]), r.choice(["x", "y", None])
        text = None if i % 50 == 0 else (good if r.random() < 0.5 + spread * (1 if host in ("a", "b") else -1) else bad)()
        rows.append((i, text, path, host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("." in (t or ""))) for i, t, _, _ in rows[:100]], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x["doc_id"]: x["posterior"] for x in quality.judge(docs, labels)[0].collect()}
    want = shares(model, [(s, lang, t) for _, t, lang, s in rows])
    assert np.allclose([got[i] for i in range(300)], want, atol=1e-9)


def test_learning_takes_only_the_rows_picked(spark):
    """Other rows of a picked id, of another language or none, are not learned from; whole texts are."""
    long = "abcd " * 400
    rows = [(1, long, "xx"), (1, "never", None), (1, "other words", "yy"), (1, "zzz", "xx"), (None, "no id", "xx"), (2, "held", "yy"), (3, "", "yy"), (4, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.training_windows(docs, "doc_id", "text", "lang", ~language.F.coalesce(language.F.col("doc_id") == 2, language.F.lit(False)))
    raw = long.encode()
    assert sorted(found) == sorted([("xx", raw[i : i + language.WINDOW]) for i in range(0, len(raw), language.WINDOW)] + [("yy", b"other words")])
    few = language.training_windows(docs, "doc_id", "text", "lang", language.F.lit(True), windows=2)
    assert sum(k == "xx" for k, _ in few) == 2


def test_prediction_weights_windows_by_bytes():
    network = language.Network(["a", "b"]).fold()
    text = "héllo wide world " * 40
    raw = text.encode()
    cut = [raw[i : i + language.WINDOW] for i in range(0, len(raw), language.WINDOW)]
    q = network.windows(np.frombuffer(b"".join(c.ljust(language.WINDOW, b"\0") for c in cut), np.uint8).reshape(len(cut), -1))
    mean = (q * np.array([[len(c)] for c in cut])).sum(0) / len(raw)
    assert network.predict([text])[0] == (["a", "b"][int(mean.argmax())], pytest.approx(float(mean.max())))


def test_few_labels_give_no_evidence():
    assert quality.Model(np.zeros((0, 14)), np.zeros(0, int)).evidence("some words here") == 0.0
    assert quality.Model(np.zeros((0, 14)), np.zeros(0, int)).evidence(" ") == quality.NOTHING
