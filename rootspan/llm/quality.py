"""Quality classifier: document evidence shrunk through site and section posteriors.

Evidence. Shape statistics of the whole text (character classes, word and line repetition, lengths) go
through a logistic model trained here by numpy on at most ``SAMPLE`` labelled documents of each class (the
ones with the smallest hash of their id), which gives each document a log-odds.

Hierarchy. The expected share of good documents is estimated for the corpus, each host and each path
within a host from sums over all documents. A host's mean is shrunk toward the corpus mean, a path's
toward its host's, by as many pseudo-documents as the spread between sites supports (method of moments, one at
least): a site with few documents stays near its parent, and sites that differ by no more than chance would make
them are pooled whole. A document's posterior log-odds are its own plus the
difference between its path's prior and the corpus prior.

Plan. Two scans of the documents and no shuffle of texts: the first gives one row per (host, path) and
task, the second computes the evidence again and joins the priors, a table written to the shared folder
and broadcast only if its files are small; beyond that the join shuffles on (host, path) and AQE splits
skewed sites. A third small read fetches the training sample.

Defined results: null text counts as empty; a text without a word is rejected with log-odds of ``NOTHING``
and takes no part in the sums; null hosts form one site, null paths one path of their host; labels other
than 0 and 1 or without a document are ignored, a repeated one counts once; of an id with several texts the
smallest is learned; with labels of one class only, every document's evidence is 0; other columns pass through
``judge`` untouched, and where one is called like a new one, the new one gets an underscore after its name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootspan.llm.tasks import fresh, lean
from rootspan.scratch import settle

SAMPLE = 4000
NOTHING = -20.0
KEEP = 0.5
_FEATURES = 14


def features(text: str | None) -> np.ndarray | None:
    """Shape statistics of a whole text; None if it has no word."""
    words = text.split() if text else []
    if not words:
        return None
    raw = text.encode()
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n, letters = float(len(raw)), c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    marks = c[44] + c[46] + c[39] + c[45]
    symbols = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - marks
    each = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    run = sum(a == b for a, b in zip(words, words[1:]))
    return np.array([
        np.log1p(len(words)), c[65:91].sum() / max(letters, 1), c[48:58].sum() / n, symbols / n, marks / n, letters / n,
        len(raw) / len(words), len(each) / len(words) ** 0.8, max(each.values()) / len(words), run / len(words),
        len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)), c[124] / n, max(map(len, words)) ** 0.5,
    ])


class Model:
    """Standardised logistic regression; rows without features have no evidence."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2):
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(_FEATURES), np.ones(_FEATURES))
        self.weights, self.base = np.zeros(_FEATURES + 1), 0.0
        if len(set(y.tolist())) < 2:
            return
        z = np.hstack([np.clip((x - self.mean) / self.spread, -8, 8), np.ones((len(x), 1))])
        each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        for _ in range(rounds):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            slope = z.T @ (each * (y - p)) - ridge * self.weights / len(x)
            curve = (z * (each * p * (1 - p))[:, None]).T @ z + (ridge / len(x) + 1e-6) * np.eye(z.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weights += step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-6:
                break

    def evidence(self, text: str | None) -> float:
        f = features(text)
        if f is None:
            return NOTHING
        z = np.clip((f - self.mean) / self.spread, -8, 8)
        return float(np.clip(z @ self.weights[:-1] + self.weights[-1] + self.base, -15, 15))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The document model from at most ``sample`` labelled documents of each class."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionAll(parts[1]))  # 2 * sample rows at most

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(batch.column(1)[i].as_py(), f.tolist()) for i in range(batch.num_rows) if (f := features(batch.column(0)[i].as_py())) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["y", "x"])

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).join(picked, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = texts.select("text", "y").mapInArrow(run, "y int, x array<double>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    model = Model(np.array([r["x"] for r in rows]).reshape(-1, _FEATURES), np.array([r["y"] for r in rows], np.int64))
    if counts.get(0) and counts.get(1):  # classes were balanced for training
        model.base = float(np.log(counts[1] / counts[0]))
    return model


def _with_evidence(docs: DataFrame, model: Model, text: str, to: str) -> DataFrame:
    """``docs`` and each row's log-odds; every other column crosses untouched as Arrow memory."""
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shared.value.evidence(t.as_py()) for t in batch.column(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def _strength(n: str, s: str, of: DataFrame) -> tuple[float, float]:
    """(mean, pseudo-documents) of the shares s / n between groups, by moments; infinite if chance explains the spread."""
    r = of.agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("q"), F.sum(F.col(n) * F.col(n)).alias("n2")).first()
    if not r["n"]:
        return 0.5, 1.0
    mean, k = r["s"] / r["n"], r["k"]
    between = r["q"] - r["n"] * mean * mean
    spread = r["n"] - r["n2"] / r["n"]
    tau = max(0.0, (between - (k - 1) * mean * (1 - mean)) / spread) if spread > 0 else 0.0
    return mean, max(1.0, mean * (1 - mean) / tau - 1) if tau > 0 else float("inf")


def _shrunk(n: str, s: str, parent: Column, k: float) -> Column:
    """The share s / n, drawn toward ``parent`` by k pseudo-documents."""
    own = F.col(n) / (F.col(n) + F.lit(k))
    return own * F.col(s) / F.col(n) + (1 - own) * parent


def priors(docs: DataFrame, model: Model, host: str, path: str, text: str) -> DataFrame:
    """(host, path, p_host, p_path, shift): shrunken shares of good documents of every site and section."""
    seen = _with_evidence(docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"), F.col(f"`{text}`").alias("text")), model, "text", "e")
    sums = seen.where(F.col("e") > NOTHING).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / (1 + F.exp(-F.col("e")))).alias("s"))
    sums = settle(sums, "quality-sums")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    mean, k_host = _strength("hn", "hs", hosts)
    _, k_path = _strength("n", "s", sums)
    hosts = hosts.withColumn("p_host", _shrunk("hn", "hs", F.lit(mean), k_host))
    joined = sums.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
    p = joined.select("a.host", "path", "p_host", _shrunk("n", "s", F.col("p_host"), k_path).alias("p_path"))
    corpus = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    odds = F.log(F.greatest("p_path", F.lit(1e-6)) / F.greatest(1 - F.col("p_path"), F.lit(1e-6)))
    return settle(p.withColumn("shift", odds - corpus), "quality-priors")


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with evidence, p_host, p_path and posterior; and the names those columns got."""
    model = fit(docs, labels, id_col, text, label, sample)
    table = priors(docs, model, host, path, text)
    taken, name = list(docs.columns), {}
    for x in ("evidence", "p_host", "p_path", "posterior", "host", "path", "shift"):
        name[x] = fresh(x, taken)
        taken.append(name[x])
    own = _with_evidence(docs, model, text, name["evidence"])
    table = table.select(*[F.col(c).alias(name[c]) for c in table.columns])
    joined = own.join(table, F.col(f"`{host}`").eqNullSafe(F.col(name["host"])) & F.col(f"`{path}`").eqNullSafe(F.col(name["path"])), "left")
    odds = F.col(name["evidence"]) + F.when(F.col(name["evidence"]) > NOTHING, F.coalesce(name["shift"], F.lit(0.0))).otherwise(0.0)
    out = joined.select(*[F.col(f"`{c}`") for c in own.columns], name["p_host"], name["p_path"], (1 / (1 + F.exp(-odds))).alias(name["posterior"]))
    return out, name


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **columns) -> DataFrame:
    """``docs`` without the rows whose posterior is below ``keep``."""
    judged, name = judge(docs, labels, **columns)
    return judged.where(F.col(name["posterior"]) >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    judged, name = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "source", "lang", name["evidence"], name["p_host"], name["p_path"], name["posterior"], (F.col(name["posterior"]) >= KEEP).alias("kept"))
