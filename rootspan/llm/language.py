"""Language identification by a convolutional network over bytes.

The network embeds bytes, applies filters of several widths, takes each filter's maximum over a window of
``WINDOW`` bytes and feeds the maxima to a softmax over the languages it was taught. It is trained here in
numpy (Adam, gradients through the positions of the maxima) on windows of at most ``DOCS`` documents of each
language and ``MOST`` documents in all: of all windows of their whole texts, the ``WINDOWS`` with the smallest hash
for each language (20 times as many in all), also in shortened form. A text is cut into windows from its first byte to
its last; the prediction is the language with the largest mean probability, windows weighted by their bytes.

For prediction the filters are folded into tables over byte pairs, so that a filter's response at a place
is one or two look-ups; windows are processed in batches of ``BATCH`` bytes whatever the texts' lengths.

Plan. Training documents are picked from (id, language) alone, in two ranks: within a language and one of
``SALT`` hashes of the id first, so that a frequent language is ranked by many tasks, among the first of those
then. Their windows are ranked likewise and collected (the bound above), and the network, some 10,000 numbers, is
broadcast. Prediction is one scan without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; null languages and null
ids are not learned from, nor other rows of a picked id; of equal ids and languages the smallest text is learned; ties go to the language that sorts first; if nothing can be learned, every text
is ``und``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootspan.llm.tasks import lean

WINDOW = 256
DOCS = 500
MOST = 20_000
WINDOWS = 3000
SALT = 16
BATCH = 1 << 18
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 8


class Network:
    """Parameters, training and prediction; one language is enough, none makes every text ``und``."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "o": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "b": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"c{w}"] = np.zeros(FILTERS)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        parts, kept = [], []
        for w in WIDTHS:
            grams = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
            z = p["e"][grams].reshape(n, grams.shape[1], w * EMBED) @ p[f"w{w}"]
            at = z.argmax(1)
            parts.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + p[f"c{w}"])
            kept.append(np.take_along_axis(grams, at[:, :, None], 1))  # the bytes under each maximum
        h = np.hstack(parts)
        a = np.maximum(h, 0)
        s = a @ p["o"] + p["b"]
        q = np.exp(s - s.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"o": a.T @ q, "b": q.sum(0), "e": np.zeros_like(p["e"])}
        back = (q @ p["o"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            d, grams = back[:, k * FILTERS : (k + 1) * FILTERS], kept[k]
            seen = p["e"][grams].reshape(n, FILTERS, w * EMBED)
            g[f"w{w}"], g[f"c{w}"] = np.einsum("nf,nfk->kf", d, seen), d.sum(0)
            np.add.at(g["e"], grams.reshape(-1), (d[:, :, None] * p[f"w{w}"].T[None]).reshape(-1, EMBED))
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 128, rate: float = 5e-3, seed: int = 7) -> Network:
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs if len(x) else 0):
            order = r.permutation(len(x))
            for k in range(0, len(x), size):
                some, t = order[k : k + size], t + 1
                for name, g in self.gradients(x[some], y[some]).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        return self.fold()

    def fold(self) -> Network:
        """Tables of each filter's response to byte pairs and single bytes."""
        e = self.p["e"].astype(np.float32)
        self.tables = []
        for w in WIDTHS:
            single = [e @ self.p[f"w{w}"][o * EMBED : (o + 1) * EMBED].astype(np.float32) for o in range(w)]  # (256, filters)
            steps = [(o, np.ascontiguousarray((single[o][:, None] + single[o + 1][None]).reshape(65536, FILTERS).T)) for o in range(0, w - 1, 2)]
            last = np.ascontiguousarray(single[w - 1].T) if w % 2 else None
            self.tables.append((w, steps, last))
        return self

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of WINDOW bytes)."""
        pairs = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
        maxima = []
        for w, steps, last in self.tables:
            n = WINDOW - w + 1
            at = [np.ascontiguousarray(pairs[:, o : o + n]) for o, _ in steps]
            end = np.ascontiguousarray(x[:, w - 1 : w - 1 + n]).astype(np.intp) if last is not None else None
            for f in range(FILTERS):
                z = steps[0][1][f].take(at[0])
                for (_, table), codes in zip(steps[1:], at[1:]):
                    z += table[f].take(codes)
                if end is not None:
                    z += last[f].take(end)
                maxima.append(z.max(1) + self.p[f"c{w}"][f])
        s = np.maximum(np.stack(maxima, 1), 0) @ self.p["o"] + self.p["b"]
        q = np.exp(s - s.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        k = len(self.languages)
        sums, weight = np.zeros((len(texts), k)), np.zeros(len(texts))
        rows, owners, sizes = [], [], []

        def flush() -> None:
            if rows:
                x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)
                own, n = np.array(owners), np.array(sizes, np.float64)
                np.add.at(sums, own, self.windows(x) * n[:, None])
                np.add.at(weight, own, n)
                rows.clear(), owners.clear(), sizes.clear()

        for i, text in enumerate(texts):
            if not k or not text or not any(map(str.isalpha, text)):
                continue
            raw = text.encode()
            for at in range(0, len(raw), WINDOW):
                piece = raw[at : at + WINDOW]
                rows.append(piece.ljust(WINDOW, b"\0"))
                owners.append(i)
                sizes.append(len(piece))
                if len(rows) >= BATCH // WINDOW:
                    flush()
        flush()
        mean = sums / np.maximum(weight, 1)[:, None]
        best = mean.argmax(1) if k else np.zeros(len(texts), int)
        return [(self.languages[b], float(min(mean[i, b], 1.0))) if weight[i] else ("und", 0.0) for i, b in enumerate(best.tolist())]


def _first(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The ``most`` rows of each lang that come first by ``key``, ranked in ``SALT`` parts before they are ranked together; rank in k."""
    parts = rows.withColumn("salt", F.pmod(key, F.lit(SALT)))
    one = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(key, *rows.columns))).where(F.col("k") <= most)
    return one.drop("salt").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(key, *rows.columns))).where(F.col("k") <= most)


def training_windows(docs: DataFrame, id_col: str, text: str, lang: str, allowed: Column, per_lang: int = DOCS, windows: int = WINDOWS, most: int = MOST) -> list[tuple[str, bytes]]:
    """(language, window): ``windows`` at most of each language, from ``per_lang`` documents of each and ``most`` in all."""
    known = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), allowed.alias("ok")).where("ok AND id IS NOT NULL AND lang IS NOT NULL")
    picked = _first(known.select("id", "lang").distinct(), F.xxhash64("id"), per_lang).orderBy("k", "lang").limit(most).select("id", "lang")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, key = (batch.column(2)[i].as_py() or "").encode(), batch.column(0)[i].as_py()
                cut = [raw[at : at + WINDOW] for at in range(0, len(raw), WINDOW)] if raw.strip() else []
                columns = [pa.array([batch.column(1)[i].as_py()] * len(cut), pa.string()), pa.array([key] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "id", "n", "raw"])

    texts = known.select("id", "lang", "text").join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    cut = texts.select("id", "lang", "text").mapInArrow(run, "lang string, id long, n int, raw binary")
    found = _first(cut, F.xxhash64("id", "n"), windows).orderBy("k", "lang", "id", "n").limit(20 * windows)
    return [(r["lang"], bytes(r["raw"])) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["id"], r["n"]))]


def fit(windows: list[tuple[str, bytes]], seed: int = 7) -> Network:
    """A network for the languages of ``windows``, taught whole windows and shortened ones."""
    languages = sorted({lang for lang, _ in windows})
    of, r, rows, y = {x: i for i, x in enumerate(languages)}, np.random.default_rng(seed), [], []
    for lang, raw in windows:
        short = int(r.integers(8, 96))
        for piece in (raw, raw[:short]) if len(raw) > short else (raw,):
            rows.append(piece.ljust(WINDOW, b"\0"))
            y.append(of[lang])
    x = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW)
    return Network(languages, seed).train(x, np.array(y, np.int64))


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    network = fit(training_windows(docs, "doc_id", "text", "lang", ~held_out))
    return predict(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
