"""Language identification with a byte convolutional network in numpy.

Filters of widths two, three and four slide over the bytes of fixed-length windows, as they are, the
strongest response of each filter in a window is kept, and a softmax layer gives the languages.
A trained filter is linear in its one-hot bytes, so its response is read from tables of byte pairs;
that makes whole texts cheap. A text's score is the mean over all its windows.

The network learns from a bounded sample: at most about ``ROWS_PER_LANG`` labelled rows of each of
the ``MAX_LANGS`` most frequent languages, one window each. Everything else covers all rows.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to
learn from, every text is ``und``; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm._common import map_texts, table

ROWS_PER_LANG = 600
MAX_LANGS = 256
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SYMBOLS = 256
#: Behind the end of a text; no byte of a text that holds a letter has this value but the control character itself.
_PAD = 0
LETTER = re.compile(r"[^\W\d_]")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text as rows of its bytes, unchanged; the last one is padded."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, _PAD, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Filters (width, byte, filter), and the softmax layer above their maxima."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.filters = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray, tables: list | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of each filter, and their places."""
        parts, places = [], []
        for w, f in zip(WIDTHS, self.filters):
            n = x.shape[1] - w + 1
            r = sum(f[j][x[:, j : j + n]] for j in range(w))
            at = r.argmax(1)
            parts.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            places.append(at)
        return np.concatenate(parts, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
        """Adam on the cross entropy; the gradient of a maximum reaches the winning place alone."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                rows = order[k : k + batch]
                xb = x[rows]
                h, places = self.pooled(xb)
                a = np.maximum(h, 0)
                z = a @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (h > 0)
                grads = []
                for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                    g = np.zeros_like(f)
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    cols = np.broadcast_to(np.arange(FILTERS), part.shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(xb, places[i] + j, 1), cols), part)
                    grads.append(g + 1e-4 * f)
                grads += [a.T @ p + 1e-4 * self.out, p.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[list[np.ndarray]]:
        """Responses by filter to every pair of bytes, for each width; width three is a pair and a byte, width four two pairs."""

        def pairs(f: np.ndarray) -> np.ndarray:
            return np.ascontiguousarray((f[0][:, None] + f[1][None]).reshape(-1, FILTERS))

        f2, f3, f4 = self.filters
        return [[pairs(f2)], [pairs(f3[:2]), np.ascontiguousarray(f3[2])], [pairs(f4[:2]), pairs(f4[2:])]]

    def log_odds(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Log probabilities of the languages for each window."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for k in range(0, len(x), 512):
            b = x[k : k + 512].astype(np.int32)
            pair = (b[:, :-1] << 8) | b[:, 1:]
            h = [
                tables[0][0].take(pair, 0).max(1),
                (tables[1][0].take(pair[:, :-1], 0) + tables[1][1].take(b[:, 2:], 0)).max(1),
                (tables[2][0].take(pair[:, :-2], 0) + tables[2][1].take(pair[:, 2:], 0)).max(1),
            ]
            z = np.maximum(np.concatenate(h, 1), 0) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out[k : k + 512] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that nothing may learn from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, seed: int = 7) -> Network | None:
    """A network from a sample of the labelled rows that are not held out; None if there are none."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return None
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, rows_per_lang / r["count"]))).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    start = F.lit(1) + F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1).cast("int")
    sample = usable.where(drawn < share).select("lang", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("part"), "doc_id").collect()
    sample = sorted((r for r in sample if LETTER.search(r["part"])), key=lambda r: (str(r["doc_id"]), r["lang"], r["part"]))
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    x = np.concatenate([windows(r["part"].encode()[:WINDOW]) for r in sample])
    return Network(langs, seed).fit(x, np.array([langs.index(r["lang"]) for r in sample]), seed=seed)


def predictor(network: Network | None) -> Callable[[], Callable[[list[str | None]], tuple[list[str], list[float]]]]:
    """What predicts (language, score) for texts; built once for each worker task."""

    def build():
        tables = network.tables() if network else []

        def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if network and t and LETTER.search(t)]
            if use:
                x = [windows(texts[i].encode("utf-8", "surrogatepass")) for i in use]
                z = network.log_odds(np.concatenate(x), tables)
                sizes = np.array([len(w) for w in x])
                mean = np.add.reduceat(z.astype(np.float64), np.cumsum(sizes) - sizes, 0) / sizes[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, k, s in zip(use, p.argmax(1), p.max(1)):
                    lang[i], score[i] = network.langs[k], float(s)
            return lang, score

        return predict

    return build


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    build = predictor(network)

    def rows():
        predict = build()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = predict(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(rows_in, rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is known with a score of ``least``; their columns are unchanged."""
    build = predictor(network)

    def rows():
        predict = build()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = predict(batch.column("text").to_pylist())
            return batch.filter(pa.array([a != "und" and s >= least for a, s in zip(lang, score)], pa.bool_()))

        return step

    return map_texts(docs, rows, docs.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
