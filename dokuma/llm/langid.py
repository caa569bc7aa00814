"""Language identification by a byte convolutional network trained in numpy.

Bytes are folded to 64 classes. Filters of widths 2, 3 and 4 slide over windows of ``WINDOW`` bytes; each filter's
largest response in a window goes through a rectifier into a softmax over the languages. A text is cut into
windows all the way to its end (each with WIDEST - 1 bytes of the next, so that no position is lost), and its prediction
is the softmax of the mean log-odds of its windows, weighted by their lengths.

A filter's response to w classes is a sum of table rows, one for each class; for scoring, rows of neighbours are added
up beforehand, so a position costs one or two look-ups a width instead of w.

Training uses at most ``SAMPLE`` labelled documents for each language (the least by a hash of their id and text), two
windows from each at places given by that hash. Rows are counted by language first, and only those below a threshold on
the hash, about ``SPARE`` times the sample, leave their partitions. ``lang``, ``source`` and ``doc_id`` never enter a prediction.

Results: ``und`` with score 0 for a null text or one without a letter (of any script; digits, fractions and superscripts
are none). Languages are those found in training; with no labelled row at all, an empty table among others, every text is
``und``. Repeated rows score alike and count once in the sample; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, row_key

WINDOW, WIDTHS, FILTERS, CLASSES = 512, (2, 3, 4), 12, 64
WIDEST = max(WIDTHS)
SAMPLE, SPARE, EPOCHS, BATCH, RATE = 500, 4, 14, 64, 0.02
LETTER = re.compile(r"[^\W\d_]")  # and numbers that are no decimal digits
SCHEMA = "doc_id long, lang_pred string, score double"


def byte_classes() -> np.ndarray:
    """0 blank, 1-26 letters of either case, 27 digits, 28 full stop and comma, 29 other ASCII, 30 lead bytes above C5,
    31 lead bytes C2 to C5, 32-63 continuation bytes by their low five bits."""
    out = np.full(256, 29, np.uint8)
    out[[9, 10, 13, 32]] = 0
    for k in range(26):
        out[65 + k] = out[97 + k] = k + 1
    out[48:58], out[[44, 46]] = 27, 28
    out[128:192] = 32 + (np.arange(64) & 31)
    out[192:198], out[198:] = 31, 30
    return out


FOLD = byte_classes()


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: (r.normal(0, 0.3, (w, CLASSES, FILTERS))).astype(np.float32) for w in WIDTHS}
        self.shift = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.tables: dict[int, np.ndarray] = {}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectified maxima, their places) of a batch of windows of classes, by plain filters."""
        tops, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            response = sum(self.filters[w][k][x[:, k : k + n]] for k in range(w))
            at = response.argmax(1)
            tops.append(np.take_along_axis(response, at[:, None], 1)[:, 0] + self.shift[w])
            where.append(at)
        return np.maximum(np.concatenate(tops, 1), 0), np.concatenate(where, 1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        r, step = np.random.default_rng(seed), 0
        params = {"out": self.out, "bias": self.bias} | {f"f{w}": self.filters[w] for w in WIDTHS} | {f"s{w}": self.shift[w] for w in WIDTHS}
        m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                take = order[lo : lo + BATCH]
                own, labels = x[take], y[take]
                h, at = self.pooled(own)
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(take)), labels] -= 1
                p /= len(take)
                back = (p @ self.out.T) * (h > 0)
                grads = {"out": h.T @ p, "bias": p.sum(0)}
                for i, w in enumerate(WIDTHS):
                    g, places = back[:, i * FILTERS : (i + 1) * FILTERS], at[:, i * FILTERS : (i + 1) * FILTERS]
                    grads[f"s{w}"] = g.sum(0)
                    grad = np.zeros_like(self.filters[w])
                    for k in range(w):
                        np.add.at(grad[k], (np.take_along_axis(own, places + k, 1), np.arange(FILTERS)[None, :]), g)
                    grads[f"f{w}"] = grad
                step += 1
                for k, q in params.items():
                    m[k] += 0.1 * (grads[k] - m[k])
                    v[k] += 0.01 * (grads[k] ** 2 - v[k])
                    q -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        self.fold()

    def fold(self) -> None:
        """Look-up tables of pairs of classes: all of width 2, and halves of width 4."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        two, three, four = (self.filters[w] for w in WIDTHS)
        self.tables = {0: pair(two[0], two[1]), 1: pair(three[0], three[1]), 2: three[2].copy(), 3: pair(four[0], four[1]), 4: pair(four[2], four[3])}

    def log_odds(self, text: bytes) -> np.ndarray:
        """The mean over all windows of the text."""
        c = FOLD[np.frombuffer(text, np.uint8)].astype(np.int32)
        if len(c) < WIDEST:
            c = np.concatenate([c, np.zeros(WIDEST - len(c), np.int32)])
        p = c[:-1] * CLASSES + c[1:]
        n = len(c) - WIDEST + 1
        starts = np.arange(0, n, WINDOW)
        t, tops = self.tables, []
        for w, response in ((2, lambda a, z: t[0].take(p[a:z], 0)), (3, lambda a, z: t[1].take(p[a:z], 0) + t[2].take(c[a + 2 : z + 2], 0)), (4, lambda a, z: t[3].take(p[a:z], 0) + t[4].take(p[a + 2 : z + 2], 0))):
            best = [np.maximum.reduceat(response(a, min(a + 64 * WINDOW, n)), np.arange(0, min(64 * WINDOW, n - a), WINDOW), 0) for a in range(0, n, 64 * WINDOW)]
            tops.append(np.concatenate(best) + self.shift[w])
        z = np.maximum(np.concatenate(tops, 1), 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return np.average(np.maximum(z, -30), 0, np.minimum(WINDOW, n - starts))


def windows_of(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), WINDOW), np.int32)
    for k, text in enumerate(texts):
        b = FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass")[:WINDOW], np.uint8)]
        out[k, : len(b)] = b
    return out


def fit(docs: DataFrame, train: Column, *, sample: int = SAMPLE) -> Network | None:
    """Train on rows where ``train`` holds and lang is not null: ``sample`` documents a language at most come to the
    driver, two windows each."""
    from pyspark.sql import Window

    own = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number a language
    if not counts:
        return None
    h = row_key()
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SPARE * sample / n))])
    place = lambda k: F.substring("text", (F.pmod(F.xxhash64(F.lit(k), F.col("h")), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
    low = own.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 31)) < F.element_at(share, F.col("lang")) * (1 << 31))
    once = low.select("lang", "h", F.struct(place(1).alias("a"), place(2).alias("b")).alias("w")).groupBy("lang", "h").agg(F.min("w").alias("w"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 31)), "h")  # some SPARE * sample rows a language
    picked = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("lang", "h", "w.a", "w.b")
    rows = sorted((r.lang, r.h, r.a, r.b) for r in picked.collect())
    languages = sorted({r[0] for r in rows})
    net = Network(languages)
    x = windows_of([t for r in rows for t in (r[2], r[3])])
    y = np.array([languages.index(r[0]) for r in rows for _ in (0, 1)])
    net.train(x, y)
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                langs, scores = [], []
                for text in part.column(1).to_pylist():
                    lang, score = judge(net, text)
                    langs.append(lang)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def has_letter(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def judge(net: Network | None, text: str | None) -> tuple[str, float]:
    if net is None or not has_letter(text):
        return "und", 0.0
    z = net.log_odds(text.encode("utf-8", "surrogatepass"))
    p = np.exp(z - z.max())
    return net.languages[int(p.argmax())], float(p.max() / p.sum())


def identified(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """The input without documents that are ``und`` or whose best language scores below ``least``. Where no language is
    known (no row of the table names one) only texts without a letter go."""
    columns, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                lang, score = judge(net, text)
                good.append(has_letter(text) if net is None else lang != "und" and score >= least)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*columns)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(False))
    net = fit(docs, F.coalesce(crc_of_id() % 3 != 1, F.lit(False)))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
