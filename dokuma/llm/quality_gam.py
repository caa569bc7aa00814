"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are numbers from one pass over its bytes and words. Each is cut into quantile bins. Boosting
goes round the features in turn (cyclic): a tree of depth 2 on one feature's bins is fitted to the gradient and its
leaves are added, shrunk, to that feature's look-up table. Then the ``PAIRS`` pairs of features whose coarse grids
explain most of what is left get tables of their own, boosted in the same way. A score is the logistic function of an
intercept plus one table entry a feature and pair, added up for a whole batch with array indexing.

Training uses at most ``SAMPLE`` labelled documents (the least by a hash of their id); their features, not their texts,
come to the driver. Labels, lang, source and doc_id never enter a score. Null text counts as empty and gets a score like
any other; without a single training row (no table has rows, among others) the score is 0.5. A document counts once for
each of its different labels, however often its id is repeated: of several texts the one with the least features. So the
driver gets ``SAMPLE`` rows at most. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id

SAMPLE, BINS, GRID, ROUNDS, RATE, PAIRS = 20_000, 32, 8, 80, 0.15, 6
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "blanks", "stops", "marks", "pipes", "high_bytes",
    "distinct_words", "top_word", "repeated_next", "marked_words", "shouted_words", "distinct_lines", "words_a_line", "byte_entropy", "titled_words",
)
SCHEMA = "doc_id long, score double, predicted int"
_KIND = np.zeros((256, 7), np.float64)
for _b in range(256):
    _c = chr(_b) if _b < 128 else ""
    _KIND[_b] = [_c.isalpha(), _c.isupper(), _c.isdigit(), _c in " \t\r\n" and _c != "", _c in ".,;:?'" and _c != "", _b < 128 and not _c.isalnum() and _c not in " \t\r\n.,;:?'|", _b >= 128]


def features(text: str | None) -> list[float]:
    b = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    n = len(b)
    letters, upper, digits, blanks, stops, marks, high = (counts @ _KIND / max(n, 1)).tolist()
    words = b.split()
    m = len(words)
    seen = Counter(words)
    some = counts[counts > 0] / max(n, 1)
    marked = sum(c for w, c in seen.items() if not (w[-1:].isalnum() or w[-1] in b".,;:?" or w[-1] >= 128))
    shouted = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    titled = sum(c for w, c in seen.items() if w[:1].isupper() and not w.isupper())
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = b.split(b"\n")
    share = 1 / max(m, 1)
    return [
        np.log1p(n), np.log1p(m), n * share, letters, upper, digits, blanks, stops, marks, float(counts[124]) / max(n, 1), high,
        len(seen) * share, max(seen.values(), default=0) * share, again * share, marked * share, shouted * share, len(set(lines)) / len(lines), m / len(lines),
        float(-(some * np.log2(some)).sum()) if n else 0.0, titled * share,
    ]


def tree_of_bins(g: np.ndarray, h: np.ndarray, leaf: float = 1.0, ridge: float = 1.0) -> np.ndarray:
    """The values of a depth-2 tree over ordered bins with gradient sums g and weights h. A leaf holds a weight of
    ``leaf`` at least: four rows of even odds, more of rows that are settled; a larger bound learns nothing from tables of
    a few dozen labels."""

    def split(lo: int, hi: int) -> int | None:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return None
        ga, hb = g[lo:hi].sum(), h[lo:hi].sum()
        gain = np.where((b >= leaf) & (hb - b >= leaf), a**2 / (b + ridge) + (ga - a) ** 2 / (hb - b + ridge), -np.inf)
        k = int(gain.argmax())
        return lo + k + 1 if gain[k] > ga**2 / (hb + ridge) + 1e-12 else None

    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        cut = [(lo, split(lo, hi), hi) for lo, hi in parts]
        parts = [q for lo, k, hi in cut for q in (((lo, k), (k, hi)) if k else ((lo, hi),))]
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


class Additive:
    """edges and tables of each feature; pairs as (feature, feature, table over coarse bins)."""

    def __init__(self):
        self.start, self.edges, self.tables, self.coarse, self.pairs = 0.0, [], [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        b = self.bins(x)
        sizes = [len(e) + 1 for e in self.edges]
        self.tables = [np.zeros(s) for s in sizes]
        self.coarse = [np.arange(s) * min(GRID, s) // s for s in sizes]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.start)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for k, s in enumerate(sizes):
                g, h = gradient()
                step = RATE * tree_of_bins(np.bincount(b[:, k], g, s), np.bincount(b[:, k], h, s))
                self.tables[k] += step
                z += step[b[:, k]]
        g, h = gradient()
        c = np.stack([self.coarse[k][b[:, k]] for k in range(len(sizes))], 1)
        gains = []
        for i in range(len(sizes)):
            for j in range(i):
                cell = c[:, i] * GRID + c[:, j]
                gs, hs = np.bincount(cell, g, GRID * GRID), np.bincount(cell, h, GRID * GRID)
                gains.append((float((gs**2 / (hs + 1)).sum()), i, j))
        chosen = [(i, j, np.zeros(GRID * GRID)) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(ROUNDS // 4):
            for i, j, table in chosen:
                g, h = gradient()
                cell = c[:, i] * GRID + c[:, j]
                gs, hs = np.bincount(cell, g, GRID * GRID).reshape(GRID, GRID), np.bincount(cell, h, GRID * GRID).reshape(GRID, GRID)
                step = np.zeros((GRID, GRID))  # a tree that splits one feature, then the other
                cut = tree_of_bins(gs.sum(1), hs.sum(1))
                for value in np.unique(cut):
                    rows = cut == value
                    step[rows] = tree_of_bins(gs[rows].sum(0), hs[rows].sum(0))
                step = RATE * step.ravel()
                table += step
                z += step[cell]
        self.pairs = chosen
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            z += table[b[:, k]]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][b[:, i]] * GRID + self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-z))


def featured(rows: DataFrame, kept: str, kind: str) -> DataFrame:
    """(kept column, features array) of (kept, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([features(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], [kept, "features"])

    return rows.select(kept, "text").mapInArrow(run, f"{kept} {kind}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, label: str = "quality", sample: int = SAMPLE) -> Additive | None:
    """Train on the labelled documents where ``train`` (over doc_id) holds."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    own = labels.select(labels["doc_id"], labels[label].cast("double").alias("y")).where(train & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    own = own.orderBy(h, "y").limit(sample)  # so many rows at most: small enough to broadcast, 16 bytes each
    known = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select(F.struct(F.col("doc_id").cast("string").alias("doc_id"), "y").alias("of"), "text")
    rows = featured(known, "of", "struct<doc_id:string,y:double>").groupBy("of").agg(F.min("features").alias("features")).collect()
    if not rows:
        return None
    rows = sorted((list(r.features), r.of.y) for r in rows)
    return Additive().fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))


def quality(docs: DataFrame, model: Additive | None, *, least: float = 0.3) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = np.array([features(t) for t in part.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                s = model.score(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op10_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, F.coalesce(crc_of_id() % 5 != 0, F.lit(False)))
    held_out = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    return quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
