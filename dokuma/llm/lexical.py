"""Ranked lexical search by windowed bucket scoring.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. The query set is a
table of items; it is asked in blocks of about ``BLOCK_TERMS`` (item, term) pairs, so that the vocabulary a task holds
has a bound whatever the number of items, and every block meets all documents:

1. postings: each document becomes its length and the (term, tf) pairs of the block's vocabulary, written to the shared
   folder; N, L and df are counted from all of them.
2. scoring: every partition of documents is walked in doc_id order by windows of ``WINDOW`` document numbers. A window's
   postings lie term by term; for each item they are scatter-added into an array that fits the cache, a bitset marks the
   slots touched, and only those are harvested into the item's heap and cleared again.
3. the heaps of all partitions are merged, first in groups of partitions, then by item.

A document's score is a sum over its own postings, so documents need not move: no shuffle carries a text or a posting,
and a hot source, repeated rows or one repeated doc_id weigh on no single task.

Nulls and odd rows: a null or termless text counts in neither N nor L. Every row is a document; rows that share a doc_id
are ranked apart. A null doc_id takes part and stands last among equal scores. Rows of one item_id are one item that asks
for the terms of all of them, a null item_id included; an item without terms or matches returns no rows. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: About so many (item, term) pairs are asked in one pass over the documents.
BLOCK_TERMS = 1 << 18
#: Document numbers a window: 16384 scores of 8 bytes stay in a core's cache.
WINDOW = 1 << 14
#: Longer texts are counted piece by piece.
PIECE = 1 << 20
#: Heaps are merged in so many groups of partitions before those of an item meet.
GROUPS = 64

_TERM = frozenset(range(0x30, 0x3A)) | frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
#: UTF-8 bytes: what is in no term becomes a space, A-Z become a-z.
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))


def term_counts(body: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    counts, body, at = Counter(), body.translate(TABLE), 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)  # cut where no term is
        end = len(body) if end < 0 else end
        counts.update(body[at:end].split())
        at = end + 1
    return counts


def item_terms(items: DataFrame, *, ident: str = "item_id", text: str = "text") -> DataFrame:
    """(item long, term binary), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = list(term_counts(body.as_py()))
                ids += [i] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])

    rows = items.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("item"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "item long, term binary").distinct()


def postings(docs: DataFrame, vocabulary: dict[bytes, int], *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, n long, terms array<int>, tfs array<long>) of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, terms, tfs, ends = [], [], [], [], [0]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(body.as_py())
                if not counts:
                    continue
                ids.append(i)
                lengths.append(counts.total())
                asked = [(t, n) for t, n in zip(map(vocabulary.get, counts), counts.values()) if t is not None]
                terms += [t for t, _ in asked]
                tfs += [n for _, n in asked]
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Buckets:
    """The postings of one window, term by term, and the buckets that an item's terms are added into."""

    def __init__(self, size: int = WINDOW):
        self.scores, self.bits = np.zeros(size, np.int64), np.zeros(-(-size // 8), np.uint8)

    def fill(self, slot: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        order = np.argsort(term, kind="stable")
        self.slot, self.part, term = slot[order], part[order], term[order]
        known, first = np.unique(term, return_index=True)
        self.where = dict(zip(known.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)])))

    def harvest(self, terms: list[tuple[int, int]], least: int, k: int) -> tuple[list[int], list[int]]:
        """The (slots, scores) of the k best that reach ``least``, best first, ties by slot; buckets are left clear."""
        for term, w in terms:
            if (run := self.where.get(term)) and w:
                at = self.slot[run[0] : run[1]]
                self.scores[at] += w * self.part[run[0] : run[1]]  # a document has one posting a term
                np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        touched = np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))
        scores = self.scores[touched]
        self.scores[touched] = 0
        self.bits[:] = 0
        keep = np.flatnonzero(scores >= least)
        keep = keep[np.argsort(-scores[keep], kind="stable")[:k]]
        return touched[keep].tolist(), scores[keep].tolist()


def scored(held: DataFrame, items: list[tuple[int | None, list[tuple[int, int]]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Each partition's k best documents of each item: (item_id, doc_id, score, grp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in items]
        window = Buckets()

        def score(parts: list[pa.RecordBatch]) -> None:
            ids = [i for p in parts for i in p.column(0).to_pylist()]
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            term = np.concatenate([p.column(2).flatten().to_numpy() for p in parts])
            tf = np.concatenate([p.column(3).flatten().to_numpy() for p in parts])
            slot = np.repeat(np.arange(len(ids)), sizes)
            m = np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            window.fill(slot, term, 1_000_000_000 * tf // (1000 * tf + 8 * m[slot]))
            for heap, (_, terms) in zip(heaps, items):
                for s, value in zip(*window.harvest(terms, max(heap[0][0], 1) if len(heap) == k else 1, k)):
                    found = (value, ids[s] is not None, -(ids[s] or 0))
                    if len(heap) < k:
                        heapq.heappush(heap, found)
                    elif found > heap[0]:
                        heapq.heapreplace(heap, found)

        parts, room = [], WINDOW
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                parts.append(batch.slice(lo, room))
                lo, room = lo + parts[-1].num_rows, room - parts[-1].num_rows
                if not room:
                    score(parts)
                    parts, room = [], WINDOW
        if parts:
            score(parts)
        rows = [(item, -minus if known else None, value) for heap, (item, _) in zip(heaps, items) for value, known, minus in heap]
        columns = list(zip(*rows)) or [(), (), ()]
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([group] * len(rows), pa.int32())], ["item_id", "doc_id", "score", "grp"])

    return held.sortWithinPartitions(F.asc_nulls_last("doc_id")).mapInArrow(run, "item_id long, doc_id long, score long, grp int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, ident: str = "doc_id", item: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank int, doc_id, score long): each item's k best documents with a score above 0."""
    asked = written(item_terms(items, ident=item, text=text), "item-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for b in range(blocks):  # the stated query set, block by block, against all documents
        own: dict[int | None, list[bytes]] = {}
        vocabulary: dict[bytes, int] = {}
        for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            own.setdefault(r.item, []).append(bytes(r.term))
            vocabulary.setdefault(bytes(r.term), len(vocabulary))
        held = written(postings(docs, vocabulary, ident=ident, text=text), "postings")
        total = held.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's vocabulary
        weights = {t: weight(total.n, df[t]) for t in vocabulary.values() if t in df}
        with_weights = [(i, [(t, weights[t]) for t in map(vocabulary.get, terms) if t in weights]) for i, terms in own.items()]
        part = scored(held, with_weights, total.n, max(total.l, 1), k)
        found = part if found is None else found.union(part)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for by in (["item_id", "grp"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP12_SQL = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), tfs AS (SELECT rid, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY rid, term
), lengths AS (SELECT rid, sum(tf)::BIGINT AS n FROM tfs GROUP BY rid
), whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tfs, whole GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (rid), whole GROUP BY item_id, rid
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
