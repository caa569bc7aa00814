"""Exact top-k by inner product: a ball tree per block of vectors, searched by branch and bound.

Every block of at most ``SHARD`` vectors builds a ball tree (split at the median of the widest spread, leaves of
``LEAF``). For a query q the inner product with anything in a ball of centre c and radius r is at most c.q + r|q|. Nodes
are opened in the order of that bound; a node whose bound lies below the current k-th score is dropped with all that
would follow. The k-th score of a query is carried from block to block of a task, so later blocks start pruned.

Components are floor(1024 * x), whole numbers held as doubles (those beyond a long are the nearest long). Where every sum
of products stays below 2^53 scores are exact in double precision; below 2^63 they are made in 64-bit integers; beyond
that in Python's integers, a score outside a long being the nearest long. Bounds are widened by 1e-9 of the products of
norms behind them, so the result is exact at every magnitude. Ties go to the smaller id.

Null vectors and those with null or non-finite components take no part (zero vectors do); vectors of several lengths
raise. Rows with the query's own id are not candidates for it; a table with less than k others gives fewer rows; an empty
table gives none. A repeated candidate comes back as often as it is there; a repeated query is asked once, and of different
vectors under one id the smallest is asked. Only the two named columns are read: others may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import blocks, found_batch, meet, nearest, one_each, usable

SHARD, QUERY_BLOCK, LEAF = 8192, 512, 96
LEAST_LONG = -(2**63) + 1


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows, nodes as (start, end, left child or -1), centres, radii); the right child follows the left."""
    order, nodes, centres, radii = np.arange(len(vectors)), [(0, len(vectors), -1)], [], []
    k = 0
    while k < len(nodes):
        a, b, _ = nodes[k]
        own = vectors[order[a:b]]
        centre = own.mean(0)
        centres.append(centre)
        radii.append(np.sqrt(((own - centre) ** 2).sum(1).max()))
        if b - a > leaf and radii[-1] > 0:
            far = own[np.argmax(((own - centre) ** 2).sum(1))]
            other = own[np.argmax(((own - far) ** 2).sum(1))]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own @ (other - far), half)]
            nodes[k] = (a, b, len(nodes))
            nodes += [(a, a + half, -1), (a + half, b, -1)]
        k += 1
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def whole_scores(vectors: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products as 64-bit integers; no sum exceeds ``largest``."""
    if largest < 2.0**53:
        return (vectors @ q).astype(np.int64)
    if largest < 2.0**62:
        return vectors.astype(np.int64) @ q.astype(np.int64)
    wide = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object)
    return np.array([min(max(x, LEAST_LONG), 2**63 - 1) for x in (wide(vectors) @ wide(q[None])[0]).tolist()], np.int64)


def search_block(q: np.ndarray, bound: np.ndarray, nodes: list, ids: np.ndarray, vectors: np.ndarray, q_id: int, k: int, floor: int, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """The block's candidates among the k best, given that k scores of at least ``floor`` are known already."""
    open_, got, scores, kth = [(-bound[0], 0)], np.zeros(0, np.int64), np.zeros(0, np.int64), floor if floor > LEAST_LONG else -math.inf
    while open_:
        up, node = heapq.heappop(open_)
        if -up < kth:
            break
        a, b, left = nodes[node]
        if left >= 0:
            heapq.heappush(open_, (-bound[left], left))
            heapq.heappush(open_, (-bound[left + 1], left + 1))
            continue
        score = whole_scores(vectors[a:b], q, largest)
        keep = np.flatnonzero((score >= kth) & (ids[a:b] != q_id))
        if len(keep):
            got, scores = np.concatenate([got, ids[a:b][keep]]), np.concatenate([scores, score[keep]])
            if len(got) > k:
                best = np.lexsort((got, -scores))[:k]
                got, scores = got[best], scores[best]
            if len(got) == k and (least := int(scores.min())) > LEAST_LONG:
                kth = max(kth, least)
    return got, scores


def search(rows: DataFrame, ident: str, vector: str, is_query, k: int = 10, *, scale: int = 1024, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score long): each query's k largest integer inner products."""
    schema = "query_id long, vec_id long, score long"
    good = usable(rows, ident, vector)
    first = good.select(F.size("v").alias("n"), F.xxhash64("id").alias("h")).orderBy("h", "n").first()
    if first is None:
        return nearest(rows.sparkSession.createDataFrame([], schema), k, F.col("score"))
    dim = first.n
    whole = good.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))

    def index(ids: np.ndarray, vectors: np.ndarray):
        order, nodes, centres, radii = build_tree(vectors)
        return ids[order], vectors[order], [nodes, centres, radii, np.linalg.norm(centres, axis=1), np.abs(vectors).max(keepdims=True).ravel()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # query block -> k-th scores so far in this task
        for batch in batches:
            for r in range(batch.num_rows):
                q_block, q_ids, q_vectors, _, _, ids, vectors, extra = (c[r].as_py() for c in batch.columns)
                q_ids, q_vectors = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dim)
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim)
                nodes, centres, radii = np.frombuffer(extra[0], np.int64).reshape(-1, 3).tolist(), np.frombuffer(extra[1]).reshape(-1, dim), np.frombuffer(extra[2])
                norms, lengths = np.frombuffer(extra[3]), np.linalg.norm(q_vectors, axis=1)[:, None]
                bounds = q_vectors @ centres.T + lengths * radii
                bounds += 1e-9 * lengths * (radii + norms) + 1
                largest = float(np.frombuffer(extra[4])[0]) * float(np.abs(q_vectors).max(initial=0)) * dim
                if len(known) > 4096:
                    known.clear()
                floors = known.setdefault(q_block, np.full(len(q_ids), LEAST_LONG))
                out = ([], [], [])
                for j, q_id in enumerate(q_ids.tolist()):
                    got, scores = search_block(q_vectors[j], bounds[j], nodes, ids, vectors, q_id, k, int(floors[j]), largest)
                    if len(got) == k:
                        floors[j] = max(int(floors[j]), int(scores.min()))
                    out[0].append(np.full(len(got), q_id))
                    out[1].append(got)
                    out[2].append(scores)
                yield found_batch(*out, pa.int64())

    trees = written(blocks(whole, shard, dim, index), "ball-trees")
    queries = written(blocks(one_each(whole.where(is_query(F.col("id")))), QUERY_BLOCK, dim, lambda i, v: (i, v, [])), "ball-tree-queries")
    found = meet(queries, trees, run, schema)
    return nearest(found, k, F.col("score"))


def op4_ball_tree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, "vec_id", "embedding", lambda i: i % 100 == 0, 10)


OP4_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
