"""Approximate nearest neighbours with a permutation index.

Pivots are picked from a bounded sample (``SAMPLE`` rows by a hash of their id, then farthest-first), and every vector is
represented by its ``PREFIX`` nearest pivots in order. A block of vectors posts (vector, position) into an inverted file
per pivot. A query reads the files of its own nearest pivots and gets each vector's footrule distance, pivots outside a
prefix counting as position PREFIX; the nearest of each block by footrule, ties at its edge included, are reranked by
inner products in double precision, each summed in one fixed order, so equal vectors score alike. They are a ``SHARE`` of
the block, at least ``DEPTH`` for each result asked for: the same law at every size, and no block is scanned by another way.

Every usable vector is indexed. Null vectors, zero vectors and those with null or non-finite components take no part;
vectors of several lengths raise. Rows with the query's own id are not candidates for it; a table with less than k others
gives fewer rows; an empty table gives none. Ties go to the smaller id. A repeated candidate comes back as often as it is there; a
repeated query is asked once, and of different vectors under one id the smallest is asked. Only the two named columns are read: others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import blocks, found_batch, meet, nearest, one_each, usable

PIVOTS, PREFIX, SAMPLE, SHARE, DEPTH = 256, 64, 2048, 0.2, 8
SHARD, QUERY_BLOCK = 8192, 1024


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first by direction, from the first row on; a vector that fills the sample is picked once."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    picked, near = [0], unit @ unit[0]
    while len(picked) < count:
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        picked.append(k)
        near = np.maximum(near, unit @ unit[k])
    return unit[picked]


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector in order."""
    near = vectors @ pivots.T
    top = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def inverted(prefix: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each pivot's file, vectors, positions), the files one after the other."""
    flat = prefix.ravel()
    order = np.argsort(flat, kind="stable")
    start = np.searchsorted(flat[order], np.arange(pivots + 1)).astype(np.int64)
    return start, (order // prefix.shape[1]).astype(np.int32), (order % prefix.shape[1]).astype(np.int32)


def footrule_gain(prefix: np.ndarray, start: np.ndarray, who: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """What each vector's footrule distance to the query lies below that of one without a common pivot."""
    length = len(prefix)
    gain = np.zeros(n, np.int32)
    for i, p in enumerate(prefix.tolist()):
        a, b = start[p], start[p + 1]
        # |i - at| instead of (length - i) + (length - at)
        gain[who[a:b]] += 2 * length - i - at[a:b] - np.abs(at[a:b] - i)
    return gain


def search(rows: DataFrame, ident: str, vector: str, is_query, k: int = 20, *, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score double): each query's k nearest found by largest inner product."""
    schema = "query_id long, vec_id long, score double"
    good = usable(rows, ident, vector).where(F.exists("v", lambda x: x != 0))
    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # SAMPLE rows at most
    if not sample:
        return nearest(rows.sparkSession.createDataFrame([], schema), k, F.col("score"))
    dim = len(sample[0].v)
    chosen = choose_pivots(np.array([r.v for r in sample if len(r.v) == dim]), pivots)
    length = min(prefix, len(chosen))

    def post(ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        return ids, vectors, [*inverted(prefixes(vectors, chosen, length), len(chosen))]

    def ask(ids: np.ndarray, vectors: np.ndarray):
        return ids, vectors, [prefixes(vectors, chosen, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                _, q_ids, q_vectors, q_extra, _, ids, vectors, extra = (c[r].as_py() for c in batch.columns)
                q_ids, q_vectors, q_prefix = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dim), np.frombuffer(q_extra[0], np.int32).reshape(-1, length)
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim)
                start, who, at = np.frombuffer(extra[0], np.int64), np.frombuffer(extra[1], np.int32), np.frombuffer(extra[2], np.int32)
                n, out = len(ids), ([], [], [])
                most = min(max(int(np.ceil(share * n)), depth * k), n)
                for q_id, q, perm in zip(q_ids.tolist(), q_vectors, q_prefix):
                    gain = footrule_gain(perm, start, who, at, n)
                    gain[ids == q_id] = -1
                    near = np.flatnonzero(gain >= max(np.partition(gain, n - most)[n - most], 0))
                    score = (vectors[near] * q).sum(1)
                    if len(near) > k:
                        keep = score >= np.partition(score, len(near) - k)[len(near) - k]
                        near, score = near[keep], score[keep]
                        best = np.lexsort((ids[near], -score))[:k]
                        near, score = near[best], score[best]
                    out[0].append(np.full(len(near), q_id))
                    out[1].append(ids[near])
                    out[2].append(score)
                yield found_batch(*out, pa.float64())

    index = written(blocks(good, shard, dim, post), "permutations")
    queries = written(blocks(one_each(good.where(is_query(F.col("id")))), QUERY_BLOCK, dim, ask), "permutation-queries")
    found = meet(queries, index, run, schema)
    return nearest(found, k, F.col("score"))


def op3_permutation_index(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, "vec_id", "embedding", lambda i: i % 20 == 0, 20)
