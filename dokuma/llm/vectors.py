"""Vectors in packed blocks: what both vector searches share.

Rows become blocks of a few thousand vectors, one row per block, so that a block of queries meets a block of vectors in
one task with numpy arrays on both sides and no row per (query, vector) pair. A vector takes no part when it is null or
empty or has a null or non-finite component; nor does a row without id. All others must have one length: an inner product
of two lengths is undefined, so a table that mixes them raises, wherever the odd vector lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN, ROW, SPREAD = 8, 64, 24
BLOCK_SCHEMA = "block long, ids binary, vectors binary, extra array<binary>"


def usable(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """(id long, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size(vector) > 0)
    return rows.select(F.col(ident).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & good)


def one_each(queries: DataFrame) -> DataFrame:
    """One vector an id: a query that is there twice is asked once, and of an id's different vectors the smallest is asked."""
    return queries.groupBy("id").agg(F.min("v").alias("v"))


def blocks(rows: DataFrame, size: int, dim: int, build: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """Blocks of at most ``size`` rows of (id, v); build(ids, vectors) gives what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        ids, vectors, held = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal ids, vectors, held, n
            i, v, extra = build(np.concatenate(ids), np.concatenate(vectors))
            ids, vectors, held, n = [], [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([n - 1], pa.int64()), pa.array([i.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([[x.tobytes() for x in extra]], pa.list_(pa.binary()))], ["block", "ids", "vectors", "extra"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, size - held)
                if len(odd := np.flatnonzero(np.diff(part.column(1).offsets.to_numpy()) != dim)):
                    raise ValueError(f"vector {part.column(0)[int(odd[0])]} has {len(part.column(1)[int(odd[0])])} components, others have {dim}")
                lo += part.num_rows
                ids.append(part.column(0).to_numpy())
                vectors.append(part.column(1).flatten().to_numpy().reshape(-1, dim))
                held += part.num_rows
                if held == size:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


def meet(queries: DataFrame, shards: DataFrame, search: Callable, schema: str) -> DataFrame:
    """search(pairs) over every (query block, vector block), dealt over a grid: vector blocks fall into columns of
    ``COLUMN`` (of one each as long as that gives at most ``SPREAD`` columns), query blocks into rows of ``ROW``, and every
    cell is one key of an equi-join. So a task holds some tens of MB whatever the table's size, the number of tasks grows
    with both sides, and a block travels once for every row or column it crosses."""
    columns, rows = shards.count(), queries.count()
    columns, rows = max(min(columns, SPREAD), -(-columns // COLUMN), 1), max(-(-rows // ROW), 1)
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(place(rows).alias("row"), every(columns).alias("column"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("extra").alias("q_extra"))
    right = shards.select(place(columns).alias("column"), every(rows).alias("row"), "block", "ids", "vectors", "extra")
    return left.join(right, ["row", "column"]).select("q_block", "q_ids", "q_vectors", "q_extra", "block", "ids", "vectors", "extra").mapInArrow(search, schema)


def nearest(found: DataFrame, k: int, score: Column) -> DataFrame:
    """The k best of each query's finds, ties to the smaller id. The window's limit is applied before the shuffle too."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def found_batch(query: list[np.ndarray], ids: list[np.ndarray], scores: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    whole = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(whole(query, np.int64), pa.int64()), pa.array(whole(ids, np.int64), pa.int64()), pa.array(whole(scores, kind.to_pandas_dtype()), kind)], ["query_id", "vec_id", "score"])
