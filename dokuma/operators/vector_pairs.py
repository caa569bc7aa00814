"""All pairs of vectors above a similarity: an exact threshold join by cells and the triangle inequality.

Angles between vectors are a metric. A bounded sample of vectors (pivots) divides all others into cells, each vector to its
nearest pivot. A vector v of cell A meets the members of cell B only where one of them can be within the angle t of the
threshold:

* angle(v, B) <= radius(B) + t, radius being the largest angle between the pivot and a member;
* angle(v, B) - angle(v, A) <= 2 t, since every member of B is nearer to B than to A.

So that every pair is met once, v visits cells of a higher number and its own. A cell's members are dealt to blocks of about
``BLOCK``; every visitor of the cell meets every block in a task of its own, as a stream past the block, so a hot cell becomes
many tasks of bounded memory. How much the bounds save depends on the data: vectors that lie in no clusters meet most cells.

Equal vectors are one class, known by its smallest id: pairs are between classes, and copies are stated by membership, not
as all pairs among them. Vectors without a direction take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dokuma.operators.graph import saved
from dokuma.operators.retrieve import usable

BLOCK, MOST_PIVOTS, SLACK = 1024, 256, 1e-7
#: So many rows of a batch are worked on at once, visits (of a vector to a block) handed over, and components of matches held.
ROWS, VISITS, MATCHED = 1024, 10_000, 1 << 22
DEALT = "cell int, block int, kind int, place int, id long, vector binary"


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, vector) of every different vector, id the smallest with it; (id, member) of all ids with a vector)."""
    rows = vectors.where(usable("vector")).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id IS NOT NULL")
    one = saved(rows.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector"), "classes")
    members = rows.join(one.withColumnRenamed("id", "class"), "vector").select(F.col("class").alias("id"), F.col("id").alias("member")).distinct()
    return one, members


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows and len(flat) % rows:
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1)


def _in_cells(one: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, vector, cell, angles): angles to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch in _slices(batch, ROWS):
                v = _matrix(batch.column(1), batch.num_rows)
                angles = np.arccos(np.clip(v @ pivots.T / np.linalg.norm(v, axis=1, keepdims=True), -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angles.argmin(axis=1).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(pivots)).cast(pa.list_(pa.float64()))], ["id", "vector", "cell", "angles"])

    return one.select("id", "vector").mapInArrow(run, "id long, vector array<double>, cell int, angles array<double>")


def similar(one: DataFrame, threshold: float, *, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs of different vectors (id, vector) with a cosine above ``threshold``."""
    if not -1 < threshold < 1:
        raise ValueError("the threshold must be between -1 and 1")
    n = one.count()
    spark = one.sparkSession
    if not n:
        return spark.createDataFrame([], "a long, b long, similarity double")
    count = pivots or max(1, min(MOST_PIVOTS, math.isqrt(n) // 2))
    sample = np.array([r.vector for r in one.orderBy(F.xxhash64("id"), "id").limit(count).collect()], np.float64)
    cells = saved(_in_cells(one, sample / np.linalg.norm(sample, axis=1, keepdims=True)), "cells")
    facts = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.get("angles", F.col("cell"))).alias("radius")).collect()  # one row a pivot
    blocks, radius = np.zeros(len(sample), np.int64), np.full(len(sample), -np.inf)
    for r in facts:
        blocks[r.cell], radius[r.cell] = -(-r.n // block), r.radius
    reach = math.acos(threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch in _slices(batch, ROWS):
                rows, home, place = np.arange(batch.num_rows), batch.column(2).to_numpy(), batch.column(4).to_numpy()
                v, angles = _matrix(batch.column(1), batch.num_rows), _matrix(batch.column(3), batch.num_rows)
                place = place % blocks[home]
                visits = (angles <= radius[None, :] + reach + SLACK) & (angles - angles[rows, home][:, None] <= 2 * reach + SLACK) & (np.arange(len(blocks))[None, :] > home[:, None])
                at, cell = np.nonzero(visits)
                held = pa.array([x.tobytes() for x in v], pa.binary())
                # (row, cell, blocks, kind): members once, then visitors of all blocks of other cells, of the own up to the own block
                for i, x, c, kind in ((rows, home, None, 0), (rows, home, place + 1, 1), (at, cell, blocks[cell], 2)):
                    for t, blk in _dealt(place if c is None else c, VISITS, c is None):
                        columns = [x[t], blk, np.full(len(t), kind), place[i[t]]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), batch.column(0).take(pa.array(i[t])), held.take(pa.array(i[t]))], [f.split()[0] for f in DEALT.split(", ")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []
        for batch in batches:
            cell, blk, kind, place, ident = (batch.column(i).to_numpy() for i in range(5))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(blk) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if begin == end:
                    continue
                if (cell[begin], blk[begin]) != now:
                    now, ids, held, whole = (cell[begin], blk[begin]), [], [], None
                for lo, hi in ((x, min(x + ROWS, end)) for x in range(begin, end, ROWS)):
                    v = np.frombuffer(b"".join(batch.column(5).slice(lo, hi - lo).to_pylist())).reshape(hi - lo, -1)
                    if kind[lo] == 0:
                        ids.append(ident[lo:hi])
                        held.append(v)
                        continue
                    if whole is None:
                        whole = np.concatenate(held), np.concatenate(ids)
                        lengths = np.sqrt(np.einsum("ij,ij->i", whole[0], whole[0]))
                    own = np.sqrt(np.einsum("ij,ij->i", v, v))
                    every = np.nonzero(v @ whole[0].T > (threshold - 1e-9) * own[:, None] * lengths[None, :])
                    step = max(1, MATCHED // v.shape[1])
                    for i, j in ((every[0][x : x + step], every[1][x : x + step]) for x in range(0, len(every[0]), step)):
                        if kind[lo] == 1:  # of the same block each pair once
                            keep = (place[lo:hi][i] != blk[lo]) | (ident[lo:hi][i] < whole[1][j])
                            i, j = i[keep], j[keep]
                        a, b = ident[lo:hi][i], whole[1][j]
                        first = np.where((a < b)[:, None], v[i], whole[0][j]), np.where((a < b)[:, None], whole[0][j], v[i])  # sums in one order
                        s = np.einsum("ij,ij->i", *first) / (own[i] * lengths[j])
                        keep = s > threshold
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(s[keep])], ["a", "b", "similarity"])

    dealt = cells.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInArrow(deal, DEALT)
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(compare, "a long, b long, similarity double")


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, most) for lo in range(0, batch.num_rows, most))


def _dealt(counts: np.ndarray, most: int, single: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, block) in pieces of ``most``: row i once for each block 0 .. counts[i] - 1, or with ``single`` for counts[i] alone.
    However many blocks there are, no more than a piece is held."""
    if single:
        yield from ((np.arange(lo, min(lo + most, len(counts))), counts[lo : lo + most]) for lo in range(0, len(counts), most))
        return
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        n = np.arange(lo, min(lo + most, int(ends[-1])))
        i = np.searchsorted(ends, n, side="right")
        yield i, n - (ends[i] - counts[i])
