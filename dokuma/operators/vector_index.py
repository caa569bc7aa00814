"""A stored index of vectors by cells: built once, asked often, reading only the cells that a query can need.

The folder holds ``cells`` (the vectors with their other columns, partitioned by cell), ``centroids`` (cell, centroid,
radius: the largest angle between the centroid and a vector of the cell), numbered, of which the last whole one counts. A search ranks the cells of each
query, joins the table to the cells asked for, so that the scan leaves out all other cells' files (dynamic partition
pruning), and passes filters on other columns to the scan.

Two searches: with a fixed number of probed cells, as inverted files are usually asked, whose recall ``probes_for`` measures;
and an exact one, which goes on to every cell that could still hold a better vector: by the triangle inequality for angles
no vector of a cell is nearer to a query than their centroid's angle less the cell's radius.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions.vectors import cosine
from dokuma.operators import retrieve, tables
from dokuma.operators.graph import _files, saved

#: Angles are compared with this much room for rounding.
SLACK = 1e-7
#: A cell is written in one file for every so many vectors of the whole table.
FILE_ROWS = 2_000_000


def _put_cells(rows: DataFrame, path: str) -> None:
    """Add vectors with their cell. The more there are, the more tasks and files a cell gets, so that a hot one is spread."""
    rows = saved(rows, "in-cells")
    parts = 1 + rows.count() // FILE_ROWS
    dealt = rows.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)))
    dealt.sortWithinPartitions("cell", "chunk_id").write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def _put_facts(rows: DataFrame, held: DataFrame, path: str, number: int) -> None:
    """State centroids (cell, centroid) with the radius and number of the rows (cell, vector)."""
    near = rows.join(F.broadcast(held), "cell").groupBy("cell").agg(F.min(cosine(F.col("vector"), F.col("centroid"))).alias("least"), F.count("*").alias("n"))
    facts = held.join(near, "cell").select("cell", "centroid", F.acos(F.least(F.greatest("least", F.lit(-1.0)), F.lit(1.0))).alias("radius"), "n")
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids/{number}")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole statements of centroids."""
    folder, files = _files(spark, f"{path}/centroids/*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()) for f in files.globStatus(folder) or [])


def build(vectors: DataFrame, path: str, *, count: int | None = None, centroids: DataFrame | None = None) -> str:
    """Write the index of (chunk_id, doc_id, vector, ...) to ``path``, where none may be; count: cells, as for
    ``retrieve.fit_centroids``. Vectors without a direction are in no cell."""
    spark = vectors.sparkSession
    if _numbers(spark, path):
        raise ValueError(f"there is an index at {path}")
    fitted = retrieve.fit_centroids(vectors, count) if centroids is None else centroids
    held = spark.createDataFrame(fitted.collect(), fitted.schema)  # at most BROADCAST_ROWS, checked by cells()
    _put_cells(retrieve.cells(vectors, held), path)
    _put_facts(spark.read.parquet(f"{path}/cells"), held, path, 0)
    return path


def ensure(rows: DataFrame, path: str, *, count: int | None = None) -> str:
    """Make the index at ``path`` hold these vectors, each chunk_id once; returns what was done: build (there was none), done,
    resume (chunks that it lacks are added to its cells) or recreate (it holds more than these: all anew). New radii are
    stated before new vectors are added, so a search between the two misses none of the old ones; an index whose first
    statement is not whole is made anew."""
    spark = rows.sparkSession
    good = rows.where(retrieve.usable("vector"))
    plan = "build"
    if numbers := _numbers(spark, path):
        plan = tables.index_plan(good.count(), vectors(spark, path).count())
    if plan in ("build", "recreate"):
        folder, files = _files(spark, path)
        files.delete(folder, True)
        build(rows, path, count=count)
    if plan == "resume":
        old, known = vectors(spark, path), centroids(spark, path)
        held = spark.createDataFrame(known.select("cell", "centroid").collect(), "cell int, centroid array<double>")
        fresh = saved(retrieve.cells(good.join(old.select("chunk_id"), "chunk_id", "left_anti"), held), "fresh-vectors")
        _put_facts(old.select("cell", "vector").unionByName(fresh.select("cell", "vector")), held, path, numbers[-1] + 1)
        _put_cells(fresh.select(*old.columns), path)
    return plan


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cells")


def centroids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/centroids/{_numbers(spark, path)[-1]}")


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int, least: float = 0.95) -> int:
    return retrieve.probes_for(queries, vectors(spark, path), centroids(spark, path), k, least)


def _angles(asked: list, cells: list) -> np.ndarray:
    """Angle of every query to every cell's centroid."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, c = (np.array([r[n] for r in rows], np.float64) for rows, n in ((asked, "query"), (cells, "centroid")))
    return np.arccos(np.clip(unit(q) @ unit(c).T, -1, 1))


def _scan(spark: SparkSession, path: str, asked: list, kind, k: int, take: np.ndarray, numbers: list[int], where: Column | str | None) -> DataFrame:
    """Finds of the cells that ``take`` (query x cell) marks."""
    probed = {numbers[c]: np.flatnonzero(take[:, c]).tolist() for c in np.flatnonzero(take.any(axis=0))}
    rows = vectors(spark, path)
    rows = rows if where is None else rows.where(where)
    wanted = spark.createDataFrame([(c,) for c in probed], "cell int").where("cell >= 0")
    return retrieve.scored_blocks(asked, rows.join(F.broadcast(wanted), "cell", "left_semi"), kind, k, probed)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int | None = None, where: Column | str | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): each query's k nearest chunks among those that ``where`` (on the index'
    columns) keeps. probes: so many cells a query; None: exact. Queries are asked in blocks of at most
    ``retrieve.BROADCAST_ROWS``; those without a direction take no part, of several under one id the smallest counts."""
    cells = centroids(spark, path).orderBy("cell").collect()
    numbers, radius = [c.cell for c in cells], np.array([c.radius for c in cells])
    kept = retrieve.one_each(queries)
    kind, blocks = queries.schema["query_id"].dataType, max(1, -(-kept.count() * 5 // (4 * retrieve.BROADCAST_ROWS)))
    found = None
    for b in range(blocks):
        asked = kept.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not asked:
            continue
        angle = _angles(asked, cells)
        first = min(probes or max(1, math.isqrt(len(cells))), len(cells))
        take = np.zeros(angle.shape, bool)
        np.put_along_axis(take, np.argsort(angle, axis=1, kind="stable")[:, :first], True, axis=1)
        part = retrieve.best(_scan(spark, path, asked, kind, k, take, numbers, where), "query_id", k, F.desc("score"), F.asc("chunk_id"))
        if probes is None:
            part = saved(part, "first-cells")
            kth = {r.query_id: r.score for r in part.where(F.col("rank") == k).select("query_id", "score").collect()}
            reach = np.arccos(np.clip([kth.get(r.query_id, -1.0) for r in asked], -1, 1))
            # A query with fewer than k finds so far goes everywhere.
            rest = (angle - radius[None, :] <= reach[:, None] + SLACK) & ~take
            if rest.any():
                part = part.drop("rank").union(_scan(spark, path, asked, kind, k, rest, numbers, where))
        found = part.drop("rank") if found is None else found.union(part.drop("rank"))
    if found is None:
        return retrieve.best(retrieve.dense_topk(kept.limit(0), vectors(spark, path), k).drop("rank"), "query_id", k, F.desc("score"), F.asc("chunk_id"))
    return retrieve.best(found, "query_id", k, F.desc("score"), F.asc("chunk_id"))
