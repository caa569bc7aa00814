"""Shared helpers: scratch tables in the cluster's shared folder, row keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders made by ``written`` and not deleted yet, in order.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new local one is set for the session if all of Spark
    runs on this machine (tests); on a cluster executors could not share it, so there it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="dokuma-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/dokuma/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back. The folder goes when the
    application ends, or earlier by ``drop_scratch`` or ``drop_since``."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.append(path)
    folder, fs = _folder(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` once nothing reads them any more."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def scratch_so_far() -> int:
    return len(_MADE)


def drop_since(spark: SparkSession, before: int, keep: int = 1) -> None:
    """Delete all but the last ``keep`` of the tables written after ``before`` of them were there: what a step wrote on the
    way to its result, once that is written."""
    for path in _MADE[before : len(_MADE) - keep]:
        _delete(spark, path)


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def text_key(text: str = "text") -> Column:
    """128-bit key of a text's content; equal texts share it."""
    return F.unhex(F.md5(text_bytes(text)))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64-bit key of (doc_id, text): copies under other ids get other keys, so that a text that a third of all rows
    share still spreads. Users compare contents afterwards, so a collision costs time only."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), F.coalesce(F.col(text), F.lit("")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for every node that has an edge to another one,
    root being the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder. Both steps aggregate
    min() by node before joining, so a node with very many edges is combined map-side; the joins are plain equi-joins
    whose skewed side AQE can split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "edges")
        drop_scratch(now)
        now = after
    else:
        raise RuntimeError("components did not converge")
    return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class Ragged:
    """Pieces of numbers one behind the other, taken by their index."""

    def __init__(self, kind: str):
        self.flat, self.start, self.count, self.used = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[self.count + 1 : self.count + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.count, self.used = self.count + len(lengths), self.used + len(flat)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the pieces one behind the other, where each ends)."""
        first = self.start[index]
        lengths = self.start[index + 1] - first
        ends = np.cumsum(lengths)
        at = np.repeat(first - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], ends


def places(known: dict, keys: list, learn, room: int, forget) -> np.ndarray:
    """Where each key is, with one look-up for those that are known. learn(set) makes keys known; forget() empties when
    more than ``room`` would be held."""
    at = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
    missing = np.flatnonzero(at < 0)
    if len(missing):
        absent = [keys[i] for i in missing.tolist()]
        new = set(absent)
        if len(known) + len(new) > room:
            known = forget()
            learn({k for k in keys if k not in known})
            return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        learn(new)
        at[missing] = np.fromiter(map(known.__getitem__, absent), np.int64, len(absent))
    return at
