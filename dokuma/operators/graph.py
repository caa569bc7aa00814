"""Citation graphs: degrees, neighbours, induced subgraphs, PageRank, personalised PageRank, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A query's subgraph of at most so many rows (candidates, seeds, links) is ranked in one task.
LOCAL_LINKS = 200_000
#: Links of one source beyond so many are dealt in parts.
HUB_LINKS = 100_000


def _fresh(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="dokuma-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/dokuma/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one in spark.checkpoint.dir, deleted when the application ends. Where the setting lacks, a local
    folder serves if all of Spark runs here; on a cluster that is an error."""
    path = _fresh(spark, name)
    made, files = _files(spark, path)
    files.mkdirs(made)
    files.deleteOnExit(made)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to a path as ``scratch`` gives and read back, so that loops keep short plans and survive executors."""
    spark, path = df.sparkSession, _fresh(df.sparkSession, name)
    df.write.parquet(path)
    made, files = _files(spark, path)
    files.deleteOnExit(made)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``saved`` that nothing reads any more."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            folder, files = _files(df.sparkSession, f.rsplit("/", 1)[0])
            if folder.getParent().getName() == "dokuma":
                files.delete(folder, True)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, in_degree, out_degree); parallel edges count, documents without edges have 0."""
    both = edges.select(F.col("dst").alias("doc_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("doc_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = both.groupBy("doc_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return nodes.join(sums, "doc_id", "left").select("doc_id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def neighbours(seeds: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, doc_id): documents within ``hops`` undirected steps of a query's seeds, seeds excluded."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct()
    start = seeds.select("query_id", "doc_id").distinct()
    reached = front = start
    for _ in range(hops):
        front = front.join(both, front.doc_id == both.src).select("query_id", F.col("dst").alias("doc_id")).distinct()
        front = front.join(reached, ["query_id", "doc_id"], "left_anti")
        reached = reached.union(front)
    return reached.join(start, ["query_id", "doc_id"], "left_anti")


def induced(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, src, dst): distinct edges with both ends among a query's candidates."""
    ends = candidates.select("query_id", "doc_id").distinct()
    touching = edges.select("src", "dst").distinct().join(ends.withColumnRenamed("doc_id", "src"), "src")
    return touching.join(ends.withColumnRenamed("doc_id", "dst"), ["query_id", "dst"], "left_semi").select("query_id", "src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, *, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, weight: Column | None = None, normalise: bool = True, every: int = 5, hub: int = HUB_LINKS) -> DataFrame:
    """(doc_id, score) over distinct edges; dangling mass goes to all nodes alike. Stops when the sum of changes is below
    n * tolerance (None: after ``iterations``). With no edge every score is 1 / n; otherwise the largest becomes 1. The
    links are dealt once and held so; a round moves scores only. A source of more than ``hub`` links is dealt in parts."""
    base = nodes.select("doc_id").distinct()
    n = base.count()
    pairs = edges.groupBy("src", "dst").agg(F.max(weight if weight is not None else F.lit(1.0)).alias("w"))
    total = pairs.groupBy("src").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / hub).cast("int").alias("parts")).where("total > 0")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    written = saved(pairs.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share"), part.alias("part"), "parts"), "links")
    if written.isEmpty():
        return base.withColumn("score", F.lit(1.0 / max(n, 1)))
    links = written.drop("parts").repartition("src", "part").persist()
    out = written.select(F.col("src").alias("doc_id"), "parts").distinct()
    now = saved(base.join(out, "doc_id", "left").select("doc_id", F.col("parts").isNull().alias("dangling"), F.coalesce("parts", F.lit(1)).alias("parts"), F.lit(1.0 / n).alias("score")), "nodes")
    held = now
    for i in range(1, iterations + 1):
        dealt = now.where(~F.col("dangling")).select("doc_id", "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        sums = dealt.join(links, (dealt.doc_id == links.src) & (dealt["part"] == links["part"])).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        lost = now.agg(F.sum(F.when(F.col("dangling"), F.col("score")).otherwise(0.0)).alias("lost"))
        after = now.join(sums, now.doc_id == sums.dst, "left").join(F.broadcast(lost))
        after = after.select("doc_id", "dangling", "parts", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"), F.col("score").alias("was"))
        if i % every == 0 or tolerance is not None or i == iterations:
            after = saved(after, "ranks")
            discard(held)
            held = after
        if tolerance is not None and after.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] < n * tolerance:
            now = after
            break
        now = after.drop("was")
    links.unpersist()
    out = now.select("doc_id", "score")
    return out.join(F.broadcast(out.agg(F.max("score").alias("top")))).select("doc_id", (F.col("score") / F.col("top")).alias("score")) if normalise else out


def personal_scores(nodes: list, edges: list[tuple], seeds: set, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> dict:
    """Power iteration from equal scores, jumping to the seeds; dangling mass returns to them. No edge, or no convergence:
    the seeds' own shares."""
    index = {x: i for i, x in enumerate(sorted(set(nodes) | seeds))}
    start = np.array([1.0 / len(seeds) if x in seeds else 0.0 for x in index])
    if not edges:
        return dict(zip(index, start))
    src, dst = np.array([index[a] for a, _ in edges]), np.array([index[b] for _, b in edges])
    out = np.bincount(src, minlength=len(index))
    now = np.full(len(index), 1.0 / len(index))
    for _ in range(iterations):
        before = now
        share = np.where(out > 0, before / np.maximum(out, 1), 0)
        now = alpha * (np.bincount(dst, share[src], len(index)) + before[out == 0].sum() * start) + (1 - alpha) * start
        if np.abs(now - before).sum() < len(index) * tolerance:
            return dict(zip(index, now / now.max()))
    return dict(zip(index, start))


def walks(nodes: DataFrame, seeds: DataFrame, links: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(query_id, doc_id, graph): what ``personal_scores`` gives, for all queries at once, as joins over (query_id, doc_id)
    and (query_id, src, dst), so that no task holds a query's subgraph. Every round moves scores along the links; a query
    leaves the rounds when its own changes are small enough. A source of many links is split by the join, and what meets at
    a document is summed before it is shuffled. Rounds join by merges only: tables that are just small enough to broadcast
    would pass through the driver in every one."""
    by = ["query_id", "doc_id"]
    start = seeds.select(*by).distinct()
    shares = start.join(start.groupBy("query_id").agg(F.count("*").alias("s")), "query_id").select(*by, (1.0 / F.col("s")).alias("p"))
    every = nodes.select(*by).union(start).distinct()
    out = links.groupBy("query_id", F.col("src").alias("doc_id")).agg(F.count("*").alias("out"))
    sizes = every.groupBy("query_id").agg(F.count("*").alias("n")).join(links.select("query_id").distinct().withColumn("linked", F.lit(True)), "query_id", "left")
    rows = every.join(sizes, "query_id").join(shares, by, "left").join(out, by, "left").select(*by, "n", F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("p", F.lit(0.0)).alias("p"), "out", (1.0 / F.col("n")).alias("score"))
    first = saved(rows, "walks")
    done = [first.where("not linked").select(*by, F.col("p").alias("graph"))]
    part = F.pmod(F.xxhash64("doc_id"), F.expr(f"n div {LOCAL_LINKS} + 1")).alias("part")
    lost = F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)).alias("lost")

    def told(now: DataFrame, facts: DataFrame) -> DataFrame:
        """Rows of the queries in ``facts``, with what these say; a large query's are dealt in parts."""
        each = facts.withColumn("part", F.explode(F.expr(f"sequence(0L, n div {LOCAL_LINKS})"))).drop("n")
        return now.withColumn("part", part).join(each.hint("merge"), ["query_id", "part"]).drop("part")

    now = first.where("linked")
    facts = now.groupBy("query_id").agg(F.max("n").alias("n"), lost)
    spent = []
    for _ in range(iterations):
        moved = now.where("out is not null").join(links.select("query_id", F.col("src").alias("doc_id"), "dst").hint("merge"), by).groupBy("query_id", "dst").agg(F.sum(F.col("score") / F.col("out")).alias("got")).withColumnRenamed("dst", "doc_id")
        step = alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - alpha) * F.col("p")
        after = saved(told(now, facts).join(moved.hint("merge"), by, "left").select(*by, "n", "p", "out", step.alias("score"), F.col("score").alias("was")), "walks")
        small = (F.sum(F.abs(F.col("score") - F.col("was"))) < F.max("n") * tolerance).alias("still")
        change = saved(after.groupBy("query_id").agg(F.max("n").alias("n"), small, F.max("score").alias("top"), lost), "changes")
        discard(*spent)  # what the round before left
        spent = [after, change]
        if not change.where("still").isEmpty():
            done.append(saved(told(after, change.where("still").select("query_id", "n", "top")).select(*by, (F.col("score") / F.col("top")).alias("graph")), "walked"))
        now, facts = after.drop("was"), change.where("not still").select("query_id", "n", "lost")
        if facts.isEmpty():
            discard(*spent)
            break
    else:
        done.append(told(now, facts).select(*by, F.col("p").alias("graph")))
    return reduce(DataFrame.union, done)


def personal_pagerank(candidates: DataFrame, seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, local: int = LOCAL_LINKS) -> DataFrame:
    """(query_id, doc_id, graph): PageRank from each query's seeds on the subgraph of its candidates. Queries whose
    candidates and links are at most ``local`` are computed whole, many a task; the others by ``walks``."""
    sub = saved(induced(candidates, edges), "subgraph")
    empty = F.lit(None).cast(candidates.schema["doc_id"].dataType)
    rows = candidates.select("query_id", F.col("doc_id").alias("a"), empty.alias("b"), F.lit(0).alias("kind"))
    rows = saved(rows.unionAll(seeds.select("query_id", "doc_id", empty, F.lit(1))).distinct().unionAll(sub.select("query_id", "src", "dst", F.lit(2))), "subgraph")
    large = rows.groupBy("query_id").count().where(F.col("count") > local).select("query_id")

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        links = sorted(set(zip(pdf.a[pdf.kind == 2], pdf.b[pdf.kind == 2])))
        got = personal_scores(pdf.a[pdf.kind == 0].tolist(), links, set(pdf.a[pdf.kind == 1]), alpha)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "doc_id": list(got), "graph": list(got.values())})

    kind = candidates.schema["doc_id"].dataType.simpleString()
    schema = f"query_id {candidates.schema['query_id'].dataType.simpleString()}, doc_id {kind}, graph double"
    if large.isEmpty():
        return rows.groupBy("query_id").applyInPandas(rank, schema)
    whole = rows.join(large, "query_id", "left_anti").groupBy("query_id").applyInPandas(rank, schema)
    wide = rows.join(large, "query_id", "left_semi")
    node = lambda kind: wide.where(F.col("kind") == kind).select("query_id", F.col("a").alias("doc_id"))
    return whole.union(walks(node(0), node(1), wide.where("kind = 2").select("query_id", F.col("a").alias("src"), F.col("b").alias("dst")), alpha))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(doc_id, component): the smallest document reachable, by smallest-label steps with a pointer jump a round."""
    both = saved(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct(), "both")
    now = saved(nodes.select("doc_id", F.col("doc_id").alias("component")), "labels")
    for _ in range(rounds):
        low = both.join(now, both.src == now.doc_id).groupBy("dst").agg(F.min("component").alias("low"))
        step = now.join(low, now.doc_id == low.dst, "left").select("doc_id", "component", F.least("component", F.coalesce("low", "component")).alias("next"))
        jump = now.select(F.col("doc_id").alias("next"), F.col("component").alias("further"))
        after = saved(step.join(jump, "next").select("doc_id", "component", F.least("next", "further").alias("next")), "labels")
        moved = after.where("component <> next").limit(1).count()
        discard(now)
        now = after.select("doc_id", F.col("next").alias("component"))
        if not moved:
            return now
    raise RuntimeError("components did not converge")
