"""Whole searches: the graph search with its fallback, fusions of several indexes, entities of queries, experiments."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.operators import evaluate, extract, graph, retrieve

log = logging.getLogger(__name__)
#: Scores that agree in so many digits behind the point are ties, which the smaller doc_id wins.
TIE_DIGITS = 10
#: Pairs of a query and a document that a task joins or counts.
PAIRS = 1 << 20
NUMBER = r"\b(?:19|20)\d{2}/\d+\b"


def checked_top_k(k: int, most: int = 100) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"top_k must be between 1 and {most}")
    return k


def search(dense: DataFrame, edges: Callable[[], DataFrame] | None, *, use_graph: bool = True, seeds: int = 5, hops: int = 1, weight: float = 0.3, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, graph_score, mode, rank) of ranked documents (query_id, doc_id, score, rank): fused with the
    graph around the first ``seeds`` of each query; where there is no graph, or its edges cannot be read, by the dense
    score alone (mode "dense"), with a warning. The edges are written first, so that a store that fails does so here;
    errors in the ranking itself are not hidden."""
    checked_top_k(k)
    dense = graph.saved(dense, "dense")
    e = None
    if use_graph and edges is None:
        log.warning("no graph; dense scores alone")
    elif use_graph:
        try:
            e = graph.saved(edges().select("src", "dst").distinct(), "edges")
        except PySparkException as failed:
            log.warning("no edges; dense scores alone: %s", str(failed)[:300])
    if e is None:
        found = retrieve.dense_only(dense).withColumn("mode", F.lit("dense"))
    else:
        first = dense.where(F.col("rank") <= seeds).select("query_id", "doc_id")
        candidates = graph.saved(dense.select("query_id", "doc_id").union(graph.neighbours(first, e, hops)).distinct(), "candidates")
        fused = retrieve.fuse_graph(dense, graph.personal_pagerank(candidates, first, e), weight)
        found = fused.select("query_id", "doc_id", "score", "graph_score", F.lit("graph").alias("mode"))
    # Sums of a walk differ in their last bits where documents stand alike in the graph: those are ties.
    return retrieve.best(found, "query_id", k, F.desc(F.round("score", TIE_DIGITS)), F.asc("doc_id"))


def fuse_indexes(*runs: tuple[DataFrame, float]) -> DataFrame:
    """(query_id, doc_id, score): the weighted sum of scores, each index' scores divided by its largest of the query. A
    document that an index lacks counts 0 there."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    scaled = [r.select("query_id", "doc_id", (w * F.when(top > 0, F.col("score") / top).otherwise(0.0)).alias("score")) for r, w in runs]
    return reduce(DataFrame.unionByName, scaled).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def query_entities(queries: DataFrame) -> DataFrame:
    """(query_id, kind, value) of (query_id, text): law articles as CODE_ARTICLE, case and decision numbers."""
    laws = extract.extract_laws(queries.select(F.col("query_id").alias("doc_id"), "text"))
    kind = queries.schema["query_id"].dataType
    law = laws.where("law_code IS NOT NULL").select(F.col("doc_id").cast(kind).alias("query_id"), F.lit("law").alias("kind"), F.concat_ws("_", "law_code", F.col("article").cast("string")).alias("value"))
    number = queries.select("query_id", F.lit("number").alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))).alias("value"))
    return law.unionByName(number).distinct()


def targeted(entities: DataFrame, documents: DataFrame, laws: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits): documents that have a query's numbers (doc_id, case_no, decision_no) or cite its articles
    (doc_id, article_id): equi-joins on the value, counted. A value of many queries and documents is dealt to parts by query,
    and pairs to as many tasks as there are ``PAIRS`` of them, so a task's memory does not grow with them."""
    numbers = documents.select("doc_id", F.explode(F.array_distinct(F.array("case_no", "decision_no"))).alias("value")).select("doc_id", F.lit("number").alias("kind"), "value")
    held = numbers.unionByName(laws.select("doc_id", F.lit("law").alias("kind"), F.col("article_id").alias("value"))).where("value <> ''").distinct()
    by = ["kind", "value"]
    entities, held = graph.saved(entities, "entities"), graph.saved(held, "held")
    sizes = graph.saved(entities.groupBy(*by).agg(F.count("*").alias("q")).join(held.groupBy(*by).agg(F.count("*").alias("d")), by), "sizes")
    n = entities.count() + held.count() + (sizes.agg(F.sum(F.col("q") * F.col("d"))).first()[0] or 0)
    tasks = -(-n // PAIRS) or 1
    parts = sizes.select(*by, F.ceil(F.col("q") * F.col("d") / PAIRS).cast("int").alias("parts")).where("parts > 1")
    many = F.coalesce("parts", F.lit(1))
    asked = entities.join(parts, by, "left").withColumn("part", F.pmod(F.xxhash64("query_id"), many).cast("int"))
    kept = held.join(parts, by, "left").withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
    deal = lambda rows, name: rows.select(*by, "part", name).repartition(tasks, *by, "part")
    pairs = deal(asked, "query_id").join(deal(kept, "doc_id").hint("merge"), [*by, "part"]).select("query_id", "doc_id")
    return pairs.repartition(tasks, "query_id", "doc_id").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))


def feedback_gold(feedback: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade) of (query_id, doc_id, relevant, ts, user): each user's last word counts, a majority of
    users makes 2, a tie 1."""
    last = feedback.groupBy("query_id", "doc_id", "user").agg(F.max(F.struct("ts", "relevant")).alias("x"))
    share = last.groupBy("query_id", "doc_id").agg(F.avg(F.col("x.relevant").cast("int")).alias("share"))
    return share.select("query_id", "doc_id", F.when(F.col("share") > 0.5, 2).when(F.col("share") == 0.5, 1).otherwise(0).alias("grade"))


def most_cited(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """(doc_id, in_degree, out_degree) of the most cited documents; of equals the smaller doc_id."""
    return graph.degrees(nodes, edges).orderBy(F.desc("in_degree"), "doc_id").limit(top)


def graph_stats(nodes: DataFrame, edges: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """((nodes, edges, components, largest, mean_degree), the most cited documents)."""
    degrees = graph.saved(graph.degrees(nodes, edges), "degrees")
    parts = graph.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    sizes = parts.agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    whole = degrees.agg(F.count("*").alias("nodes"), F.sum("in_degree").alias("edges"), F.avg(F.col("in_degree") + F.col("out_degree")).alias("mean_degree"))
    return whole.join(F.broadcast(sizes)), degrees.orderBy(F.desc("in_degree"), "doc_id").limit(top)  # one row each


def experiment(configs: dict[str, Callable[[], DataFrame]], gold: DataFrame, times: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """(run_id, queries, the seven metrics[, p50, p95, mean]) of every configuration, a function that gives its run
    (query_id, rank, doc_id); times: (run_id, ms) of its queries. The configurations are a short list of the caller's."""
    judged = [evaluate.macro(evaluate.per_query(run(), gold)).withColumn("run_id", F.lit(prefix + name)) for name, run in configs.items()]
    table = reduce(DataFrame.unionByName, judged)
    return table if times is None else table.join(evaluate.latency(times, "run_id", "ms"), "run_id", "left")
