"""Retrieval experiments as one plan: the configuration is a column.

A configuration is a row (run_id, variant, top_chunks, strategy, top_k): which vectors are searched (a model's, or those of
chunks of one size), how many chunks are taken, how their scores become a document's, and how many documents stay. All runs
share one scan of the vectors and one pass of metrics; there is no loop over configurations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.operators import evaluate, retrieve

#: Configurations are broadcast; there are at most so many.
MOST_CONFIGS = 10_000


def retrieved(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(variant, query_id, chunk_id, doc_id, score, rank): the k nearest chunks of every query (variant, query_id, query) among
    the vectors (variant, chunk_id, doc_id, vector) of its variant, ties to the smaller chunk_id; all variants in one scan.
    Vectors of all variants have one length. At most ``retrieve.BROADCAST_ROWS`` queries of all variants together."""
    spark = queries.sparkSession
    asked = queries.where(retrieve.usable("query")).groupBy("variant", "query_id").agg(F.min("query").alias("query")).limit(retrieve.BROADCAST_ROWS + 1).collect()
    if len(asked) > retrieve.BROADCAST_ROWS:
        raise ValueError(f"more than {retrieve.BROADCAST_ROWS} queries in one experiment")
    places = spark.createDataFrame([(i, r.variant, r.query_id) for i, r in enumerate(asked)], f"place int, variant {queries.schema['variant'].dataType.simpleString()}, query_id {queries.schema['query_id'].dataType.simpleString()}")
    numbers = {v: n for n, v in enumerate(sorted({r.variant for r in asked}))}
    probed: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        probed.setdefault(numbers[r.variant], []).append(i)
    number = F.lit(None).cast("int")
    for v, n in numbers.items():
        number = F.when(F.col("variant") == F.lit(v), n).otherwise(number)
    rows = vectors.withColumn("cell", number).where("cell IS NOT NULL")
    numbered = [{"query_id": i, "query": r.query} for i, r in enumerate(asked)]
    if not asked:
        return places.join(vectors, "variant").select("variant", "query_id", "chunk_id", "doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    found = retrieve.best(retrieve.scored_blocks(numbered, rows, places.schema["place"].dataType, k, probed).withColumnRenamed("query_id", "place"), "place", k, F.desc("score"), F.asc("chunk_id"))
    return found.join(F.broadcast(places), "place").select("variant", "query_id", "chunk_id", "doc_id", "score", "rank")


def runs(found: DataFrame, configs: DataFrame) -> DataFrame:
    """(run_id, query_id, rank, doc_id, score) of every configuration from the chunks that ``retrieved`` found with a k of at
    least the largest top_chunks; ties go to the document seen first."""
    if configs.limit(MOST_CONFIGS + 1).count() > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    rows = found.join(F.broadcast(configs), "variant").where(F.col("rank") <= F.col("top_chunks"))
    each = {name: how(F.col("score")) for name, how in retrieve.STRATEGIES.items()}
    score = F.lit(None).cast("double")
    for name in each:
        score = F.when(F.col("strategy") == name, F.col(name)).otherwise(score)
    docs = rows.groupBy("run_id", "query_id", "doc_id", "strategy", "top_k").agg(*[c.alias(n) for n, c in each.items()], F.min("rank").alias("first")).withColumn("score", score)
    order = Window.partitionBy("run_id", "query_id").orderBy(F.desc("score"), "first", "doc_id")
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k")).select("run_id", "query_id", "rank", "doc_id", "score")


def table_of_runs(run: DataFrame, configs: DataFrame, queries: DataFrame, gold: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """One row a configuration: run_id, asked (queries), empty (queries without a result), mean_docs, least_docs, the means of
    the seven metrics over the judged queries, and from times (run_id, ms) p50, p95 and mean_ms. A query without a result
    scores 0 and counts."""
    ids = F.broadcast(configs.select("run_id"))
    both = F.struct("run_id", "query_id").alias("query_id")
    asked = queries.select("query_id").distinct().join(ids).select("run_id", "query_id")
    got = run.groupBy("run_id", "query_id").agg(F.count("*").alias("docs"))
    counts = asked.join(got, ["run_id", "query_id"], "left").fillna(0, ["docs"])
    counts = counts.groupBy("run_id").agg(F.count("*").alias("asked"), F.count_if(F.col("docs") == 0).alias("empty"), F.avg("docs").alias("mean_docs"), F.min("docs").alias("least_docs"))
    judged = evaluate.per_query(run.select(both, "rank", "doc_id"), gold.join(ids).select(both, "doc_id", "grade"), asked.select(both))
    means = judged.groupBy(F.col("query_id.run_id").alias("run_id")).agg(*[F.avg(m).alias(m) for m in evaluate.METRICS])
    out = counts.join(means, "run_id", "left").fillna(0.0, list(evaluate.METRICS))
    return out if times is None else out.join(evaluate.latency(times, "run_id", "ms").withColumnRenamed("mean", "mean_ms"), "run_id", "left")
