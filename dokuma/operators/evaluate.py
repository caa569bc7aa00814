"""Ranked-run evaluation: Recall, NDCG, reciprocal rank, hits; means, comparison, validation, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.operators.graph import saved

METRICS = ("recall_at_5", "recall_at_10", "recall_at_20", "ndcg_at_5", "ndcg_at_10", "mrr", "hit_rate_at_5")


def ranked(runs: DataFrame) -> DataFrame:
    """(query_id, rank from 1, doc_id) of (query_id, retrieved_docs)."""
    return runs.select("query_id", F.posexplode("retrieved_docs").alias("pos", "doc_id")).select("query_id", (F.col("pos") + 1).alias("rank"), "doc_id")


def gain(grade: Column, rank: Column, most: Column | None = None) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) * (1.0 if most is None else most) / F.log2(rank + 1.0)


def per_query(run: DataFrame, gold: DataFrame, queries: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """The seven metrics of each query in both run (query_id, rank, doc_id) and gold (query_id, doc_id, grade).

    Recall and hits count distinct documents, NDCG counts a repeated one again; the ideal ranking takes all judged
    grades. ``queries`` names queries with an empty run too, which score 0. ``weight``: a column of gold that multiplies
    gains (authority-weighted NDCG)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    by_grade = Window.partitionBy("query_id").orderBy(F.desc("g"), "doc_id")
    judged = gold.withColumn("g", (F.pow(F.lit(2.0), F.col("grade")) - 1) * w).withColumn("i", F.row_number().over(by_grade))
    ideal = lambda k: F.sum(F.when(F.col("i") <= k, F.col("g") / F.log2(F.col("i") + 1.0)).otherwise(0.0))
    want = judged.groupBy("query_id").agg(F.count_if(F.col("grade") >= 1).alias("relevant"), ideal(5).alias("ideal_5"), ideal(10).alias("ideal_10"))
    hit = F.col("grade") >= 1
    seen = run.join(gold.select("query_id", "doc_id", "grade", w.alias("w")), ["query_id", "doc_id"], "left")
    found = lambda k: F.count_distinct(F.when(hit & (F.col("rank") <= k), F.col("doc_id")))
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, gain(F.coalesce("grade", F.lit(0)), F.col("rank"), F.coalesce("w", F.lit(1.0)))).otherwise(0.0))
    got = seen.groupBy("query_id").agg(*[found(k).alias(f"n_{k}") for k in (5, 10, 20)], dcg(5).alias("dcg_5"), dcg(10).alias("dcg_10"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    asked = run.select("query_id").distinct() if queries is None else queries.select("query_id").distinct()
    rows = asked.join(want, "query_id").join(got, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return rows.select(
        "query_id", *[ratio(f"n_{k}", "relevant").alias(f"recall_at_{k}") for k in (5, 10, 20)], *[ratio(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_at_{k}") for k in (5, 10)],
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce((F.col("n_5") > 0).cast("double"), F.lit(0.0)).alias("hit_rate_at_5"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Means over the evaluated queries; zeros when there are none."""
    return metrics.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def compare(a: DataFrame, b: DataFrame, metric: str = "ndcg_at_10") -> DataFrame:
    """(query_id, a, b, delta, status), regressions first; a query that one run lacks counts 0 there."""
    both = a.select("query_id", F.col(metric).alias("a")).join(b.select("query_id", F.col(metric).alias("b")), "query_id", "full_outer").fillna(0.0, ["a", "b"])
    delta = F.col("b") - F.col("a")
    status = F.when(delta < -1e-4, "REGRESSED").when(delta > 1e-4, "improved").otherwise("unchanged")
    return both.select("query_id", "a", "b", delta.alias("delta"), status.alias("status")).orderBy("delta", "query_id")


def latency(times: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95, mean) with the element at index floor(n * p) of the sorted list, not interpolated; nulls and NaN take no
    part. Values are counted, the counts sorted over all tasks; each task numbers its range and learns from the sums of
    the ranges before it where that begins, so a group of any size is spread."""
    counts = times.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(by, value).agg(F.count("*").alias("n"))
    dealt = saved(counts.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()), "latency")
    own = dealt.groupBy(by, "part").agg(F.sum("n").alias("own"), F.sum(F.col("n") * F.col(value)).alias("total"))
    whole = Window.partitionBy(by)
    begins = own.select(F.col(by).alias("__by"), F.col("part").alias("__part"), (F.sum("own").over(whole.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(whole).alias("all"), F.sum("total").over(whole).alias("total"))
    end = F.col("before") + F.sum("n").over(Window.partitionBy(by, "part").orderBy(value))
    placed = dealt.join(begins, F.col(by).eqNullSafe(F.col("__by")) & (F.col("part") == F.col("__part"))).withColumn("end", end)
    at = lambda p: F.min(F.when(F.col("end") > F.floor(F.col("all") * p), F.col(value)))
    return placed.groupBy(by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), (F.max("total") / F.max("all")).alias("mean"))


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the largest metric, the smallest id among equals."""
    return runs.orderBy(F.desc(metric), "run_id").limit(1)


def separation(pairs: DataFrame) -> DataFrame:
    """Mean similarity of related and unrelated pairs (related boolean, score), their difference, and whether it is good."""
    r, u = F.avg(F.when(F.col("related"), F.col("score"))), F.avg(F.when(~F.col("related"), F.col("score")))
    return pairs.agg(r.alias("related"), u.alias("unrelated"), (r - u).alias("separation"), ((r - u) > 0.05).alias("good"))


def gold_checks(gold: DataFrame, manifest: DataFrame, required_branches: list[str], least_queries: int = 50, least_courts: int = 5, least_pairs: int = 10) -> DataFrame:
    """(check, level, ok): the acceptance rules of a gold standard over (query_id, law_branch, doc_id, grade,
    n_pairs, court)."""
    valid = manifest.where(~F.col("excluded")).select("doc_id")
    unknown = gold.join(valid, "doc_id", "left_anti").agg(F.count("*").alias("unknown"))
    per = gold.groupBy("query_id").agg(F.max("grade").alias("top"), F.min("grade").alias("low"), F.max("n_pairs").alias("pairs"))
    q = per.agg(F.count("*").alias("queries"), F.count_if(F.col("top") < 2).alias("weak"), F.count_if(F.col("low") > 0).alias("easy"), F.count_if(F.col("pairs") > 0).alias("contradictory"))
    whole = gold.agg(F.collect_set("law_branch").alias("branches"), F.count_distinct("court").alias("courts"))
    one = q.join(F.broadcast(whole)).join(F.broadcast(unknown))
    rules = [
        ("queries", "error", F.col("queries") >= least_queries), ("branches", "error", F.size(F.array_except(F.array(*[F.lit(x) for x in required_branches]), "branches")) == 0),
        ("courts", "warning", F.col("courts") >= least_courts), ("contradictory", "warning", F.col("contradictory") >= least_pairs), ("relevant", "error", F.col("weak") == 0),
        ("hard_negatives", "warning", F.col("easy") == 0), ("references", "error", F.col("unknown") == 0),
    ]
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(v).alias("level"), c.alias("ok")) for n, v, c in rules])).alias("r")).select("r.*")
