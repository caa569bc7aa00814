"""Precedent over the citation graph: standing of decisions, expansion towards opposing outcomes, conflicts of holdings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.functions.judgements import OPPOSITE
from dokuma.functions.vectors import cosine
from dokuma.operators import vector_pairs
from dokuma.operators.graph import saved

#: A conflict is looked for among so many first results of a query; more ranks would be compared pair by pair.
COMPARED = 10


def standing(documents: DataFrame, citations: DataFrame) -> DataFrame:
    """(doc_id, status) from documents (doc_id, court_level, decision_authority, disposition) and citations (src, dst,
    treatment). In this order: superseded_by_ibk (a unification decision reverses it), disputed (a higher court reverses
    it and a lower one that cites it insists), overruled (a higher court reverses it), conflicting_precedent (its own
    level reverses it: no chamber overrules another), criticized, good_law (cited without any of these), unknown (not
    cited). Counts are aggregated per cited document before the joins, so a hot one is no hot task."""
    doc = documents.select("doc_id", "court_level", "decision_authority", "disposition")
    citing = doc.select(F.col("doc_id").alias("src"), F.col("court_level").alias("by_level"), F.col("decision_authority").alias("by"), F.col("disposition").alias("by_disposition"))
    # What a citing document brings is one of few kinds: counted per cited document and kind before levels are compared.
    kinds = citations.select("src", "dst", "treatment").join(citing, "src").groupBy("dst", "by_level", "by", "by_disposition", "treatment").agg(F.count("*").alias("n"))
    rows = kinds.join(doc.select(F.col("doc_id").alias("dst"), F.col("court_level").alias("level")), "dst")
    reverses = F.col("treatment") == "REVERSES"
    facts = rows.groupBy("dst").agg(
        F.max(reverses & (F.col("by") == "ibk")).alias("settled"),
        F.max(reverses & (F.col("by_level") > F.col("level"))).alias("above"),
        F.max((F.col("by_disposition") == "direnme") & (F.col("by_level") <= F.col("level"))).alias("insisted"),
        F.max(reverses & (F.col("by_level") == F.col("level"))).alias("beside"),
        F.max(F.col("treatment").isin("CRITICIZES", "DISTINGUISHES")).alias("criticized"),
    )
    status = F.when(F.col("dst").isNull(), "unknown")
    status = status.when(F.col("settled"), "superseded_by_ibk").when(F.col("above") & F.col("insisted"), "disputed").when(F.col("above"), "overruled")
    status = status.when(F.col("beside"), "conflicting_precedent").when(F.col("criticized"), "criticized").otherwise("good_law")
    return doc.join(facts, doc.doc_id == facts.dst, "left").select("doc_id", status.alias("status"))


def opposing_expansion(seeds: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, doc_id, expansion_reason) of seeds (query_id, doc_id) and their neighbours in either direction: seed;
    reversal_chain (a seed reverses it, or cites it and itself reversed); opposing_disposition (all seeds of the query
    agree and it decided the other way); citation_neighbor. The strongest reason stays."""
    decided = documents.select("doc_id", "disposition")
    led = seeds.join(decided, "doc_id")
    outcome = led.groupBy("query_id").agg(F.when(F.min("disposition") == F.max("disposition"), F.max("disposition")).alias("common"))
    out = led.join(citations, led.doc_id == citations.src).select("query_id", F.col("dst").alias("doc_id"), ((F.col("treatment") == "REVERSES") | (F.col("disposition") == "bozma")).alias("reversal"))
    back = seeds.join(citations, seeds.doc_id == citations.dst).select("query_id", F.col("src").alias("doc_id"), F.lit(False).alias("reversal"))
    near = out.union(back).groupBy("query_id", "doc_id").agg(F.max("reversal").alias("reversal")).join(seeds, ["query_id", "doc_id"], "left_anti")
    other = F.lit(None).cast("string")
    for a, b in OPPOSITE.items():
        other = F.when(F.col("common") == a, b).otherwise(other)
    rows = near.join(decided, "doc_id").join(outcome, "query_id")
    reason = F.when(F.col("reversal"), "reversal_chain").when(F.coalesce(F.col("disposition") == other, F.lit(False)), "opposing_disposition").otherwise("citation_neighbor")
    return rows.select("query_id", "doc_id", reason.alias("expansion_reason")).union(seeds.select("query_id", "doc_id", F.lit("seed")).distinct())


def diversity(run: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, diversity): different known dispositions among the first k."""
    rows = run.where(F.col("rank") <= k).join(documents.select("doc_id", "disposition"), "doc_id")
    return rows.groupBy("query_id").agg(F.count_distinct(F.when(F.col("disposition") != "unknown", F.col("disposition"))).alias("diversity"))


def conflict_type() -> Column:
    """The kind of conflict between the holdings a_* and b_*. bozma_direnme: one reversed and one insisted; inter_daire: same
    court, different chambers, different outcomes; temporal: same chamber, different dates and outcomes; else null."""
    same = lambda f: F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    stand = F.sort_array(F.array("a_disposition", "b_disposition"))
    return (
        F.when((stand[0] == "bozma") & (stand[1] == "direnme"), "bozma_direnme").when(same("disposition"), None).when(same("court") & ~same("daire"), "inter_daire")
        .when(same("court") & same("daire") & ~same("decision_date"), "temporal")
    )


def conflicts(run: DataFrame, holdings: DataFrame, threshold: float = 0.7, first: int = COMPARED) -> DataFrame:
    """(query_id, doc_a, doc_b, similarity, conflict_type) among each query's first results, with holdings (doc_id,
    vector, court, daire, decision_date, disposition). Pairs above the threshold are related; those without a
    ``conflict_type`` carry no conflict. A query has at most first * (first - 1) / 2 pairs."""
    rows = run.where(F.col("rank") <= first).select("query_id", "doc_id").join(holdings, "doc_id")
    fields = ("doc_id", "vector", "court", "daire", "decision_date", "disposition")
    side = lambda x: rows.select("query_id", *[F.col(f).alias(f"{x}_{f}") for f in fields])
    pairs = side("a").join(side("b"), "query_id").where("a_doc_id < b_doc_id").withColumn("similarity", cosine(F.col("a_vector"), F.col("b_vector")))
    found = pairs.where(F.col("similarity") > threshold).withColumn("conflict_type", conflict_type()).where("conflict_type IS NOT NULL")
    return found.select("query_id", F.col("a_doc_id").alias("doc_a"), F.col("b_doc_id").alias("doc_b"), "similarity", "conflict_type")


def corpus_conflicts(holdings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_a, doc_b, similarity, conflict_type, n_pairs): the conflicts of all holdings (as for ``conflicts``), whoever asks.
    Holdings with equal vectors, court, chamber, date and disposition stand as one: doc_a and doc_b are the smallest of
    each side, n_pairs the number of pairs of documents that a row stands for. Null vectors and ids take no part."""
    facts = ("court", "daire", "decision_date", "disposition")
    known = holdings.where("doc_id IS NOT NULL")
    one, members = vector_pairs.classes(known.select(F.col("doc_id").alias("id"), "vector"))
    kinds = members.join(known.select(F.col("doc_id").alias("member"), *facts).distinct(), "member").groupBy("id", *facts).agg(F.count("*").alias("n"), F.min("member").alias("doc_id"))
    kinds = saved(kinds, "holdings")
    side = lambda x: kinds.select(F.col("id").alias(x), *[F.col(f).alias(f"{x}_{f}") for f in ("doc_id", "n", *facts)])
    pairs = vector_pairs.similar(one, threshold).unionByName(one.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where("a <> b OR a_doc_id < b_doc_id").withColumn("conflict_type", conflict_type()).where("conflict_type IS NOT NULL")
    return found.select(F.least("a_doc_id", "b_doc_id").alias("doc_a"), F.greatest("a_doc_id", "b_doc_id").alias("doc_b"), "similarity", "conflict_type", (F.col("a_n") * F.col("b_n")).alias("n_pairs"))


def candidate_gold(manifest: DataFrame, templates: DataFrame, groups: DataFrame) -> DataFrame:
    """Judgments (query_id, doc_id, relevance, rationale) for templates (query_id, relevance, rationale, cluster, first,
    most) with groups (cluster, field, words): a cluster holds the manifest's documents (not excluded) that contain, in
    every named field, one of the words, in lower case. The template takes ``most`` of them from place ``first`` on, in
    order of doc_id; of several judgments on one document the highest stays."""
    fields = [f for f in ("court", "daire", "law_branch", "topic_keywords", "filename") if f in manifest.columns]
    flat = [F.struct(F.lit(f).alias("field"), F.lower(F.concat_ws(" ", f)).alias("value")) for f in fields]
    kept = manifest.where(~F.coalesce("excluded", F.lit(False))).select("doc_id", F.explode(F.array(*flat)).alias("x")).select("doc_id", "x.field", "x.value")
    hits = kept.join(groups, "field").where(F.exists("words", lambda w: F.contains("value", F.lower(w)))).groupBy("cluster", "doc_id").agg(F.count_distinct("field").alias("n"))
    members = hits.join(groups.groupBy("cluster").agg(F.count_distinct("field").alias("n")), ["cluster", "n"])
    placed = members.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy("doc_id")) - 1)
    rows = templates.join(placed, "cluster").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("most")))
    best = rows.groupBy("query_id", "doc_id").agg(F.max(F.struct("relevance", "rationale")).alias("j"))
    return best.select("query_id", "doc_id", "j.relevance", "j.rationale")
