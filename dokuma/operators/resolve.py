"""Resolving raw citations to documents: exact key, prefix, fuzzy name, then case and decision numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dokuma.functions.text import chamber_key
from dokuma.operators import graph, names

SHORTEST_PREFIX, LEAST_RATIO = 5, 0.88


def keyed(documents: DataFrame) -> DataFrame:
    """(key, doc_id, numbers): every document under its chamber and, where that differs, under court and chamber."""
    own = F.array_distinct(F.array(chamber_key(F.col("chamber")), chamber_key(F.concat_ws(" ", F.coalesce("court", F.lit("")), F.coalesce("chamber", F.lit(""))))))
    numbers = F.array_distinct(F.filter(F.array(F.coalesce("case_no", F.lit("")), F.coalesce("decision_no", F.lit(""))), lambda x: x != ""))
    return documents.select(F.explode(own).alias("key"), "doc_id", "case_no", "decision_no", numbers.alias("numbers")).where("key <> ''")


def name_links(cited: DataFrame, keys: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """(name, key): how each cited name finds index keys. Exact; else by prefix, an equi-join on the keys' beginnings of
    every length that a cited name has; else by the closest name of the vocabulary. Only distinct names and keys take part."""
    named = graph.saved(cited.select(F.col("chamber").alias("name")).distinct().withColumn("name_key", chamber_key(F.col("name"))).where("name_key <> ''"), "named")
    exact = named.join(keys, named.name_key == keys.key).select("name", "key")
    rest = named.join(exact, "name", "left_anti")
    long = rest.where(F.length("name_key") >= SHORTEST_PREFIX)
    heads = keys.join(F.broadcast(long.select(F.length("name_key").alias("n")).distinct()), F.col("n") <= F.length("key")).select("key", F.expr("substr(key, 1, n)").alias("head"))
    prefix = long.join(heads, F.col("name_key") == F.col("head")).select("name", "key")
    out = exact.union(prefix)
    if vocabulary is None:
        return out
    # Written, as each is read many times below: otherwise every reader works it out anew, in a plan that fills the driver.
    out = graph.saved(out, "links")
    words = graph.saved(vocabulary.select(F.col("name").alias("word")).distinct().withColumn("key", chamber_key(F.col("word"))).join(keys, "key", "left_semi"), "words")
    near = names.closest(named.join(out, "name", "left_anti"), words.select(F.col("word").alias("name")), LEAST_RATIO)
    return out.union(near.join(words, F.col("right") == F.col("word")).select("left", "key"))


def resolve(citations: DataFrame, documents: DataFrame, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) of (citation, source_doc_id, chamber, case_no, decision_no): every citation is in exactly
    one. Numbers are compared as sets, so case and decision numbers may be swapped; two equal best matches are ambiguous;
    a document never resolves to itself. ``vocabulary`` (name) has names beside those of the documents for the closest match;
    null: no closest match. Citations meet documents by chamber and number at once, so a chamber of any size
    costs only its equal numbers."""
    index = graph.saved(keyed(documents), "index")
    keys = graph.saved(index.select("key").distinct(), "keys")
    links = graph.saved(name_links(citations, keys, vocabulary), "links")
    numbers = F.array_distinct(F.filter(F.array(F.coalesce("case_no", F.lit("")), F.coalesce("decision_no", F.lit(""))), lambda x: x != ""))
    asked = citations.withColumn("name_key", chamber_key(F.col("chamber"))).withColumn("wanted", numbers)
    there = links.join(keys, "key", "left_semi")
    by_number = index.select("key", F.explode("numbers").alias("number"), "doc_id", F.col("case_no").alias("t_case"), F.col("decision_no").alias("t_decision"))
    cited = asked.select("citation", "source_doc_id", "chamber", F.explode("wanted").alias("number")).join(there, F.col("chamber") == F.col("name"))
    found = cited.join(by_number, ["key", "number"]).where(F.col("doc_id") != F.col("source_doc_id"))
    scored = found.groupBy("citation", "doc_id").agg(F.count_distinct("number").alias("same"), F.min(F.struct("t_case", "t_decision")).alias("t"))
    most = F.max(F.struct("same")).over(Window.partitionBy("citation"))
    top = scored.withColumn("best", most["same"]).where("same = best")
    chosen = top.groupBy("citation").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t.t_case", "t.t_decision", "same")).alias("x"))
    known = asked.select("citation", "chamber").join(there.select("name").distinct(), F.col("chamber") == F.col("name"), "left_semi").select("citation").distinct().withColumn("known", F.lit(True))
    rows = asked.join(known, "citation", "left").join(chosen, "citation", "left")
    reason = (
        F.when(F.col("name_key") == "", "no_daire_extracted").when(F.size("wanted") == 0, "no_esas_or_karar").when(F.col("known").isNull(), "daire_not_in_corpus")
        .when(F.col("n").isNull(), "no_ek_match_in_daire").when(F.col("n") > 1, "ambiguous_match")
    )
    rows = graph.saved(rows.withColumn("reason", reason), "resolved")
    fill = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    good = rows.where("reason IS NULL").select("citation", "source_doc_id", F.col("x.doc_id").alias("target_doc_id"), "chamber", fill("case_no", "x.t_case").alias("case_no"), fill("decision_no", "x.t_decision").alias("decision_no"), F.when(F.col("x.same") == 2, 1.0).otherwise(0.8).alias("confidence"))
    bad = rows.where("reason IS NOT NULL").select("citation", "source_doc_id", "chamber", "case_no", "decision_no", "reason")
    return good, bad


def resolution_rate(resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    both = resolved.select(F.lit(1).alias("ok")).unionAll(unresolved.select(F.lit(0).alias("ok")))
    return both.agg(F.count("*").alias("total"), F.coalesce(100.0 * F.avg("ok"), F.lit(0.0)).alias("rate"))
