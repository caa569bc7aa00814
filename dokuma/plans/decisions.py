"""Registered queries on decisions: citations, metadata, outcomes, precedent, scoring, record and table keeping.

The prose of ``documents`` names no courts, so decisions are made of it: headers in front, closing words behind, by
doc_id; every text is read whole. The graph's documents are ``part`` as in the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions import judgements
from dokuma.operators import citations, evaluate, extract, metadata, precedent, records, resolve, scoring, tables
from dokuma.plans.catalog import EDGES, GOLD, SCORED, TOP_DOCS, chunks25, edges, gold, inline, query, rounded, table, top_documents, values
from dokuma.sources import files


def picked(key: Column, options: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), (key % len(options)).cast("int"))


def picked_sql(key: str, options: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in options) + f"][{key} % {len(options)} + 1]"


CITING = " Yargıtay 11. Hukuk Dairesinin 2019/366 E. 2021/945 K. sayılı kararı; Danıştay Beşinci Dairesi 2010/5 K.; 1.4.1974 tarih 1/2 sayılı İçtihadı Birleştirme; Bursa BAM 4. CD 2020/1 E. 2020/2 K. ve Yargıtay 11. HD E: 2019/366, K: 2021/945; Anayasa Mahkemesi B. No: 2013/7449"
CITED_ROWS = [
    (0, "İçtihatları Birleştirme HGK", "1974/1", "1974/2"), (1, "Yargıtay 11. Hukuk Dairesi", "2019/366", "2021/945"), (2, "Danıştay 5. Daire", None, "2010/5"),
    (3, "Bursa Bölge Adliye Mahkemesi 4. Ceza Dairesi", "2020/1", "2020/2"), (4, "Anayasa Mahkemesi", "2013/7449", None),
]


@query("x01_x03_citations", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(i AS INTEGER) AS citation_index, daire, esas_no, karar_no FROM documents, " + values(CITED_ROWS, "i, daire, esas_no, karar_no"))
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(CITING)).alias("text"))
    return citations.extract_citations(d).select("doc_id", "citation_index", "daire", "esas_no", "karar_no")


HEADS = [
    "Yargıtay 1. HD., E. 2024/19 K. 2025/58 T. 9.1.2025", "Danıştay İDDK., E. 1999/953 K. 1999/889 T. 15.10.1999", "Bursa BAM, 4. CD., E. 2020/1 K. 2020/2 T. 1.2.2020",
    "x\nT.C. Danıştay Başkanlığı - 5. Daire\nEsas No.: 2021/6\nKarar No.: 2022/2\nKarar tarihi: 27.05.2022", "Ankara 24. İdare Mahkemesi, E. 2019/1 K. 2019/2 T. 3.4.2019",
]
HEAD_ROWS = [
    (0, "Yargıtay", "1. Hukuk Dairesi", "hukuk", 3, "2024/19", "2025/58", "09.01.2025"), (1, "Danıştay", "İdari Dava Daireleri Kurulu", "idari", 3, "1999/953", "1999/889", "15.10.1999"),
    (2, "BAM", "Bursa BAM 4. Ceza Dairesi", "ceza", 2, "2020/1", "2020/2", "01.02.2020"), (3, "Danıştay", "5. Daire", "idari", 3, "2021/6", "2022/2", "27.05.2022"),
    (4, "İlk Derece", "Ankara 24. İdare Mahkemesi", "idari", 1, "2019/1", "2019/2", "03.04.2019"),
]


def headed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.concat("doc_id", F.lit(".md")).alias("filename"), F.concat(picked(F.col("doc_id"), HEADS), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query("p05_p09_metadata", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, court, daire, law_branch, CAST(court_level AS INTEGER) AS court_level, esas_no, karar_no, decision_date, false AS excluded FROM documents JOIN " + values(HEAD_ROWS, "k, court, daire, law_branch, court_level, esas_no, karar_no, decision_date") + " ON k = doc_id % 5")
def _(spark, sf):
    return metadata.parse(headed(spark, sf)).drop("filename", "topic_keywords", "exclude_reason")


@query("p09_file_names", "SELECT doc_id || '-hukuk-dairesi-e-2020-' || doc_id || '-k-2021-7-t-3-4-2021' AS doc_id, 'Yargıtay' AS court, doc_id || '. Hukuk Dairesi' AS daire, '2020/' || doc_id AS esas_no, '2021/7' AS karar_no, '03.04.2021' AS decision_date FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("doc_id", F.lit("-hukuk-dairesi-e-2020-"), "doc_id", F.lit("-k-2021-7-t-3-4-2021.md")).alias("filename"), F.lit("-").alias("text"))
    return metadata.parse(d).select("doc_id", "court", "daire", "esas_no", "karar_no", "decision_date")


@query("p19_slugs", """WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'Hukuk Genel Kurulu 2012_' || doc_id || ' E. , 2013_5 K.' WHEN 1 THEN 'Şube (' || doc_id // 20 || ') ' || doc_id ELSE 'Ölçü ' || doc_id // 20 || repeat('!', CAST(doc_id % 20 AS INTEGER)) END AS old,
CASE doc_id % 3 WHEN 0 THEN 'hukuk-genel-kurulu-e-2012-' || doc_id || '-k-2013-5-1' WHEN 1 THEN 'sube-' || doc_id // 20 || '-' || doc_id ELSE 'olcu-' || doc_id // 20 END AS new FROM documents)
SELECT old, new || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS new FROM s WINDOW w AS (PARTITION BY new ORDER BY old)""")
def _(spark, sf):
    k, group = F.col("doc_id") % 3, F.expr("doc_id div 20").cast("string")
    stem = F.when(k == 0, F.concat(F.lit("Hukuk Genel Kurulu 2012_"), "doc_id", F.lit(" E. , 2013_5 K."))).when(k == 1, F.concat(F.lit("Şube ("), group, F.lit(") "), "doc_id")).otherwise(F.concat(F.lit("Ölçü "), group, F.expr("repeat('!', int(doc_id % 20))")))
    return metadata.renamed(table(spark, sf, "documents").select(stem.alias("stem")))


CLOSINGS = ["hükmün BOZULMASINA oy birliğiyle", "kararın ONANMASINA oy çokluğuyla", "istemin REDDİNE", "davanın KABULÜNE", "KISMEN BOZULMASINA oybirliğiyle", "DİRENME kararı", "-"]
CLOSED = [("bozma", "oy_birligi"), ("onama", "oy_coklugu"), ("red", "unknown"), ("kabul", "unknown"), ("kismen_bozma", "oy_birligi"), ("direnme", "unknown"), ("unknown", "unknown")]


@query("q03_disposition", "SELECT doc_id, disposition, voting_method FROM documents JOIN " + values([(i, *c) for i, c in enumerate(CLOSED)], "k, disposition, voting_method") + " ON k = doc_id % 7")
def _(spark, sf):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), picked(F.col("doc_id"), CLOSINGS))
    return table(spark, sf, "documents").select("doc_id", judgements.disposition(text).alias("disposition"), judgements.voting(text).alias("voting_method"))


BODIES = [("Yargıtay", 3, "2. Hukuk Dairesi"), ("Yargıtay", 3, "Hukuk Genel Kurulu"), ("Danıştay", 3, "İçtihatları Birleştirme Kurulu"), ("Danıştay", 3, "İdari Dava Daireleri Kurulu"), ("AYM", 4, "Anayasa Mahkemesi"), ("BAM", 2, "İzmir BAM"), ("İlk Derece", 1, "3. İş"), ("Sayıştay", 3, "1. Daire"), ("Uyuşmazlık", 4, ""), ("AİHM", 5, ""), ("", 0, "")]


@query("q04_decision_types", "SELECT doc_id, CASE WHEN court = 'Sayıştay' THEN 'sayistay' WHEN court = 'Uyuşmazlık' THEN 'uyusmazlik' WHEN court = 'AYM' THEN 'norm_denetimi' WHEN court = 'AİHM' THEN 'aihm' WHEN level = 1 THEN 'karar' WHEN level = 2 THEN 'istinaf_incelemesi' WHEN level = 3 THEN 'temyiz_incelemesi' ELSE 'unknown' END AS decision_type, "
       "CASE WHEN court = 'AYM' THEN 'aym' WHEN court = 'Uyuşmazlık' THEN 'uyusmazlik' WHEN court = 'AİHM' THEN 'aihm' WHEN court NOT IN ('Yargıtay', 'Danıştay') THEN 'unknown' WHEN contains(chamber, 'Birleştirme') THEN 'ibk' WHEN contains(chamber, 'Kurulu') THEN 'genel_kurul_karari' WHEN contains(chamber, 'Daire') THEN 'daire_karari' ELSE 'unknown' END AS decision_authority FROM documents JOIN " + values([(i, *b) for i, b in enumerate(BODIES)], "k, court, level, chamber") + f" ON k = doc_id % {len(BODIES)}")
def _(spark, sf):
    b = F.element_at(F.array(*[F.struct(F.lit(c).alias("court"), F.lit(n).alias("level"), F.lit(x).alias("chamber")) for c, n, x in BODIES]), (F.col("doc_id") % len(BODIES) + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", b.alias("b"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "b.*", "text")
    return d.select("doc_id", judgements.decision_type(F.col("court"), F.col("level"), F.col("text")).alias("decision_type"), judgements.decision_authority(F.col("court"), F.col("chamber")).alias("decision_authority"))


SNIPPETS = ["kararın onanmasına", "hükmün BOZULMASINA", "içtihada uygun olarak", "olayı farklıdır", "...", "isabetsiz bulunmuş", "isabetli bulunmuş"]
TREATED = ["AFFIRMS", "REVERSES", "FOLLOWS", "DISTINGUISHES", "NEUTRAL", "REVERSES", "AFFIRMS"]


@query("q05_treatment", f"SELECT doc_id, {picked_sql('doc_id', TREATED)} AS treatment FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", judgements.treatment(picked(F.col("doc_id"), SNIPPETS)).alias("treatment"))


@query("q07_sections")
def _(spark, sf):
    """Each document as claim, reasons and holding, cut at the headings and at 256 tokens."""
    t = F.coalesce("text", F.lit(""))
    return extract.chunk_sections(table(spark, sf, "documents").select("doc_id", F.concat(F.lit("İDDİA\n"), t, F.lit("\nGEREKÇE:\n"), t, F.lit("\nHÜKÜM\nBozulmasına.")).alias("text")), 256)


KINDS = ["FOLLOWS", "REVERSES", "NEUTRAL", "DISTINGUISHES", "NEUTRAL", "NEUTRAL", "AFFIRMS"]
GRAPH = "WITH " + EDGES + f""", c AS (SELECT DISTINCT src, dst, {picked_sql('(src * 5 + dst)', KINDS)} AS treatment FROM edges),
d AS (SELECT p_partkey AS doc_id, p_partkey % 4 + 1 AS court_level, CASE WHEN p_partkey % 97 = 0 THEN 'ibk' ELSE 'daire_karari' END AS decision_authority, {picked_sql('p_partkey', ['bozma', 'onama', 'red', 'direnme', 'unknown'])} AS disposition FROM part)"""


def cited_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = edges(spark, sf).distinct().select("src", "dst", picked(F.col("src") * 5 + F.col("dst"), KINDS).alias("treatment"))
    p = F.col("p_partkey")
    d = table(spark, sf, "part").select(p.alias("doc_id"), (p % 4 + 1).alias("court_level"), F.when(p % 97 == 0, "ibk").otherwise("daire_karari").alias("decision_authority"), picked(p, ["bozma", "onama", "red", "direnme", "unknown"]).alias("disposition"))
    return d, c


@query("q16_standing", GRAPH + """, f AS (SELECT dst, bool_or(treatment = 'REVERSES' AND s.decision_authority = 'ibk') AS settled, bool_or(treatment = 'REVERSES' AND s.court_level > t.court_level) AS above, bool_or(s.disposition = 'direnme' AND s.court_level <= t.court_level) AS insisted,
  bool_or(treatment = 'REVERSES' AND s.court_level = t.court_level) AS beside, bool_or(treatment = 'DISTINGUISHES') AS criticized FROM c JOIN d s ON s.doc_id = src JOIN d t ON t.doc_id = dst GROUP BY 1)
SELECT doc_id, status, round(doc_id * CASE WHEN decision_authority = 'ibk' THEN 1 WHEN status = 'overruled' THEN 0.3 WHEN status = 'disputed' THEN 0.6 ELSE 1 END, 6)::DOUBLE AS score FROM (SELECT d.*, CASE WHEN dst IS NULL THEN 'unknown' WHEN settled THEN 'superseded_by_ibk' WHEN above AND insisted THEN 'disputed' WHEN above THEN 'overruled' WHEN beside THEN 'conflicting_precedent' WHEN criticized THEN 'criticized' ELSE 'good_law' END AS status FROM d LEFT JOIN f ON dst = doc_id)""")
def _(spark, sf):
    d, c = cited_parts(spark, sf)
    rows = precedent.standing(d, c).join(d.select("doc_id", "decision_authority"), "doc_id")
    return rounded(rows.select("doc_id", "status", judgements.standing_score(F.col("doc_id").cast("double"), F.col("status"), F.col("decision_authority")).alias("score")))


@query("q06_expansion", GRAPH + """, seeds AS (SELECT p_partkey // 200 AS query_id, p_partkey AS doc_id FROM part WHERE p_partkey % 100 = 0),
o AS (SELECT query_id, CASE WHEN min(disposition) = max(disposition) THEN max(disposition) END AS common FROM seeds JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT query_id, dst AS doc_id, treatment = 'REVERSES' OR disposition = 'bozma' AS reversal FROM seeds JOIN d USING (doc_id) JOIN c ON src = doc_id UNION ALL SELECT query_id, src, false FROM seeds JOIN c ON dst = doc_id),
u AS (SELECT query_id, doc_id, bool_or(reversal) AS reversal FROM n WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM seeds) GROUP BY 1, 2)
SELECT query_id, doc_id, CASE WHEN reversal THEN 'reversal_chain' WHEN coalesce(disposition = CASE common WHEN 'onama' THEN 'bozma' WHEN 'bozma' THEN 'onama' WHEN 'kabul' THEN 'red' WHEN 'red' THEN 'kabul' END, false) THEN 'opposing_disposition' ELSE 'citation_neighbor' END AS expansion_reason FROM u JOIN d USING (doc_id) JOIN o USING (query_id)
UNION ALL SELECT query_id, doc_id, 'seed' FROM seeds""")
def _(spark, sf):
    d, c = cited_parts(spark, sf)
    s = d.where("doc_id % 100 = 0").select(F.expr("doc_id div 200").alias("query_id"), "doc_id")
    return precedent.opposing_expansion(s, c, d)


CHUNKS = SCORED.rstrip(",\n")
HELD = "h AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 2 AS court, vec_id % 3 AS daire, vec_id % 5 AS decision_date, ['bozma', 'direnme', 'onama'][vec_id % 7 % 3 + 1] AS disposition FROM embeddings)"


def held(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").select(i.alias("doc_id"), F.col("embedding").alias("vector"), (i % 2).alias("court"), (i % 3).alias("daire"), (i % 5).alias("decision_date"), picked(i % 7, ["bozma", "direnme", "onama"]).alias("disposition"))


def chunk_run(spark: SparkSession, sf: str) -> DataFrame:
    return chunks25(spark, sf).select("query_id", "rank", F.col("chunk_id").alias("doc_id"))


@query("q15_conflicts", CHUNKS + ", " + HELD + """, p AS (SELECT a.query_id, x.doc_id AS doc_a, y.doc_id AS doc_b, list_cosine_similarity(x.v, y.v) AS similarity, x.court AS c1, y.court AS c2, x.daire AS d1, y.daire AS d2, x.decision_date AS t1, y.decision_date AS t2, x.disposition AS o1, y.disposition AS o2
  FROM chunks a JOIN chunks b USING (query_id) JOIN h x ON x.doc_id = a.chunk_id JOIN h y ON y.doc_id = b.chunk_id WHERE a.rank <= 10 AND b.rank <= 10 AND a.chunk_id < b.chunk_id)
SELECT query_id, doc_a, doc_b, round(similarity, 6) AS similarity, k AS conflict_type FROM (SELECT *, CASE WHEN least(o1, o2) = 'bozma' AND greatest(o1, o2) = 'direnme' THEN 'bozma_direnme' WHEN o1 = o2 THEN NULL WHEN c1 = c2 AND d1 <> d2 THEN 'inter_daire' WHEN c1 = c2 AND d1 = d2 AND t1 <> t2 THEN 'temporal' END AS k FROM p WHERE similarity > 0.2) WHERE k IS NOT NULL""")
def _(spark, sf):
    return rounded(precedent.conflicts(chunk_run(spark, sf), held(spark, sf), 0.2))


@query("q06_diversity", CHUNKS + ", " + HELD + " SELECT query_id, count(DISTINCT disposition) AS diversity FROM chunks JOIN h ON h.doc_id = chunk_id WHERE rank <= 10 GROUP BY 1")
def _(spark, sf):
    return precedent.diversity(chunk_run(spark, sf), held(spark, sf))


@query("q11_authority_ndcg", TOP_DOCS + ", " + GOLD + """, w AS (SELECT *, 1 + doc_id % 5 / 5.0::DOUBLE AS w FROM gold), ideal AS (SELECT query_id, (2.0 ** grade - 1) * w AS g, row_number() OVER (PARTITION BY query_id ORDER BY (2.0 ** grade - 1) * w DESC, doc_id) AS i FROM w),
want AS (SELECT query_id, sum(g / log2(i + 1)) AS best FROM ideal WHERE i <= 10 GROUP BY 1), got AS (SELECT query_id, sum((2.0 ** coalesce(grade, 0) - 1) * coalesce(w, 1) / log2(rank + 1)) AS dcg FROM top LEFT JOIN w USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg_at_10 FROM want JOIN got USING (query_id)""")
def _(spark, sf):
    g = gold(spark, sf).withColumn("w", 1 + F.col("doc_id") % 5 / F.lit(5.0))
    return rounded(evaluate.per_query(top_documents(spark, sf), g, weight="w").select("query_id", "ndcg_at_10"))


TEMPLATES = [("Q001", 3, "directly on point", "a", 0, 5), ("Q001", 2, "related", "b", 2, 10), ("Q002", 0, "same branch", "b", 0, 3)]
GROUPS = [("a", "court", ["#1"]), ("a", "daire", ["PROMO", "SMALL"]), ("b", "court", ["#2", "#3"])]


@query("x09_candidates", "WITH m AS (SELECT p_partkey AS doc_id, lower(p_brand) AS court, lower(p_type) AS daire FROM part WHERE p_partkey % 11 <> 0), k AS (SELECT 'a' AS cluster, doc_id FROM m WHERE contains(court, '#1') AND (contains(daire, 'promo') OR contains(daire, 'small')) UNION ALL SELECT 'b', doc_id FROM m WHERE contains(court, '#2') OR contains(court, '#3')), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) - 1 AS place FROM k), t AS " + values(TEMPLATES, "query_id, relevance, rationale, cluster, first, most") + " SELECT query_id, doc_id, max(relevance) AS relevance, arg_max(rationale, relevance) AS rationale FROM t JOIN p USING (cluster) WHERE place >= first AND place < first + most GROUP BY 1, 2")
def _(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("court"), F.col("p_type").alias("daire"), (F.col("p_partkey") % 11 == 0).alias("excluded"))
    return precedent.candidate_gold(m, inline(spark, TEMPLATES, "query_id string, relevance int, rationale string, cluster string, first int, most int"), inline(spark, GROUPS, "cluster string, field string, words array<string>"))


def extracted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A gold and a result record of every document; every third result has another court, every fifth is missing."""
    d = table(spark, sf, "documents")
    number = F.concat(F.lit("2020/"), "doc_id")
    record = lambda court: F.to_json(F.struct(court.alias("court_type"), number.alias("case_number"), F.lit(True).alias("is_final"), F.array("lang", "source").alias("keywords"), F.col("text").alias("summary")))
    gold_records = d.select(F.col("doc_id").cast("string").alias("file"), record(F.col("lang")).alias("record"))
    results = d.where("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("file"), record(F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("lang"))).alias("record"))
    return gold_records, results


# All weights together are 30; the wrong court type costs its weight of 1.
@query("e09_file_scores", "SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN round(1 - 1.0 / " + str(sum(w for _, w in scoring.FIELDS.values())) + ", 4) ELSE 1.0::DOUBLE END AS overall FROM documents WHERE doc_id % 5 <> 0")
def _(spark, sf):
    return scoring.by_file(scoring.scored(*extracted(spark, sf)))


@query("e10_score_summary", "WITH s AS (SELECT doc_id % 5 <> 0 AS there, CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN round(1 - 1.0 / " + str(sum(w for _, w in scoring.FIELDS.values())) + ", 4) ELSE 1.0::DOUBLE END AS overall FROM documents) SELECT count(*) AS files_in_gold, count(*) FILTER (there) AS files_in_result, count(*) FILTER (there) AS files_scored, round(count(*) FILTER (there) / count(*), 4) AS coverage, round(avg(overall) FILTER (there), 4) AS mean_scored, round(sum(overall) FILTER (there) / count(*), 4) AS mean_missing_as_zero FROM s")
def _(spark, sf):
    g, r = extracted(spark, sf)
    return scoring.summary(g, r, scoring.scored(g, r))


@query("j13_unpaired", "SELECT CAST(doc_id AS VARCHAR) AS file, 'missing_in_result' AS side FROM documents WHERE doc_id % 5 = 0")
def _(spark, sf):
    return scoring.unpaired(*extracted(spark, sf))


@query("p20_remap", "WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(list_transform(a, lambda x: CASE WHEN x % 4 = 0 THEN -x ELSE x END), ',') AS docs FROM o")
def _(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("docs"))  # a customer's orders, a bounded list
    return tables.remapped("docs", o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("old"), (-F.col("o_orderkey")).alias("new")), rows, "o_custkey").select("o_custkey", F.array_join("docs", ",").alias("docs"))


@query("k08_merge_nodes", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS last, arg_min(o_totalprice, o_orderkey) AS first FROM orders GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    last = tables.merge_nodes(o, "o_custkey", F.col("o_orderkey")).select("o_custkey", F.col("o_totalprice").alias("last"))
    return last.join(tables.merge_nodes(o, "o_custkey", F.col("o_orderkey"), "first").select("o_custkey", F.col("o_totalprice").alias("first")), "o_custkey")


@query("k02_chunk_upsert", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'new' END AS lang, source FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    fresh = d.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", F.lit("new").alias("lang"), F.lit("ignored").alias("source"))
    return tables.upsert(d, fresh, ["doc_id"], only=["lang"])


@query("s08_download_status", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'wanted' END AS status FROM documents")
def _(spark, sf):
    return tables.with_status(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("s09_metadata_lookup", "SELECT lang AS filename, arg_max(source, doc_id) AS source FROM documents WHERE lang IN (SELECT lang FROM documents) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("filename"), "source", F.col("doc_id").alias("seq"))
    return files.metadata_lookup(d, d.select("filename"), ["source"])


@query("s03_fallback_read", "SELECT doc_id AS filename, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source END AS text FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("filename", F.col("doc_id"))
    return files.with_fallback(d.select("filename"), d.where("doc_id % 3 = 0").select("filename", "text"), d.where("doc_id % 3 = 1").select("filename", F.col("source").alias("text")))


@query("k16_run_file", SCORED.rstrip(",\n") + " SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS retrieved_docs FROM chunks GROUP BY 1")
def _(spark, sf):
    return files.run_file(chunk_run(spark, sf)).select("query_id", F.array_join("retrieved_docs", ",").alias("retrieved_docs"))


@query("a08_resolution_rate", "SELECT count(*) AS total, round(100.0 * avg((doc_id IN (SELECT doc_id FROM labels))::INT), 6) AS rate FROM documents")
def _(spark, sf):
    d, done = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    return rounded(resolve.resolution_rate(d.join(done, "doc_id", "left_semi"), d.join(done, "doc_id", "left_anti")))


@query("a13_verification_totals", "WITH f AS (SELECT l_orderkey, count(*) FILTER (l_linenumber % 3 <> 0) AS v, count(*) FILTER (l_linenumber % 3 = 0) AS h FROM lineitem GROUP BY 1) SELECT count(*) AS files, CAST(sum(v) AS BIGINT) AS verified, CAST(sum(h) AS BIGINT) AS hallucinated, count(*) FILTER (h > 0) AS files_with_hallucinations FROM f")
def _(spark, sf):
    return records.verification_totals(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") % 3 != 0).alias("verified")))


@query("a14_outcomes", "SELECT event_type AS stage, CASE user_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' WHEN 2 THEN 'invalid_json' ELSE 'error' END AS status, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return records.outcomes(table(spark, sf, "events").select(F.col("event_type").alias("stage"), picked(F.col("user_id"), ["ok", "truncated", "invalid_json", "error"]).alias("status")))


@query("l02_settings", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cli' WHEN doc_id % 3 = 1 THEN lang ELSE source END AS setting FROM documents")
def _(spark, sf):
    k = F.col("doc_id") % 3
    d = table(spark, sf, "documents").select("doc_id", F.when(k == 0, "cli").when(k == 1, "").alias("cli"), F.when(k == 2, "").otherwise(F.col("lang")).alias("stage"), F.col("source").alias("whole"))
    return d.select("doc_id", records.resolved_setting("cli", "stage", "whole").alias("setting"))


@query("l05_merge", """SELECT CAST(doc_id AS VARCHAR) AS stem, '{"file":"' || doc_id || '.md","court":"' || lang || '","is_final":true' || CASE WHEN doc_id % 2 = 0 THEN ',"summary":"' || source || '"' ELSE '' END || '}' AS record FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("stem"), "doc_id", "lang", "source")
    row = lambda stage, *fields: (F.lit(stage).alias("stage"), F.lit("ok").alias("status"), F.to_json(F.struct(*fields)).alias("payload"), F.lit(None).cast("string").alias("raw"))
    one = d.select("stem", *row("metadata", F.col("lang").alias("court"), F.lit(True).alias("is_final"), F.lit("dropped").alias("summary")))
    two = d.where("doc_id % 2 = 0").select("stem", *row("summary", F.col("source").alias("summary")))
    return records.merged(one.union(two)).select("stem", "record")


LAWS_CITED = [("f", 0, "Türk Borçlar Kanunu", "6098", True), ("f", 1, "Kişisel Verilerin Korunması Kanunu", "6698", False), ("f", 2, "Türk Ceza Kanunu", "5237", False), ("f", 3, "Türk Medeni Kanunu", None, False), ("f", 4, "Hukuk Muhakemeleri Kanunu", None, True)]
LAW_TABLE = [("Türk Borçlar Kanunu", ["TBK"], "6098"), ("Kişisel Verilerin Korunması Kanunu", ["KVKK"], "6698"), ("Türk Ceza Kanunu", ["TCK"], "5237"), ("Türk Medeni Kanunu", ["MK"], "4721"), ("Hukuk Muhakemeleri Kanunu", ["HMK"], "6100")]


@query("l08_verify_laws", "SELECT CAST(doc_id AS VARCHAR) AS file, index, verified FROM documents, " + values([r[1:] for r in LAWS_CITED], "index, law, law_number, verified"))
def _(spark, sf):
    """Five claims on every document, checked against its whole text behind a passage that settles them."""
    source = "Dosya 2019/366. 6098 sayılı TBK'nun 52.maddesi ve 6100 sayılı HMK.nun 341/1, 160980 sayılı "
    claims = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(a).cast("string").alias("law"), F.lit(n).cast("string").alias("law_number")) for _, i, a, n, _ in LAWS_CITED])
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit(source), F.coalesce("text", F.lit(""))).alias("text"))
    return records.check_laws(d.select("file", F.explode(claims).alias("c")).select("file", "c.*"), d, inline(spark, LAW_TABLE, "law string, abbreviations array<string>, number string")).select("file", "index", "verified")


@query("l09_cleaned", "SELECT o_custkey AS file, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_orderkey % 3 <> 0), '') AS kept FROM orders GROUP BY 1")
def _(spark, sf):
    r = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("cited"))
    checks = r.select("file", F.posexplode("cited").alias("index", "key")).select("file", "index", (F.col("key") % 3 != 0).alias("verified"))
    return records.cleaned(r, checks, "cited").select("file", F.array_join("kept", ",").alias("kept"))


@query("e08_gold_checks", "WITH " + GOLD + """, g AS (SELECT *, ['hukuk', 'ceza', 'idari'][query_id // 100 % 3 + 1] AS law_branch, doc_id % 7 AS court FROM gold), q AS (SELECT query_id, max(grade) AS top, min(grade) AS low FROM g GROUP BY 1)
SELECT * FROM (SELECT 'queries' AS "check", 'error' AS level, count(*) >= 50 AS ok FROM q UNION ALL SELECT 'branches', 'error', count(DISTINCT law_branch) FILTER (law_branch IN ('hukuk', 'anayasa')) = 2 FROM g UNION ALL SELECT 'courts', 'warning', count(DISTINCT court) >= 5 FROM g
UNION ALL SELECT 'contradictory', 'warning', count(*) FILTER (query_id // 100 % 2 = 1) >= 10 FROM q UNION ALL SELECT 'relevant', 'error', count(*) FILTER (top < 2) = 0 FROM q UNION ALL SELECT 'hard_negatives', 'warning', count(*) FILTER (low > 0) = 0 FROM q UNION ALL SELECT 'references', 'error', count(*) FILTER (doc_id = 7) = 0 FROM g)""")
def _(spark, sf):
    block = F.expr("query_id div 100")
    g = gold(spark, sf).select("*", picked(block, ["hukuk", "ceza", "idari"]).alias("law_branch"), (F.col("doc_id") % 7).alias("court"), (block % 2).alias("n_pairs"))
    manifest = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") == 7).alias("excluded"))
    return evaluate.gold_checks(g, manifest, ["hukuk", "anayasa"])
