"""Registered queries over the test tables, each with the DuckDB SQL that must give the same rows.

The tables stand in for the domain's: ``embeddings`` for chunk vectors (document = vec_id % 50, queries are the ids
divisible by 100), ``part`` for documents of a graph whose edges join the parts of neighbouring lines of an order, ``label`` for
relevance.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions import courts, keys, text
from dokuma.operators import evaluate, extract, graph, graph_build, records, resolve, retrieve, search, tables
from dokuma.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 50).alias("doc_id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def chunks25(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.dense_topk(asked(spark, sf), vectors(spark, sf), 25)


def values(rows: list[tuple], columns: str) -> str:
    show = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + f") t({columns}))"


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return rows.where("dst IS NOT NULL AND src <> dst")


SCORED = """WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.vec_id % 50 AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
chunks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 25),
"""
EDGES = """edges AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


def documents_sql(agg: str) -> str:
    return SCORED + f"""docs AS (SELECT query_id, doc_id, {agg} AS s, min(rank) AS first FROM chunks GROUP BY ALL)
SELECT query_id, doc_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, first, doc_id) AS INTEGER) AS rank FROM docs QUALIFY rank <= 5"""


def by_strategy(name: str) -> Callable:
    return lambda spark, sf: rounded(retrieve.to_documents(chunks25(spark, sf), name, 5))


query("r03_dense_topk", documents_sql("greatest(max(score), 0)"))(by_strategy("max"))
query("a02_mean", documents_sql("avg(score)"))(by_strategy("mean"))
query("a03_combsum", documents_sql("sum(score)"))(by_strategy("combsum"))


@query("r03_chunks", SCORED.rstrip(",\n") + " SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM chunks")
def _(spark, sf):
    return rounded(chunks25(spark, sf))


def top_documents(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return retrieve.to_documents(chunks25(spark, sf), "max", k)


TOP_DOCS = SCORED + """dense AS (SELECT query_id, doc_id, greatest(max(score), 0) AS score, min(rank) AS first FROM chunks GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc_id) AS rank FROM dense QUALIFY rank <= 10)
"""


@query("r10_dense_only", TOP_DOCS + "SELECT query_id, doc_id, round(CASE WHEN max(score) OVER q > 0 THEN score / max(score) OVER q ELSE 0 END, 6) AS score, 0.0::DOUBLE AS graph_score FROM top WINDOW q AS (PARTITION BY query_id)")
def _(spark, sf):
    return rounded(retrieve.dense_only(top_documents(spark, sf)))


@query("r09_fusion", TOP_DOCS + """, low AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM top GROUP BY 1),
d AS (SELECT query_id, doc_id, (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS dense FROM top JOIN low USING (query_id)),
g AS (SELECT vec_id AS query_id, d AS doc_id, (d % 7) / 7.0::DOUBLE AS graph FROM embeddings, range(12) u(d) WHERE vec_id % 100 = 0)
SELECT query_id, doc_id, round(coalesce(dense, 0), 6) AS dense_norm, round(coalesce(graph, 0), 6) AS graph_score, round(0.7 * coalesce(dense, 0) + 0.3 * coalesce(graph, 0), 6) AS score, dense IS NOT NULL AS is_seed
FROM d FULL OUTER JOIN g USING (query_id, doc_id)""")
def _(spark, sf):
    g = asked(spark, sf).select("query_id", F.explode(F.expr("sequence(0L, 11L)")).alias("doc_id")).withColumn("graph", (F.col("doc_id") % 7) / F.lit(7.0))
    return rounded(retrieve.fuse_graph(top_documents(spark, sf), g))


@query("q02_rrf", TOP_DOCS + """, other AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM top)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM top UNION ALL SELECT query_id, doc_id, rank FROM other) GROUP BY ALL""")
def _(spark, sf):
    from pyspark.sql import Window

    top = top_documents(spark, sf)
    other = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return rounded(retrieve.reciprocal_ranks(top, other))


@query("q09_q10_boosts", TOP_DOCS + "SELECT query_id, doc_id, round(0.8 * score + 0.2 * (doc_id / 50), 6) AS by_rank, round(score * (1 + 0.1 * (doc_id % 6) / 5), 6) AS by_level FROM top")
def _(spark, sf):
    top = top_documents(spark, sf)
    return rounded(top.select("query_id", "doc_id", retrieve.boosted(F.col("score"), F.col("doc_id") / 50).alias("by_rank"), retrieve.level_boost(F.col("score"), F.col("doc_id") % 6).alias("by_level")))


@query("q13_filtered_topk", """WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, v.vec_id % 50 AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label >= 5)
SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10""")
def _(spark, sf):
    return rounded(retrieve.dense_topk(asked(spark, sf), vectors(spark, sf).where("label >= 5"), 10))


@query("a05_degrees", "WITH " + EDGES + """ SELECT p_partkey AS doc_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM part
LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON dst = p_partkey LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON src = p_partkey""")
def _(spark, sf):
    return graph.degrees(nodes(spark, sf), edges(spark, sf))


SEEDS = "seeds AS (SELECT p_partkey // 200 AS query_id, p_partkey AS doc_id FROM part WHERE p_partkey % 100 = 0)"


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).where("doc_id % 100 = 0").select(F.expr("doc_id div 200").alias("query_id"), "doc_id")


@query("j17_neighbours", "WITH " + EDGES + ", " + SEEDS + """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT DISTINCT query_id, dst AS doc_id FROM seeds JOIN both_ways ON src = doc_id), two AS (SELECT DISTINCT query_id, dst AS doc_id FROM one JOIN both_ways ON src = doc_id)
SELECT query_id, doc_id FROM (SELECT * FROM one UNION SELECT * FROM two) EXCEPT SELECT query_id, doc_id FROM seeds""")
def _(spark, sf):
    return graph.neighbours(seeds(spark, sf), edges(spark, sf), 2)


@query("j18_induced", "WITH " + EDGES + """, c AS (SELECT p_partkey % 3 AS query_id, p_partkey AS doc_id FROM part)
SELECT DISTINCT a.query_id, src, dst FROM edges JOIN c a ON a.doc_id = src JOIN c b ON b.doc_id = dst AND a.query_id = b.query_id""")
def _(spark, sf):
    c = nodes(spark, sf).select((F.col("doc_id") % 3).alias("query_id"), "doc_id")
    return graph.induced(c, edges(spark, sf))


def rank_sql(weight: str = "1.0::DOUBLE") -> str:
    return "WITH RECURSIVE " + EDGES + f""", pairs AS (SELECT src, dst, max({weight}) AS w FROM edges GROUP BY 1, 2), total AS (SELECT src, sum(w) AS t FROM pairs GROUP BY 1 HAVING sum(w) > 0),
links AS (SELECT src, dst, w / t AS share FROM pairs JOIN total USING (src)), n AS (SELECT count(*) AS n FROM part), dangling AS (SELECT p_partkey AS doc_id FROM part WHERE p_partkey NOT IN (SELECT src FROM links)),
pr(it, doc_id, score, was) AS (SELECT 0, p_partkey, 1.0::DOUBLE / n, 2.0::DOUBLE FROM part, n
  UNION ALL SELECT l.it + 1, p_partkey, 0.15::DOUBLE / n + 0.85 * (coalesce(got, 0) + lost / n), p.score FROM part, n,
    (SELECT max(it) AS it, sum(abs(score - was)) AS moved, coalesce(sum(score) FILTER (doc_id IN (SELECT doc_id FROM dangling)), 0) AS lost FROM pr) l
    LEFT JOIN (SELECT dst, sum(score * share) AS got FROM pr JOIN links ON src = doc_id GROUP BY 1) ON dst = p_partkey JOIN pr p ON p.doc_id = p_partkey WHERE l.it < 100 AND moved >= n * 1e-6)
SELECT doc_id, round(score / max(score) OVER (), 6) AS score FROM pr WHERE it = (SELECT max(it) FROM pr)"""


@query("r12_pagerank", rank_sql())
def _(spark, sf):
    return rounded(graph.pagerank(nodes(spark, sf), edges(spark, sf)))


@query("q14_weighted_pagerank", rank_sql("(CASE (src + dst) % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 1.5 WHEN 2 THEN 0.0 WHEN 3 THEN 0.5 ELSE 1.0 END)::DOUBLE"))
def _(spark, sf):
    kind = (F.col("src") + F.col("dst")) % 5
    weight = F.when(kind <= 1, 1.5).when(kind == 2, 0.0).when(kind == 3, 0.5).otherwise(1.0)
    return rounded(graph.pagerank(nodes(spark, sf), edges(spark, sf), weight=weight))


@query("q18_components", "WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id // 2 * 2 AS b FROM documents UNION SELECT doc_id, doc_id // 3 * 3 FROM documents WHERE doc_id % 4 = 0), both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), "
       "r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM r JOIN both_ways ON a = doc_id WHERE c < b) SELECT doc_id, min(c) AS component FROM r GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    e = d.select(F.col("doc_id").alias("src"), (F.col("doc_id") - F.col("doc_id") % 2).alias("dst")).union(d.where("doc_id % 4 = 0").select("doc_id", (F.col("doc_id") - F.col("doc_id") % 3)))
    return graph.components(d, e.where("src <> dst"))


@query("r08_personal_pagerank")
def _(spark, sf):
    s = seeds(spark, sf)
    return rounded(graph.personal_pagerank(s.union(graph.neighbours(s, edges(spark, sf))), s, edges(spark, sf)))


@query("r11_search")
def _(spark, sf):
    """Dense retrieval, expansion over the graph, personalised PageRank, fusion: one plan for all queries."""
    e = lambda: edges(spark, sf).select((F.col("src") % 50).alias("src"), (F.col("dst") % 50).alias("dst")).where("src <> dst AND src % 5 = dst % 5")
    return rounded(search.search(top_documents(spark, sf, 30), e, k=10))


@query("r11_without_graph", TOP_DOCS + """, s AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER q > 0 THEN score / max(score) OVER q ELSE 0 END AS score FROM top WINDOW q AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(score, 6) AS score, 0.0::DOUBLE AS graph_score, 'dense' AS mode, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s""")
def _(spark, sf):
    """The graph's table is not there: the dense scores stand alone."""
    missing = lambda: spark.read.parquet(f"{sf}/no_such_edges.parquet")
    return rounded(search.search(top_documents(spark, sf), missing, k=10))


GOLD = """gold AS (SELECT q.vec_id AS query_id, v.vec_id % 50 AS doc_id, max(CASE WHEN v.label = q.label THEN 3 WHEN v.label = (q.label + 1) % 10 THEN 1 ELSE 0 END) AS grade FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)"""


def gold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    grade = F.when(F.col("label") == F.col("wanted"), 3).when(F.col("label") == (F.col("wanted") + 1) % 10, 1).otherwise(0)
    return retrieve.pairs(q, e.withColumnRenamed("vec_id", "chunk_id")).groupBy("query_id", (F.col("chunk_id") % 50).alias("doc_id")).agg(F.max(grade).alias("grade"))


METRICS_SQL = TOP_DOCS + ", " + GOLD + """, seen AS (SELECT t.query_id, t.rank, t.doc_id, coalesce(grade, 0) AS grade FROM top t LEFT JOIN gold USING (query_id, doc_id)),
ideal AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM gold),
want AS (SELECT query_id, count(*) FILTER (grade >= 1) AS n, sum(CASE WHEN i <= 5 THEN (2.0 ** grade - 1) / log2(i + 1) ELSE 0 END) AS i5, sum(CASE WHEN i <= 10 THEN (2.0 ** grade - 1) / log2(i + 1) ELSE 0 END) AS i10 FROM ideal GROUP BY 1),
got AS (SELECT query_id, count(DISTINCT doc_id) FILTER (grade >= 1 AND rank <= 5) AS n5, count(DISTINCT doc_id) FILTER (grade >= 1 AND rank <= 10) AS n10, count(DISTINCT doc_id) FILTER (grade >= 1 AND rank <= 20) AS n20,
  sum(CASE WHEN rank <= 5 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN (2.0 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS d10, min(rank) FILTER (grade >= 1) AS first FROM seen GROUP BY 1),
m AS (SELECT query_id, CASE WHEN n > 0 THEN n5 / n ELSE 0 END AS recall_at_5, CASE WHEN n > 0 THEN n10 / n ELSE 0 END AS recall_at_10, CASE WHEN n > 0 THEN n20 / n ELSE 0 END AS recall_at_20,
  CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END AS ndcg_at_5, CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END AS ndcg_at_10, coalesce(1.0::DOUBLE / first, 0) AS mrr, (n5 > 0)::INT::DOUBLE AS hit_rate_at_5 FROM want JOIN got USING (query_id))
"""
SEVEN = ("recall_at_5", "recall_at_10", "recall_at_20", "ndcg_at_5", "ndcg_at_10", "mrr", "hit_rate_at_5")


@query("e05_metrics", METRICS_SQL + "SELECT query_id, " + ", ".join(f"round({m}, 6) AS {m}" for m in SEVEN) + " FROM m")
def _(spark, sf):
    return rounded(evaluate.per_query(top_documents(spark, sf), gold(spark, sf)))


@query("a10_macro", METRICS_SQL + "SELECT count(*) AS queries, " + ", ".join(f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in SEVEN) + " FROM m")
def _(spark, sf):
    return rounded(evaluate.macro(evaluate.per_query(top_documents(spark, sf), gold(spark, sf))))


@query("e06_compare", METRICS_SQL + """, o AS (SELECT query_id, ndcg_at_10 * (query_id // 100 % 3) / 2 AS x FROM m WHERE query_id <> 300), c AS (SELECT query_id, coalesce(ndcg_at_10, 0) AS a, coalesce(x, 0) AS b FROM m FULL OUTER JOIN o USING (query_id))
SELECT query_id, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta, CASE WHEN b - a < -1e-4 THEN 'REGRESSED' WHEN b - a > 1e-4 THEN 'improved' ELSE 'unchanged' END AS status FROM c""")
def _(spark, sf):
    a = evaluate.per_query(top_documents(spark, sf), gold(spark, sf))
    b = a.where("query_id <> 300").withColumn("ndcg_at_10", F.col("ndcg_at_10") * F.expr("query_id div 100 % 3") / 2)
    return rounded(evaluate.compare(a, b))


@query("a11_latency", "WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) "
       "SELECT event_type, round(max(value) FILTER (i = floor(n * 0.5)), 6) AS p50, round(max(value) FILTER (i = floor(n * 0.95)), 6) AS p95, round(avg(value), 6) AS mean FROM p GROUP BY 1")
def _(spark, sf):
    return rounded(evaluate.latency(table(spark, sf, "events"), "event_type", "value"))


@query("a12_separation", "WITH p AS (SELECT a.label = b.label AS related, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "
       "SELECT round(avg(s) FILTER (related), 6) AS related, round(avg(s) FILTER (NOT related), 6) AS unrelated, round(avg(s) FILTER (related) - avg(s) FILTER (NOT related), 6) AS separation, avg(s) FILTER (related) - avg(s) FILTER (NOT related) > 0.05 AS good FROM p")
def _(spark, sf):
    from dokuma.functions.vectors import cosine

    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    return rounded(evaluate.separation(e.join(b, "vec_id").select((F.col("label") == F.col("other_label")).alias("related"), cosine(F.col("embedding"), F.col("other")).alias("score"))))


@query("a17_best_run", "SELECT event_type AS run_id, round(avg(value), 6) AS metric FROM events GROUP BY 1 ORDER BY avg(value) DESC, 1 LIMIT 1")
def _(spark, sf):
    return rounded(evaluate.best_run(table(spark, sf, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.avg("value").alias("metric")), "metric"))


@query("a07_frequencies", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a06_token_counts", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean FROM (SELECT doc_id, len(string_split_regex(text, '[ \\n]+')) AS t FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "[ \\n]+")).cast("long").alias("t"))
    return rounded(d.agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.min("t").alias("least"), F.max("t").alias("most"), F.avg("t").alias("mean")))


@query("a09_top_cited", "WITH " + EDGES + " SELECT p_brand, p_type, count(*) AS n FROM edges JOIN part ON dst = p_partkey GROUP BY ALL ORDER BY n DESC, p_brand, p_type LIMIT 10")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("dst"), "p_brand", "p_type")
    return edges(spark, sf).join(p, "dst").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand", "p_type").limit(10)


@query("x06_token_windows", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 128) / 96), 0) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 96 + 1 : i * 96 + 128], ' ') AS text, CAST(len(w[i * 96 + 1 : i * 96 + 128]) AS INTEGER) AS token_count FROM e""")
def _(spark, sf):
    return extract.token_windows(table(spark, sf, "documents"), 128, 32)


@query("x05_sentence_chunks")
def _(spark, sf):
    return extract.chunk(table(spark, sf, "documents"), 256, 32)


LAWS_TAIL = " TBK m.49/1 ve CMK m.53/1-a; HMK m.100, f.2, 5237 sayılı Kanun m.5. TCK'nın 302. maddesi, Anayasa'nın 13. maddesi."
LAW_ROWS = [("TBK", 6098, 49, 1, None, "TBK m.49/1"), ("CMK", 5271, 53, 1, "a", "CMK m.53/1-a"), ("HMK", 6100, 100, 2, None, "HMK m.100, f.2"), ("TCK", 5237, 302, None, None, "TCK'nın 302. maddes"), ("TCK", 5237, 5, None, None, "5237 sayılı Kanun m.5"), ("AY", 2709, 13, None, None, "Anayasa'nın 13. maddes")]


@query("x04_law_references", "WITH l AS " + values([(*r, LAWS_TAIL.index(r[-1])) for r in LAW_ROWS], "law_code, law_no, article, paragraph, subparagraph, raw_text, place") + ", d AS (SELECT doc_id, text || '" + LAWS_TAIL.replace("'", "''") + """' AS body, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, law_code, law_no, article, coalesce(paragraph, 0) AS paragraph, coalesce(subparagraph, '') AS subparagraph, raw_text, regexp_replace(substr(body, greatest(n + place - 80, 0) + 1, n + place + 80 - greatest(n + place - 80, 0)), '^\\s+|\\s+$', '', 'g') AS snippet FROM d, l""")
def _(spark, sf):
    return extract.extract_laws(table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(LAWS_TAIL)).alias("text"))).fillna(0, ["paragraph"]).fillna("", ["subparagraph"])


@query("q01_bm25", """WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS length FROM p GROUP BY 1), whole AS (SELECT count(*) AS n, avg(length) AS mean FROM l), q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'thanded'), (2, 'que'), (2, 'de'), (3, 'und')) t(query_id, term)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), whole GROUP BY ALL""")
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    q = inline(spark, [(1, "the"), (1, "thanded"), (2, "que"), (2, "de"), (3, "und")], "query_id int, term string")
    return rounded(retrieve.bm25(q, words.withColumn("tf", F.lit(1))))


@query("f02_keys", "SELECT doc_id, substr(sha256(trim(lang) || '|' || trim(source) || '|' || doc_id || '|' || n_chars), 1, 16) AS id, substr(sha256(doc_id || '|0'), 1, 16) AS chunk_id, substr(sha256(doc_id || '|' || lang || '|' || source), 1, 16) AS citation_id FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    number, chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    return d.select("doc_id", keys.document_id(F.col("lang"), F.col("source"), number, chars).alias("id"), keys.chunk_id(number, F.lit(0)).alias("chunk_id"), keys.citation_id(number, F.col("lang"), F.col("source")).alias("citation_id"))


NAMES = ["Yargıtay 2. Hukuk Dairesi", "İSTANBUL Bölge Adliye Mahkemesi 4. Ceza Dairesi", "Danıştay İdari Dava Daireleri Kurulu", "Fikrî ve Sınaî Haklar", "Ankara Bölge İdare Mahkemesi", "", "IĞDIR Ağır Ceza"]


@query("f01_chamber_key", "WITH named AS (SELECT doc_id, n || ' ' || coalesce(lang, '') || doc_id AS name FROM documents JOIN " + values(list(enumerate(NAMES)), "k, n") + f""" ON k = doc_id % {len(NAMES)})
SELECT doc_id, replace(replace(replace(regexp_replace(translate(lower(translate(name, 'İIÇĞÖŞÜ', 'iıçğöşü')), 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', '', 'g'), 'bolgeadliyemahkemesi', 'bam'), 'bolgeidaremahkemesi', 'bim'), 'idari', 'idare') AS key FROM named""")
def _(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int")), F.lit(" "), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", text.chamber_key(name).alias("key"))


COURTS = [("AYM", ""), ("Danıştay", "5. Daire"), ("BİM", "1. VDD"), ("İlk Derece", "3. İdare Mahkemesi"), ("İlk Derece", "2. Ağır Ceza"), ("İlk Derece", "1. Aile"), ("BAM", "4. Ceza Dairesi"), ("BAM", "İstanbul BAM 2. Hukuk Dairesi"), ("Yargıtay", "CGK"), ("Yargıtay", "11. Hukuk Dairesi"), ("Sayıştay", "1. Daire"), ("AİHM", ""), ("", "")]


@query("p02_p03_court_rules", "WITH c AS (SELECT doc_id, court, chamber FROM documents JOIN " + values([(i, *c) for i, c in enumerate(COURTS)], "k, court, chamber") + f" ON k = doc_id % {len(COURTS)})" + """ SELECT doc_id, court, chamber,
CASE WHEN court = 'AYM' THEN 'anayasa' WHEN court IN ('Danıştay', 'BİM') THEN 'idari' WHEN court = 'İlk Derece' AND (contains(chamber, 'İdare') OR contains(chamber, 'Vergi')) THEN 'idari' WHEN contains(chamber, 'Ceza') THEN 'ceza' WHEN court NOT IN ('İlk Derece', 'BAM') AND contains(chamber, 'CGK') THEN 'ceza' ELSE 'hukuk' END AS branch,
CASE court WHEN 'İlk Derece' THEN 1 WHEN 'BAM' THEN 2 WHEN 'BİM' THEN 2 WHEN 'Yargıtay' THEN 3 WHEN 'Danıştay' THEN 3 WHEN 'Sayıştay' THEN 3 WHEN 'AYM' THEN 4 WHEN 'Uyuşmazlık' THEN 4 WHEN 'AİHM' THEN 5 ELSE 0 END AS level,
CASE WHEN regexp_matches(chamber, '^.+? BAM') THEN regexp_extract(chamber, '^(.+?) BAM', 1) || ' BAM' END AS parent FROM c""")
def _(spark, sf):
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("court"), F.lit(b).alias("chamber")) for a, b in COURTS]), (F.col("doc_id") % len(COURTS) + 1).cast("int"))
    c = table(spark, sf, "documents").select("doc_id", pick.alias("c")).select("doc_id", "c.*")
    return c.select("doc_id", "court", "chamber", courts.law_branch(F.col("court"), F.col("chamber")).alias("branch"), courts.court_level(F.col("court")).alias("level"), courts.parent_court(F.col("chamber")).alias("parent"))


@query("p11_substring_filter", "SELECT p_partkey, p_brand, p_type FROM part WHERE (contains(lower(p_brand), '#1') OR contains(lower(p_brand), '#3')) AND contains(lower(p_type), 'promo')")
def _(spark, sf):
    return tables.manifest_rows(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), {"p_brand": ["#1", "#3"], "p_type": ["PROMO"]})


@query("k01_upsert", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(lang), n_chars + 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1000000, lang, n_chars FROM documents WHERE doc_id % 7 = 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 3 = 0").select("doc_id", F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("n_chars")).union(d.where("doc_id % 7 = 0").select(F.col("doc_id") + 1_000_000, "lang", "n_chars"))
    return tables.upsert(d, new, ["doc_id"])


@query("k05_duplicates", "SELECT name, 'duplicate: same legal identity as ' || first AS exclude_reason FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, row_number() OVER w AS r, first(lpad(CAST(doc_id AS VARCHAR), 9, '0')) OVER w AS first FROM documents WINDOW w AS (PARTITION BY lang, n_chars ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0'))) WHERE r > 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.concat_ws("|", "lang", "n_chars").alias("identity"))
    return tables.divert_duplicates(d, "identity", "name")[1]


@query("j06_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return tables.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("s13_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (3, 5, 8, 100000000)")
def _(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(3, 5, 8, 100_000_000)).select("doc_id", "lang", "source")


@query("k09_merge_edges", "WITH " + EDGES + ", n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS seq FROM edges) SELECT src, dst, 'CITES' AS type, max(seq) AS seq FROM n GROUP BY 1, 2")
def _(spark, sf):
    rows = tables.placed(edges(spark, sf), "src", "dst", place="seq")
    return tables.merge_edges(rows.select("src", "dst", F.lit("CITES").alias("type"), "seq"), F.col("seq"))


@query("j12_id_map", "SELECT doc_id, coalesce(item_id, doc_id) AS mapped FROM documents LEFT JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) * 3 AS k FROM benchmark) ON k = doc_id")
def _(spark, sf):
    b = tables.placed(table(spark, sf, "benchmark").select("item_id"), "item_id").select("item_id", (F.col("place") * 3).alias("doc_id"))
    return table(spark, sf, "documents").select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("item_id", "doc_id").alias("mapped"))


@query("p17_projection", TOP_DOCS + "SELECT query_id, t.doc_id, round(t.score, 4) AS score, coalesce(lang, '') AS branch, coalesce(n_chars, 0) AS size FROM top t LEFT JOIN (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) d USING (doc_id)")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")
    return top_documents(spark, sf).join(d, "doc_id", "left").select("query_id", "doc_id", F.round("score", 4).alias("score"), F.coalesce("lang", F.lit("")).alias("branch"), F.coalesce("n_chars", F.lit(0)).alias("size"))


@query("s16_header", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS header FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.header(F.col("text"), 3).alias("header"))


@query("f14_snippet", "SELECT doc_id, trim(substr(text, greatest(50 - 20, 0) + 1, 40)) AS snippet FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(50), 20).alias("snippet"))


CITED = [(1, "d9", "Yargıtay 2. Hukuk Dairesi", "2019/366", "2021/945"), (2, "d9", "2. Hukuk Dairesi", "2021/945", None), (3, "d1", "Yargıtay 2. Hukuk Dairesi", "2019/366", "2021/945"), (4, "d9", "Yargıtay 3. Hukuk Dairesi", "2010/1", None), (5, "d9", "", "2010/1", None), (6, "d9", "Yargıtay 2. Hukuk Dairesi", None, None), (7, "d9", "Bilinmeyen Kurul", "2010/1", "2010/2"), (8, "d9", "Fikri Haklar Mahkemesi", "2011/7", None), (9, "d9", "2. Hukuk Dairesi", "1999/1", None), (10, "d9", "İzmir Bölge Adliye Mahkemesi", "2020/5", "2020/6"), (11, "d9", "Yargitay 2 Hukuk Dairesi", "2019/366", "1900/1")]
DOCUMENTS = [("d1", "Yargıtay", "2. Hukuk Dairesi", "2019/366", "2021/945"), ("d2", "Yargıtay", "3. Hukuk Dairesi", "2010/1", "2010/9"), ("d3", "Yargıtay", "3. Hukuk Dairesi", "2010/1", "2010/8"), ("d4", "", "Fikrî Haklar Mahkemesi", "2011/7", ""), ("d5", "BAM", "İzmir Bölge Adliye Mahkemesi 4. Ceza Dairesi", "2020/5", "2020/6")]


KEY_SQL = "replace(replace(replace(regexp_replace(translate(lower(translate({0}, 'İIÇĞÖŞÜ', 'iıçğöşü')), 'çğıöşüâîû', 'cgiosuaiu'), '[^a-z0-9]+', '', 'g'), 'bolgeadliyemahkemesi', 'bam'), 'bolgeidaremahkemesi', 'bim'), 'idari', 'idare')"


@query("r14_resolve", "WITH c AS (SELECT k.doc_id * 100 + citation AS citation, source_doc_id || '_' || k.doc_id AS source_doc_id, chamber, case_no || k.doc_id AS case_no, decision_no || k.doc_id AS decision_no FROM documents k, " + values(CITED, "citation, source_doc_id, chamber, case_no, decision_no") + "), d AS (SELECT x.doc_id || '_' || k.doc_id AS doc_id, court, chamber, case_no || k.doc_id AS case_no, CASE WHEN decision_no <> '' THEN decision_no || k.doc_id ELSE '' END AS decision_no FROM documents k, " + values(DOCUMENTS, "doc_id, court, chamber, case_no, decision_no") + " x), k AS (SELECT DISTINCT key, doc_id, t_case, t_dec FROM (SELECT " + KEY_SQL.format("chamber") + " AS key, doc_id, case_no AS t_case, decision_no AS t_dec FROM d UNION ALL SELECT " + KEY_SQL.format("court || ' ' || chamber") + """, doc_id, case_no, decision_no FROM d)), kk AS (SELECT DISTINCT key FROM k), a AS (SELECT *, """ + KEY_SQL.format("chamber") + """ AS nk, list_distinct(list_filter([coalesce(case_no, ''), coalesce(decision_no, '')], lambda x: x <> '')) AS wanted FROM c),
links AS (SELECT DISTINCT nk, key FROM (SELECT DISTINCT nk FROM a WHERE nk <> '') n JOIN kk ON key = nk OR length(nk) >= 5 AND starts_with(key, nk) AND nk NOT IN (SELECT key FROM kk)),
e AS (SELECT citation, source_doc_id, nk, unnest(wanted) AS number FROM a), kn AS (SELECT DISTINCT key, doc_id, unnest([t_case, t_dec]) AS number FROM k),
s AS (SELECT citation, doc_id, count(DISTINCT e.number) AS same FROM e JOIN links USING (nk) JOIN kn ON kn.key = links.key AND kn.number = e.number WHERE doc_id <> source_doc_id GROUP BY 1, 2 QUALIFY same = max(same) OVER (PARTITION BY citation)),
n AS (SELECT citation, count(*) AS n, min(doc_id) AS target, max(same) AS same FROM s GROUP BY 1)
SELECT a.citation, CASE WHEN n.n = 1 THEN target END AS target_doc_id, CASE WHEN n.n = 1 THEN CASE same WHEN 2 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END END AS confidence,
CASE WHEN nk = '' THEN 'no_daire_extracted' WHEN len(wanted) = 0 THEN 'no_esas_or_karar' WHEN nk NOT IN (SELECT nk FROM links) THEN 'daire_not_in_corpus' WHEN n.n IS NULL THEN 'no_ek_match_in_daire' WHEN n.n > 1 THEN 'ambiguous_match' END AS reason FROM a LEFT JOIN n USING (citation)""")
def _(spark, sf):
    """A family of decisions and citations for every document: exact, by prefix, swapped numbers, ambiguous, unknown."""
    c = inline(spark, CITED, "citation int, source_doc_id string, chamber string, case_no string, decision_no string")
    d = inline(spark, DOCUMENTS, "doc_id string, court string, chamber string, case_no string, decision_no string")
    k = table(spark, sf, "documents").select(F.col("doc_id").alias("k"))
    own = lambda x: F.concat(x, F.col("k").cast("string"))
    c = k.join(F.broadcast(c)).select((F.col("k") * 100 + F.col("citation")).alias("citation"), own(F.concat("source_doc_id", F.lit("_"))).alias("source_doc_id"), "chamber", own(F.col("case_no")).alias("case_no"), own(F.col("decision_no")).alias("decision_no"))
    d = k.join(F.broadcast(d)).select(own(F.concat("doc_id", F.lit("_"))).alias("doc_id"), "court", "chamber", own(F.col("case_no")).alias("case_no"), F.when(F.col("decision_no") != "", own(F.col("decision_no"))).otherwise("").alias("decision_no"))
    good, bad = resolve.resolve(c, d)
    return good.select("citation", "target_doc_id", "confidence", F.lit(None).cast("string").alias("reason")).union(bad.select("citation", F.lit(None), F.lit(None), "reason"))


CHECKED = [("f1", 0, "2019/366", None), ("f1", 1, "2018/9999", "2019/1234"), ("f1", 2, None, None), ("f1", 3, "x", "2021/945")]
SOURCE = "Dosya 2019 / 366 Esas, karar 2021/945. 6098 sayılı TBK'nun 52.maddesi ve 6100 sayılı HMK.nun 341/1 hükmü."


@query("l07_verify_decisions", "WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS file, c.* FROM documents, " + values([r[1:] for r in CHECKED], "index, case_number, decision_number") + " c), s AS (SELECT CAST(doc_id AS VARCHAR) AS file, regexp_replace('" + SOURCE.replace("'", "''") + """' || coalesce(text, ''), '[^0-9/]', '', 'g') AS src FROM documents), t AS (SELECT *, coalesce(regexp_replace(case_number, '[^0-9/]', '', 'g'), '') AS a, coalesce(regexp_replace(decision_number, '[^0-9/]', '', 'g'), '') AS b FROM c JOIN s USING (file))
SELECT file, index, (a <> '' AND contains(src, a)) OR (b <> '' AND contains(src, b)) AS verified, CASE WHEN (a <> '' AND contains(src, a)) OR (b <> '' AND contains(src, b)) THEN NULL WHEN a = '' AND b = '' THEN 'citation has no case_number or decision_number to check' ELSE 'neither case_number nor decision_number found in source' END AS reason FROM t""")
def _(spark, sf):
    """Four claims on every document, checked against its whole text."""
    claims = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(a).cast("string").alias("case_number"), F.lit(b).cast("string").alias("decision_number")) for _, i, a, b in CHECKED])
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit(SOURCE), F.coalesce("text", F.lit(""))).alias("text"))
    return records.check_decisions(d.select("file", F.explode(claims).alias("c")).select("file", "c.*"), d).drop("signals")


R15_KINDS = [("Yargıtay", "{n}. Hukuk Dairesi", "hukuk", "Yargıtay", ""), ("Danıştay", "{n}. Daire", "idari", "Danıştay", ""), ("BAM", "İzmir Bölge Adliye Mahkemesi {n}. Ceza Dairesi", "ceza", "İzmir BAM", "Yargıtay"), ("İlk Derece", "Bursa {n}. İş Mahkemesi", "hukuk", "İlk Derece", "")]


def law_graph(spark: SparkSession, sf: str) -> tuple[dict, dict]:
    """The graph of all documents as decisions: courts by doc_id, laws read from texts, citations of half the id."""
    i = F.col("doc_id")
    pick = F.element_at(F.array(*[F.struct(F.lit(a).alias("court"), F.lit(b).alias("chamber")) for a, b, *_ in R15_KINDS]), (i % 4 + 1).cast("int"))
    d = table(spark, sf, "documents").select(i.alias("id"), i.cast("string").alias("doc_id"), pick.alias("c"), "text").select("id", "doc_id", "c.court", F.replace("c.chamber", F.lit("{n}"), (F.col("id") % 23 + 1).cast("string")).alias("chamber"), "text")
    d = d.withColumns({"court_level": courts.court_level(F.col("court")), "law_branch": courts.law_branch(F.col("court"), F.col("chamber")), "case_no": F.lit("2020/1"), "decision_no": F.lit("2021/1"), "decision_date": F.lit(None).cast("string")})
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" TBK m."), (F.col("id") % 40 + 1).cast("string"), F.lit("/2; 9999 sayılı Kanun m."), (F.col("id") % 7 + 1).cast("string"), F.lit("."))
    laws = extract.extract_laws(d.select("doc_id", said.alias("text"))).withColumn("seq", F.lit(0))
    half = F.floor(F.col("id") / 2)
    cites = d.where(half != F.col("id")).select(F.col("doc_id").alias("source_doc_id"), half.cast("string").alias("target_doc_id"), F.lit(1.0).alias("confidence"), F.lit("").alias("snippet"), F.lit(0).alias("seq"))
    return graph_build.build(d, laws, cites)


R15_SQL = "WITH kinds AS " + values([(i, *x) for i, x in enumerate(R15_KINDS)], "i, court, chamber, branch, parent, apex") + ", law AS " + values([(c, b) for c, (_, _, b) in courts.LAWS.items()], "code, branch") + """,
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, court, replace(chamber, '{n}', CAST(doc_id % 23 + 1 AS VARCHAR)) AS chamber, branch, parent, apex, 'TBK_' || (doc_id % 40 + 1) AS a1, 'KANUN_9999_' || (doc_id % 7 + 1) AS a2 FROM documents JOIN kinds ON i = doc_id % 4)
"""


@query("r15_law_nodes", R15_SQL + "SELECT DISTINCT id, regexp_extract(id, '^(.*)_[0-9]+$', 1) AS code, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INTEGER) AS article FROM (SELECT a1 AS id FROM d UNION ALL SELECT a2 FROM d)")
def _(spark, sf):
    """The articles' vertices of the whole graph."""
    return law_graph(spark, sf)[0]["LawArticle"].select("id", "code", "article")


@query("r15_courts", R15_SQL + """SELECT name, CAST(arg_min(level, place) AS INTEGER) AS level, arg_min(branch, place) AS branch FROM (SELECT chamber AS name, CASE court WHEN 'İlk Derece' THEN 1 WHEN 'BAM' THEN 2 ELSE 3 END AS level, branch, id || ' 0' AS place FROM d
UNION ALL SELECT parent, CASE court WHEN 'İlk Derece' THEN 1 WHEN 'BAM' THEN 2 ELSE 3 END, branch, id || ' 1' FROM d UNION ALL SELECT apex, 3, branch, id || ' 2' FROM d WHERE apex <> '') GROUP BY 1""")
def _(spark, sf):
    return law_graph(spark, sf)[0]["Court"].select("name", "level", "branch")


@query("r15_graph", R15_SQL + """SELECT 'Law' AS src_label, code AS src, 'BELONGS_TO' AS type, 'LegalBranch' AS dst_label, branch AS dst FROM law WHERE branch IN ('hukuk', 'ceza', 'idari', 'vergi', 'anayasa', 'karma')
UNION ALL SELECT 'Document', id, 'IN_COURT', 'Court', chamber FROM d UNION ALL SELECT DISTINCT 'Court', chamber, 'PART_OF', 'Court', parent FROM d UNION ALL SELECT DISTINCT 'Court', parent, 'APPEALS_TO', 'Court', apex FROM d WHERE apex <> ''
UNION ALL SELECT 'Document', id, 'IN_BRANCH', 'LegalBranch', branch FROM d UNION ALL SELECT DISTINCT 'LawArticle', a1, 'PART_OF', 'Law', 'TBK' FROM d
UNION ALL SELECT 'Document', id, 'REFERENCES_LAW', 'LawArticle', a1 FROM d UNION ALL SELECT 'Document', id, 'REFERENCES_LAW', 'LawArticle', a2 FROM d
UNION ALL SELECT 'Document', id, 'CITES', 'Document', CAST(doc_id // 2 AS VARCHAR) FROM d WHERE doc_id // 2 <> doc_id AND doc_id // 2 IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    """Every edge of the whole graph."""
    rows = [e.select(F.lit(a).alias("src_label"), "src", "type", F.lit(b).alias("dst_label"), "dst") for (a, _, b), e in law_graph(spark, sf)[1].items()]
    return reduce(DataFrame.unionByName, rows)


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return rounded(incremental.windowed_counts(table(spark, sf, "events")), 4)
