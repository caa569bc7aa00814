"""The property graph of decisions: vertices by label and edges by (source label, type, target label)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dokuma.functions.courts import LAWS, LEVELS
from dokuma.operators.tables import merge_edges, merge_nodes

#: Branch -> label.
BRANCHES = {"hukuk": "Hukuk (Medeni/Özel)", "ceza": "Ceza Hukuku", "idari": "İdare Hukuku", "vergi": "Vergi Hukuku", "anayasa": "Anayasa Hukuku", "karma": "Karma / Diğer"}
PILLARS = {"İlk Derece": "ilk_derece", "BAM": "bam", "BİM": "bim", "Yargıtay": "yargıtay", "Danıştay": "danıştay", "Sayıştay": "sayıştay", "AYM": "aym", "Uyuşmazlık": "uyusmazlik", "AİHM": "aihm"}
APEX = {"BAM": "Yargıtay", "BİM": "Danıştay"}
PROPERTIES = ("court", "chamber", "court_level", "case_no", "decision_no", "decision_date", "law_branch")


def looked_up(values: dict, key: Column, otherwise) -> Column:
    return reduce(lambda out, x: F.when(key == x[0], F.lit(x[1])).otherwise(out), values.items(), F.lit(otherwise))


def parent_of(court: Column, chamber: Column) -> Column:
    """The court above a chamber: the regional court that its name begins with, else the court itself."""
    appeal, admin = F.regexp_extract(chamber, "^(.*?) Bölge Adliye Mahkemesi", 1), F.regexp_extract(chamber, r"^(.*? BİM)\b", 1)
    return F.when((court == "BAM") & (appeal != ""), F.concat(appeal, F.lit(" BAM"))).when((court == "BİM") & (admin != ""), admin).otherwise(court)


def build(documents: DataFrame, laws: DataFrame, citations: DataFrame) -> tuple[dict[str, DataFrame], dict[tuple[str, str, str], DataFrame]]:
    """(vertices, edges) of documents (doc_id and PROPERTIES), laws (doc_id, law_code, article, paragraph, subparagraph,
    seq) and resolved citations (source_doc_id, target_doc_id, confidence, snippet, seq).

    A court's properties are those of the first document, by id, that names it: as its chamber, its parent or the apex.
    Of edges found again the last properties, by seq, stay. Edges to branches and laws that are not in the fixed tables,
    and from or to documents that are not there, are left out; articles of unknown laws are vertices all the same."""
    spark = documents.sparkSession
    d = documents.select("doc_id", *[F.coalesce(c, F.lit(0) if c == "court_level" else F.lit("")).alias(c) for c in PROPERTIES])
    law = spark.createDataFrame([(c, *x) for c, x in LAWS.items()], "code string, full_name string, law_no int, branch string")
    branch = spark.createDataFrame(list(BRANCHES.items()), "name string, label string")

    c = d.withColumns({"parent": parent_of(F.col("court"), F.col("chamber")), "apex": looked_up(APEX, F.col("court"), "")})
    own, above = F.col("chamber") != "", F.col("parent") != ""
    higher = own & above & (F.col("parent") != F.col("chamber"))
    last = higher & (F.col("apex") != "")
    role = lambda when, order, name, level, pillar: F.when(when, F.struct(F.lit(order).alias("role"), F.col(name).alias("name"), level.cast("int").alias("level"), F.col("law_branch").alias("branch"), pillar.alias("pillar")))
    of = lambda name: (looked_up(LEVELS, F.col(name), 0), looked_up(PILLARS, F.col(name), ""))
    named = F.array(role(own, 0, "chamber", F.col("court_level"), F.lit("corpus")), role(higher | (~own & above), 1, "parent", *of("court")), role(last, 2, "apex", *of("apex")))
    seen = c.select("doc_id", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("x")).select("x.name", "x.level", "x.branch", "x.pillar", F.struct("doc_id", "x.role").alias("at"))
    courts = merge_nodes(seen, "name", F.col("at"), "first").drop("at")

    articles = laws.select("doc_id", F.concat_ws("_", "law_code", F.col("article").cast("string")).alias("id"), F.col("law_code").alias("code"), "article", "paragraph", "subparagraph", "seq")
    article = merge_nodes(articles.select("id", "code", "article"), "id", F.struct("code", "article"), "first")

    def edge(rows: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
        return rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type")).distinct()

    ids = d.select("doc_id").distinct()
    refers = articles.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"), F.lit("REFERENCES_LAW").alias("type"), "paragraph", "subparagraph", "seq")
    both = citations.join(ids.withColumnRenamed("doc_id", "source_doc_id"), "source_doc_id", "left_semi").join(ids.withColumnRenamed("doc_id", "target_doc_id"), "target_doc_id", "left_semi")
    cites = both.select(F.col("source_doc_id").alias("src"), F.col("target_doc_id").alias("dst"), F.lit("CITES").alias("type"), "confidence", F.substring("snippet", 1, 500).alias("snippet"), "seq")
    at_court = c.where(own | above).withColumn("at", F.when(own, F.col("chamber")).otherwise(F.col("parent")))
    edges = {
        ("Law", "BELONGS_TO", "LegalBranch"): edge(law.join(branch, law.branch == branch.name, "left_semi"), "BELONGS_TO", "code", "branch"),
        ("Document", "IN_COURT", "Court"): edge(at_court, "IN_COURT", "doc_id", "at"),
        ("Court", "PART_OF", "Court"): edge(c.where(higher), "PART_OF", "chamber", "parent"),
        ("Court", "APPEALS_TO", "Court"): edge(c.where(last), "APPEALS_TO", "parent", "apex"),
        ("Document", "IN_BRANCH", "LegalBranch"): edge(d.join(branch, d.law_branch == branch.name, "left_semi"), "IN_BRANCH", "doc_id", "law_branch"),
        ("LawArticle", "PART_OF", "Law"): edge(article.join(law, "code", "left_semi"), "PART_OF", "id", "code"),
        ("Document", "REFERENCES_LAW", "LawArticle"): merge_edges(refers, F.col("seq")).drop("seq"),
        ("Document", "CITES", "Document"): merge_edges(cites, F.col("seq")).drop("seq"),
    }
    return {"Document": merge_nodes(d, "doc_id", F.struct(*PROPERTIES)), "Court": courts, "LegalBranch": branch, "Law": law, "LawArticle": article}, edges
