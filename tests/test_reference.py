"""Golden values of the ranked-run fixtures, graph facts, verification and merge cases."""

from __future__ import annotations

import json

import pytest

from dokuma.operators import evaluate, extract, graph, graph_build, records, tables

GOLD = {"TQ1": {"D01": 3, "D02": 2, "D03": 1, "D04": 0}, "TQ2": {"D05": 3, "D06": 3, "D07": 0, "D08": 0}, "TQ3": {"D01": 2, "D09": 1, "D10": 0}}
RUN = {"TQ1": "D04 D01 D03 D10 D08 D02 D09 D07 D06 D05", "TQ2": "D05 D08 D06 D07 D10 D01 D02 D03 D04 D09", "TQ3": "D10 D08 D07 D04 D06 D09 D01 D03 D02 D05"}


def test_metrics(spark):
    gold = spark.createDataFrame([(q, d, g) for q, x in GOLD.items() for d, g in x.items()], "query_id string, doc_id string, grade int")
    run = evaluate.ranked(spark.createDataFrame([(q, x.split()) for q, x in RUN.items()], "query_id string, retrieved_docs array<string>"))
    m = evaluate.per_query(run, gold)
    got = {r.query_id: r for r in m.collect()}
    assert got["TQ1"].recall_at_5 == pytest.approx(0.6667, abs=1e-4) and got["TQ1"].ndcg_at_5 == pytest.approx(0.5234, abs=1e-4)
    assert got["TQ2"].ndcg_at_10 == pytest.approx(0.9197, abs=1e-4) and got["TQ3"].ndcg_at_10 == pytest.approx(0.3735, abs=1e-4)
    mean = evaluate.macro(m).first()
    assert [round(x, 4) for x in (mean.recall_at_5, mean.ndcg_at_5, mean.ndcg_at_10, mean.mrr, mean.hit_rate_at_5)] == [0.5556, 0.4811, 0.6435, 0.5556, 0.6667]


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "doc_id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("b", "d"), ("a", "b")], "src string, dst string")
    assert {(r.doc_id, r.in_degree, r.out_degree) for r in graph.degrees(nodes, edges).collect()} == {("a", 0, 2), ("b", 3, 1), ("c", 0, 1), ("d", 1, 0)}
    assert max(r.score for r in graph.pagerank(nodes, edges).collect()) == pytest.approx(1)
    assert {r.score for r in graph.pagerank(nodes, edges.limit(0)).collect()} == {0.25}
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "query_id int, doc_id string")
    assert {(r.query_id, r.doc_id) for r in graph.neighbours(seeds, edges).collect()} == {(1, "b"), (2, "c"), (2, "d")}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_fitted_cells(spark, folder):
    from dokuma.plans import features  # noqa: F401  registers queries of its own
    from dokuma.plans.catalog import QUERIES

    exact = {(r.query_id, r.chunk_id) for r in QUERIES["r03_chunks"](spark, f"/root/testdata/{folder}").where("rank <= 10").collect()}
    got = {(r.query_id, r.chunk_id) for r in QUERIES["r04_ivf_fitted"](spark, f"/root/testdata/{folder}").collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


def test_graph_build(spark):
    docs = [("a", "Yargıtay", "2. Hukuk Dairesi", 3, "hukuk"), ("b", "BAM", "İzmir Bölge Adliye Mahkemesi 4. Ceza Dairesi", 2, "ceza"), ("c", "AYM", None, 4, "other"), ("e", None, None, None, None), ("f", "BİM", "Ankara BİM 1. İDD", 2, "idari")]
    d = spark.createDataFrame(docs, "doc_id string, court string, chamber string, court_level int, law_branch string").selectExpr("*", "'1/1' AS case_no", "'2/2' AS decision_no", "'' AS decision_date")
    laws = spark.createDataFrame([("a", "TCK", 302, 1, None, 1), ("a", "TCK", 302, 2, "b", 2), ("b", "KANUN_9999", 5, None, None, 3), ("gone", "TBK", 49, None, None, 4)], "doc_id string, law_code string, article int, paragraph int, subparagraph string, seq long")
    cites = spark.createDataFrame([("a", "b", 0.8, "old", 1), ("a", "b", 1.0, "x" * 600, 2), ("a", "gone", 1.0, "", 3)], "source_doc_id string, target_doc_id string, confidence double, snippet string, seq long")
    nodes, edges = graph_build.build(d, laws, cites)
    pairs = lambda *key: {(r.src, r.dst) for r in edges[key].collect()}
    assert len(edges) == 8 and pairs("Document", "IN_COURT", "Court") == {("a", docs[0][2]), ("b", docs[1][2]), ("c", "AYM"), ("f", docs[4][2])}
    assert pairs("Court", "PART_OF", "Court") == {(docs[0][2], "Yargıtay"), (docs[1][2], "İzmir BAM"), (docs[4][2], "Ankara BİM")}
    assert pairs("Court", "APPEALS_TO", "Court") == {("İzmir BAM", "Yargıtay"), ("Ankara BİM", "Danıştay")}
    assert pairs("Document", "IN_BRANCH", "LegalBranch") == {("a", "hukuk"), ("b", "ceza"), ("f", "idari")}
    assert pairs("LawArticle", "PART_OF", "Law") == {("TCK_302", "TCK"), ("TBK_49", "TBK")} and len(pairs("Law", "BELONGS_TO", "LegalBranch")) == nodes["Law"].count() == 19
    assert {tuple(r)[:5] for r in edges["Document", "REFERENCES_LAW", "LawArticle"].collect()} == {("a", "TCK_302", "REFERENCES_LAW", 2, "b"), ("b", "KANUN_9999_5", "REFERENCES_LAW", None, None)}
    assert [(r.src, r.dst, r.confidence, r.snippet) for r in edges["Document", "CITES", "Document"].collect()] == [("a", "b", 1.0, "x" * 500)]
    assert {tuple(r) for r in nodes["Court"].select("name", "level", "branch", "pillar").collect()} >= {("İzmir BAM", 2, "ceza", "bam"), ("Yargıtay", 3, "hukuk", "yargıtay"), (docs[0][2], 3, "hukuk", "corpus"), ("Danıştay", 3, "idari", "danıştay"), ("AYM", 4, "other", "aym")}
    assert nodes["Document"].count() == 5 and {r.id for r in nodes["LawArticle"].collect()} == {"TCK_302", "TBK_49", "KANUN_9999_5"} and nodes["LegalBranch"].count() == 6


def test_graph_query(spark):
    from dokuma.plans import features  # noqa: F401  registers queries of its own
    from dokuma.plans.catalog import QUERIES

    got = {(r.src_label, r.type, r.dst_label) for r in QUERIES["r15_graph"](spark, "/root/testdata/sf0.001").collect()}
    assert {t for _, t, _ in got} == {"BELONGS_TO", "IN_COURT", "PART_OF", "APPEALS_TO", "IN_BRANCH", "REFERENCES_LAW", "CITES"} and len(got) == 8


def test_chunks():
    assert extract.chunks_of("", 10, 3) == []
    assert extract.chunks_of("w " * 14 + "w.", 10, 3)[0][1] == 15
    s = "a b c d. e f g h. i j k l."
    assert [t for t, _ in extract.chunks_of(s, 10, 3)] == ["a b c d. e f g h.", "i j k l."]


def test_laws():
    text = "TCK m.302; TBK m.49/1; CMK m.53/1-a; HMK m.100, f.2; TCK'nın 302. maddesi; 9999 sayılı Kanun m.5; Anayasa'nın 13. maddesi"
    got = {(c, a): (n, p, s) for c, n, a, p, s, _, _ in extract.law_references(text)}
    assert got[("TCK", 302)] == (5237, None, None) and got[("TBK", 49)] == (6098, 1, None) and got[("CMK", 53)] == (5271, 1, "a")
    assert got[("HMK", 100)] == (6100, 2, None) and got[("KANUN_9999", 5)][0] == 9999 and got[("AY", 13)][0] == 2709


def test_laws_checked(spark):
    source = "Dosya 2019/366. 6098 sayılı TBK'nun 52.maddesi ve 6100 sayılı HMK.nun 341/1, 160980 sayılı"
    laws = spark.createDataFrame([("Türk Borçlar Kanunu", ["TBK"], "6098"), ("Kişisel Verilerin Korunması Kanunu", ["KVKK"], "6698"), ("Türk Ceza Kanunu", ["TCK"], "5237"), ("Türk Medeni Kanunu", ["MK"], "4721")], "law string, abbreviations array<string>, number string")
    cited = spark.createDataFrame([("f", i, law, n) for i, (law, n) in enumerate([("Türk Borçlar Kanunu", "6098"), ("Kişisel Verilerin Korunması Kanunu", "6698"), ("Türk Ceza Kanunu", "5237"), ("Türk Medeni Kanunu", None)])], "file string, index int, law string, law_number string")
    got = {r["index"]: r.verified for r in records.check_laws(cited, spark.createDataFrame([("f", source)], "file string, text string"), laws).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_merge(spark):
    rows = [("x", "metadata", "ok", json.dumps({"court": "AYM", "summary": "not mine", "is_final": True, "keywords": ["a", "b"]}), None), ("x", "summary", "ok", json.dumps({"summary": 'short "text"'}), None), ("y", "summary", "invalid_json", None, "{")]
    got = records.merged(spark.createDataFrame(rows, "stem string, stage string, status string, payload string, raw string")).collect()
    assert len(got) == 1 and got[0].present == ["metadata", "summary"] and got[0].missing == ["citations_decisions", "citations_laws"]
    assert json.loads(got[0].record) == {"file": "x.md", "court": "AYM", "is_final": True, "summary": 'short "text"', "keywords": ["a", "b"]}
    assert list(json.loads(got[0].record)) == ["file", "court", "is_final", "summary", "keywords"]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, x string, y string"), spark.createDataFrame([(2, "c", "z"), (3, "d", "z")], "id int, x string, y string")
    assert {tuple(r) for r in tables.upsert(old, new, ["id"]).collect()} == {(1, "a", "k"), (2, "c", "z"), (3, "d", "z")}
    assert {tuple(r) for r in tables.upsert(old, new, ["id"], only=["x"]).collect()} == {(1, "a", "k"), (2, "c", "k"), (3, "d", "z")}
