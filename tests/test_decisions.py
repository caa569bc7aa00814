"""Citations, metadata layers, slugs, outcomes, precedent and record scores on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from dokuma.functions import judgements
from dokuma.operators import citations, extract, metadata, precedent, scoring


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Yargıtay 11. Hukuk Dairesinin 2019/366 E. 2021/945 K.", ("Yargıtay 11. Hukuk Dairesi", "2019/366", "2021/945")),
        ("Yargıtay 4. CD 2015/10 Esas", ("Yargıtay 4. Ceza Dairesi", "2015/10", None)),
        ("Danıştay Beşinci Dairesi 2010/5 K.", ("Danıştay 5. Daire", None, "2010/5")),
        ("Anayasa Mahkemesi B. No: 2013/7449", ("Anayasa Mahkemesi", "2013/7449", None)),
        ("1.4.1974 tarih 1/2 sayılı İçtihadı Birleştirme", ("İçtihatları Birleştirme HGK", "1974/1", "1974/2")),
        ("Bursa BAM 4. CD 2020/1 E. 2020/2 K.", ("Bursa Bölge Adliye Mahkemesi 4. Ceza Dairesi", "2020/1", "2020/2")),
        ("Danıştay On  Üçüncü Dairesi E. 2011/4", ("Danıştay 13. Daire", "2011/4", None)),
        ("Uyuşmazlık Mahkemesi 2010/1-2010/2 E.K", ("Uyuşmazlık Mahkemesi", "2010/1", "2010/2")),
    ],
)
def test_citations(text, found):
    assert [c[1:4] for c in citations.citations(text)] == [found]


def test_citation_windows():
    far = "Yargıtay 4. CD" + " x" * 160 + " 2015/10 Esas"
    assert list(citations.citations(far)) == []
    assert [c[1] for c in citations.citations("Yargıtay 4. CD ve Yargıtay 5. CD 2015/10 Esas; Yargıtay 5. CD 2015/10 Esas")] == ["Yargıtay 5. Ceza Dairesi"]
    assert list(citations.citations("B. No: 2013/7449 Yargıtay 4. CD B. No: 2013/7449")) == []


def test_citation_rows(spark):
    docs = spark.createDataFrame([("a", "Yargıtay 4. CD 2015/10 Esas ve 2016/11 Esas"), ("b", None), ("c", "")], "doc_id string, text string")
    assert [(r.doc_id, r.citation_index, r.esas_no) for r in citations.extract_citations(docs).collect()] == [("a", 0, "2015/10"), ("a", 1, "2016/11")]


def test_metadata(spark):
    rows = [
        ("a.md", "Danıştay İDDK., E. 1999/953 K. 1999/889 T. 15.10.1999\nT.C. - x\nEsas No.: 1999/1\nidare • iptal davası"),
        ("22-hukuk-dairesi-e-2016-6-k-2016-7-t-8-4-2016.md", "nothing"),
        ("Unknown.md", "Yargıtay 1. HD., E. 2024/1"), ("empty.md", " \n"), ("null.md", None),
        ("old.md", "İSTANBUL BÖLGE ADLİYE MAHKEMESİ\n9. HUKUK DAİRESİ\nMAHKEMESİ\n2020_5 E. 2021_6 K.\nTARİHİ : 1/2/2021"),
    ]
    left_out = {"Unknown": "AI tool output, not original court decision"}
    got = {r.doc_id: r for r in metadata.parse(spark.createDataFrame(rows, "filename string, text string"), left_out).collect()}
    a = got["a"]
    assert (a.court, a.daire, a.court_level, a.law_branch, a.esas_no, a.karar_no, a.decision_date) == ("Danıştay", "İdari Dava Daireleri Kurulu", 3, "idari", "1999/953", "1999/889", "15.10.1999")
    assert a.topic_keywords[-1] == "iptal davası"
    b = got["22-hukuk-dairesi-e-2016-6-k-2016-7-t-8-4-2016"]
    assert (b.court, b.daire, b.esas_no, b.decision_date) == ("Yargıtay", "22. Hukuk Dairesi", "2016/6", "08.04.2016")
    assert got["Unknown"].excluded and (got["Unknown"].court, got["Unknown"].exclude_reason) == ("", left_out["Unknown"]) and got["empty"].exclude_reason == got["null"].exclude_reason == "empty file"
    o = got["old"]
    assert (o.court, o.daire[-17:], o.esas_no, o.karar_no, o.decision_date) == ("BAM", "9. Hukuk Dairesi"[-17:].rjust(17), "2020/5", "2021/6", "01.02.2021")


def test_bullets():
    assert metadata.bullets("a. b c • d e, f • g") == ["b c", "d e"]
    assert metadata.bullets("x • y • z") == ["x", "y", "z"] and metadata.bullets("x •y") == metadata.bullets("•") == metadata.bullets("") == []


def test_slugs(spark):
    names = ["2. Hukuk Dairesi 2023_7 E. , 2024_4 K.", "Yargıtay 2. HD E_ 2023_7 K_ 2024_4 (Kapatılan)", "2013-7449!", "2013 7449", "IĞDIR Ağır Ceza!", "igdir-agir-ceza"]
    got = dict(tuple(r) for r in metadata.renamed(spark.createDataFrame([(n,) for n in names], "stem string")).collect())
    assert got == {names[0]: "2-hukuk-dairesi-e-2023-7-k-2024-4-1", names[1]: "2-hukuk-dairesi-e-2023-7-k-2024-4-1-2", names[2]: "2013-7449-2", names[3]: "2013-7449", names[4]: "igdir-agir-ceza-2"}


def test_outcomes(spark):
    long = "hükmün BOZULMASINA\n" + "x\n" * 300
    rows = spark.createDataFrame([("a", "SONUÇ: hükmün\nKISMEN\nBOZULMASINA, oy birliğiyle"), ("b", long), ("c", None)], "id string, text string")
    got = {r.id: (r.d, r.v) for r in rows.select("id", judgements.disposition(F.col("text")).alias("d"), judgements.voting(F.col("text")).alias("v")).collect()}
    assert got == {"a": ("kismen_bozma", "oy_birligi"), "b": ("unknown", "unknown"), "c": ("unknown", "unknown")}


def test_standing(spark):
    docs = spark.createDataFrame([("low", 1, "x", "red"), ("high", 3, "x", "bozma"), ("insists", 1, "x", "direnme"), ("ibk", 3, "ibk", "red"), ("peer", 3, "x", "red"), ("alone", 1, "x", "red")], "doc_id string, court_level int, decision_authority string, disposition string")
    cites = lambda *rows: {r.doc_id: r.status for r in precedent.standing(docs, spark.createDataFrame(list(rows), "src string, dst string, treatment string")).collect()}
    got = cites(("high", "low", "REVERSES"), ("peer", "high", "REVERSES"), ("low", "ibk", "FOLLOWS"))
    assert (got["low"], got["high"], got["ibk"], got["alone"]) == ("overruled", "conflicting_precedent", "good_law", "unknown")
    assert cites(("high", "low", "REVERSES"), ("insists", "low", "NEUTRAL"))["low"] == "disputed"
    assert cites(("ibk", "low", "REVERSES"), ("high", "low", "REVERSES"))["low"] == "superseded_by_ibk"


def test_sections():
    text = "T.C.\nİDDİA\nDavacı ister.\nGEREKÇE:\n" + "Bir iki üç.\n\n" * 3 + "HÜKÜM\nBozulmasına."
    got = list(extract.sections_of(text, 6))
    assert [s for s, _, _ in got] == ["giris", "iddia", "gerekce", "gerekce", "hukum"]
    assert " ".join(t for _, t, _ in got).split() == text.split()
    assert list(extract.sections_of(None)) == list(extract.sections_of("")) == []


RECORD = {
    "court_type": "Yargıtay", "court": "Yargıtay 1. Hukuk Dairesi", "case_number": "2023/1", "decision_number": "2023/2", "decision_date": "2023-01-01", "is_final": True, "finality_basis": None,
    "appellants": ["davacı"], "appeal_outcomes_by_role": [{"role": "davacı", "result": "kabul"}], "keywords": ["tapu", "muvazaa"],
    "dispositive_reasoning": {"issue": "Tapu iptali geçerli mi?", "rule": "TBK 19", "application": "ispat", "conclusion": "Onama"},
    "fact_pattern": {"actor_roles": ["davacı", "davalı"], "context": "Tapu devri.", "trigger": "x", "claim": "Tapu iptali."},
    "cited_court_decisions": [], "cited_law_articles": [{"law": "TBK", "law_number": "6098", "article": "19", "context": "Muvazaa"}],
}


def test_scores(spark):
    table = lambda rows: spark.createDataFrame([(f, json.dumps(r, ensure_ascii=False) if isinstance(r, dict) else r) for f, r in rows], "file string, record string")
    gold = table([("same", RECORD), ("other", RECORD), ("broken", RECORD), ("missing", RECORD)])
    results = table([("same", RECORD), ("other", RECORD | {"court_type": "Danıştay", "cited_law_articles": [], "keywords": ["TAPU", "y"]}), ("broken", "{"), ("extra", RECORD)])
    scores = scoring.scored(gold, results)
    whole = sum(w for _, w in scoring.FIELDS.values())
    assert {r.file: r.overall for r in scoring.by_file(scores).collect()} == {"same": 1.0, "other": round(1 - (1 + 2 + 0.75) / whole, 4), "broken": 0.0}
    s = scoring.summary(gold, results, scores).first()
    assert (s.files_in_gold, s.files_in_result, s.files_scored, s.coverage) == (4, 4, 3, 0.75)
    fields = {r.field: r for r in scoring.by_field(scores).collect()}
    assert fields["cited_law_articles"].score == 0.5 and fields["cited_law_articles"].matched == 1 and fields["keywords"].score == 0.75
    assert {(r.file, r.side) for r in scoring.unpaired(gold, results).collect()} == {("missing", "missing_in_result"), ("extra", "extra_in_result")}


def test_greedy_matching():
    gold = [{"concept": "a", "role": "x", "context_in_reasoning": "p"}, {"concept": "b", "role": "y", "context_in_reasoning": "q"}]
    result = [{"concept": "a", "role": "z", "context_in_reasoning": "p"}, {"concept": "a", "role": "x", "context_in_reasoning": "p"}, {"concept": "c"}]
    got = scoring.objects(gold, result, "legal_concepts")
    assert got["matched"] == 1 and got["avg_value_score"] == 1 and got["precision"] == 0.3333 and got["recall"] == 0.5 and got["f1"] == 0.4
