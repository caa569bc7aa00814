"""Stored indexes, walks, joins and tables against plain computations, with odd rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dokuma.operators import graph, retrieve, vector_index

VECTORS = "chunk_id long, doc_id long, vector array<double>, label int"


def exact(rows, queries, k, keep=lambda r: True):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    out = {}
    for q, v in queries:
        if good(v):
            scored = sorted((-round(cosine(r[2], v), 9), r[0]) for r in rows if good(r[2]) and keep(r))[:k]
            out |= {(q, i): c for i, (_, c) in enumerate(scored, 1)}
    return out


@pytest.fixture(scope="module")
def clustered():
    r = random.Random(11)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, i % 7, [x + r.gauss(0, 0.15) for x in r.choice(centres)], i % 3) for i in range(600)]
    odd = [[math.nan] * 8, [math.inf] + [0.5] * 7, [0.0] * 8, None, [None] * 8, [-math.inf] * 8, [1.0, math.nan] + [0.0] * 6]
    return rows + [(1000 + i, 0, v, 0) for i, v in enumerate(odd * 5)]


def test_vectors_without_direction(spark, clustered):
    df = spark.createDataFrame(clustered, VECTORS)
    queries = [(1, clustered[0][2]), (1, clustered[0][2]), (2, [math.nan] * 8), (3, clustered[5][2]), (4, [math.inf] * 8), (5, None), (6, [0.0] * 8)]
    want = exact(clustered, queries, 10)
    q = spark.createDataFrame(queries, "query_id long, query array<double>")
    for rows in (df.coalesce(1), df.repartition(7)):
        assert {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.dense_topk(q, rows, 10).collect()} == want
    retrieve.BROADCAST_ROWS, was = 0, retrieve.BROADCAST_ROWS
    try:
        assert {(r.query_id, r["rank"]): r.chunk_id for r in retrieve.dense_topk(q, df, 10).collect()} == want
    finally:
        retrieve.BROADCAST_ROWS = was


def scan_files(df):
    """Files that the scans of an executed plan read."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        else:
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
            if p.nodeName().startswith("Scan parquet") and p.metrics().contains("numFiles") and "cell" in p.toString():
                found.append(p.metrics().apply("numFiles").value())
    return sum(found)


def test_index(spark, clustered, tmp_path):
    df = spark.createDataFrame(clustered, VECTORS)
    path = vector_index.build(df, str(tmp_path / "index"), count=12)
    stored = vector_index.vectors(spark, path)
    assert stored.count() == 600 and {r.cell for r in vector_index.centroids(spark, path).collect()} == {r.cell for r in stored.select("cell").distinct().collect()}
    queries = [(i, clustered[i * 50][2]) for i in range(10)] + [(50, [math.nan] * 8), (51, None)]
    q = spark.createDataFrame(queries, "query_id long, query array<double>")
    got = lambda df: {(r.query_id, r["rank"]): r.chunk_id for r in df.collect()}
    assert got(vector_index.search(spark, path, q, 10)) == exact(clustered, queries, 10)
    assert got(vector_index.search(spark, path, q, 10, where="label = 1")) == exact(clustered, queries, 10, lambda r: r[3] == 1)
    assert got(vector_index.search(spark, path, q, 900)) == exact(clustered, queries, 900)  # fewer rows than asked for
    probes = vector_index.probes_for(spark, path, q.where("query_id < 5"), 10, 0.95)
    few = vector_index.search(spark, path, q, 10, probes=probes)
    want, found = exact(clustered, queries, 10), got(few)
    assert sum((k[0], c) in {(a[0], b) for a, b in want.items()} for k, c in found.items()) >= 0.9 * len(want)
    one = vector_index.search(spark, path, q.where("query_id = 3"), 5, probes=1, where="label = 1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "EqualTo(label,1)" in plan
    assert 0 < scan_files(one) < len(stored.inputFiles()) / 4
    assert vector_index.search(spark, path, q.limit(0), 5).count() == 0


def test_walks(spark):
    r = random.Random(5)
    edges = [(0, i) for i in range(1, 120)] + [(i, 0) for i in range(1, 120, 3)] + [(r.randrange(150), r.randrange(150)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b]
    seeds = [(1, 0), (1, 5), (2, 7), (3, 149), (4, 1000)]
    cand = [(1, i) for i in range(130)] + [(2, i) for i in range(60, 150)] + [(2, 7), (3, 149), (4, 1000), (4, 1001), (5, 3)]
    c, s, e = spark.createDataFrame(cand, "query_id long, doc_id long"), spark.createDataFrame(seeds, "query_id long, doc_id long"), spark.createDataFrame(edges, "src long, dst long")
    c, s = c.where("query_id <> 5"), s
    whole = {(x.query_id, x.doc_id): x.graph for x in graph.personal_pagerank(c, s, e).collect()}
    joined = {(x.query_id, x.doc_id): x.graph for x in graph.personal_pagerank(c, s, e, local=0).collect()}
    assert whole.keys() == joined.keys() and all(abs(whole[k] - joined[k]) < 1e-9 for k in whole)
    assert whole[4, 1000] == 1.0 and whole[4, 1001] == 0.0 and max(v for (q, _), v in whole.items() if q == 1) == 1.0
    mixed = {(x.query_id, x.doc_id): x.graph for x in graph.personal_pagerank(c, s, e, local=100).collect()}
    assert mixed.keys() == whole.keys() and all(abs(whole[k] - mixed[k]) < 1e-9 for k in whole)


def test_pagerank_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, (i * 7) % 300) for i in range(1, 300)]
    e, n = spark.createDataFrame(edges, "src long, dst long"), spark.range(310).withColumnRenamed("id", "doc_id")
    get = lambda hub: {r.doc_id: r.score for r in graph.pagerank(n, e, hub=hub).collect()}
    one, parts = get(10**9), get(20)
    assert one.keys() == parts.keys() and all(abs(one[k] - parts[k]) < 1e-9 for k in one) and len(one) == 310


def test_names(spark):
    from difflib import SequenceMatcher

    from dokuma.operators import names

    r = random.Random(6)
    base = ["".join(r.choice("abcçdeğ . ") for _ in range(r.randint(1, 40))) for _ in range(120)] + ["aaaaaaaaaa", "abababababab", "", "x", "xy", "xyz" * 80]
    left = []
    for w in base * 2:
        x = list(w)
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            at = r.randrange(len(x) + 1)
            x[at : at + r.choice([0, 1])] = r.choice(["", "q", "a"])
        left.append("".join(x))
    want = {(a, b): SequenceMatcher(None, b, a).ratio() for a in set(left) for b in set(base)}
    named = lambda x: spark.createDataFrame([(i, 1) for i in [*x, None]], "name string, n int")
    for least in (0.7, 0.88, 1.0):
        got = {(x.left, x.right): x.ratio for x in names.alike(named(left), named(base), least).collect()}
        assert got == {k: v for k, v in want.items() if v >= least}
        best = {x.left: (x.ratio, x.right) for x in names.closest(named(left), named(base), least).collect()}
        assert best == {a: max((v, b) for b in set(base) if (v := want[a, b]) >= least) for a in set(left) if any(want[a, b] >= least for b in set(base))}
    few = names.candidates(named(left).select("name").distinct().na.drop(), named(base).select("name").distinct().na.drop(), 0.88).count()
    assert few < 0.2 * len(set(left)) * len(set(base))  # nine letters only
    with pytest.raises(ValueError, match="2/3"):
        names.candidates(named(left), named(base), 0.6)


def test_resolve_by_closest_name(spark):
    from dokuma.operators import resolve

    d = spark.createDataFrame([(1, "Yargıtay", "2. Hukuk Dairesi", "2020/1", "2021/1"), (2, "", "Danıştay Onuncu Daire", "2020/2", "")], "doc_id long, court string, chamber string, case_no string, decision_no string")
    c = spark.createDataFrame([(1, 9, "2. Hukuk Daresi", "2020/1", None), (2, 9, "2 Hukuk Dairezi", "2020/1", None), (3, 9, "Danıştay Onuncu Dayre", "2020/2", None), (4, 9, "Danıştay Onuncu Dayre", "2020/3", None), (5, 9, "Bambaşka", "2020/2", None), (6, 9, None, "2020/2", None)], "citation long, source_doc_id long, chamber string, case_no string, decision_no string")
    v = spark.createDataFrame([("2. Hukuk Dairesi",), ("Danıştay Onuncu Daire",), ("Danıştay Onuncu Dayra",), (None,)], "name string")
    good, bad = resolve.resolve(c, d, v)
    assert {(x.citation, x.target_doc_id) for x in good.collect()} == {(1, 1), (2, 1), (3, 2)}
    assert {(x.citation, x.reason) for x in bad.collect()} == {(4, "no_ek_match_in_daire"), (5, "daire_not_in_corpus"), (6, "no_daire_extracted")}


def test_vector_pairs(spark, clustered):
    from dokuma.operators import precedent, vector_pairs

    good = [(r[0], r[2]) for r in clustered if r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])]
    copies = [(5000 + i, good[3][1]) for i in range(40)] + [(7000, good[8][1]), (7000, good[8][1])]
    rows = good + copies + [(None, good[0][1]), *[(r[0], r[2]) for r in clustered[-35:]]]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(6)
    one, members = vector_pairs.classes(df)
    lowest = {}
    for i, v in good + copies:
        lowest[tuple(v)] = min(i, lowest.get(tuple(v), i))
    assert {(r.id, r.member) for r in members.collect()} == {(lowest[tuple(v)], i) for i, v in good + copies}
    ids = sorted(lowest.values())
    m = np.array([v for v, _ in sorted(lowest.items(), key=lambda x: x[1])])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    for tau, options in ((0.9, {}), (0.9, {"block": 16, "pivots": 5}), (0.2, {"block": 50}), (0.97, {"pivots": 1})):
        want = {(ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)) if s[a, b] > tau}
        got = vector_pairs.similar(one, tau, **options).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and all(abs(r.similarity - s[ids.index(r.a), ids.index(r.b)]) < 1e-9 for r in got)
    assert vector_pairs.similar(one.limit(0), 0.5).count() == 0
    holdings = spark.createDataFrame([(1, [1.0, 0.0], "Y", "1", "d1", "bozma"), (2, [1.0, 0.0], "Y", "1", "d1", "bozma"), (3, [1.0, 0.0], "Y", "2", "d1", "onama"), (4, [0.9, 0.1], "Y", "1", "d2", "direnme"), (5, [0.0, 1.0], "Y", "2", "d3", "ret"), (6, None, "Y", "2", "d3", "ret")], "doc_id long, vector array<double>, court string, daire string, decision_date string, disposition string")
    assert {(r.doc_a, r.doc_b, r.conflict_type, r.n_pairs) for r in precedent.corpus_conflicts(holdings, 0.7).collect()} == {(1, 3, "inter_daire", 2), (1, 4, "bozma_direnme", 2), (3, 4, "inter_daire", 1)}


def test_stored_table(spark, tmp_path, monkeypatch):
    from dokuma.operators.stored import StoredTable, VersionTaken

    schema = "k long, `a b` string, ts int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    get = lambda df: sorted(map(tuple, df.collect()), key=repr)
    t = StoredTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no table"):
        t.merge(rows((1, "a", 1)))
    assert t.create(rows((1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1), *[(i, "x", 0) for i in range(10, 60)]), ["k"], slices=16, order="ts") == 0
    others = [(i, "x", 0) for i in range(10, 60)]
    before = t.manifest()
    assert get(t.read()) == sorted([(1, "b", 2), (2, "c", 1), (None, "n", 1), *others], key=repr)
    t.merge(rows((2, "late", 0), (3, "new", 5), (None, "m", 2)))
    changed = [s for s in t.manifest()["slices"] if t.manifest()["slices"][s] != before["slices"].get(s)]
    assert 1 <= len(changed) <= 3  # only the slices of its three keys
    assert get(t.read()) == sorted([(1, "b", 2), (2, "late", 0), (3, "new", 5), (None, "m", 2), *others], key=repr)
    t.merge(rows((2, "older", -1), (3, "newer", 6)), order="ts", newest=True, mark="b1")
    at = t.merge(rows((2, "never", 99)), order="ts", newest=True, mark="b1")
    assert at == 2 and get(t.read().where("k < 4")) == [(1, "b", 2), (2, "late", 0), (3, "newer", 6)]
    t.merge(rows((1, "only", 77), (4, "fresh", 7)), only=["a b"])
    assert get(t.read().where("k < 5")) == [(1, "only", 2), (2, "late", 0), (3, "newer", 6), (4, "fresh", 7)]

    def killed(m):
        raise KeyboardInterrupt

    whole = get(t.read())
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(t, "_put", killed)
        t.merge(rows((1, "lost", 1)))
    assert get(t.read()) == whole
    monkeypatch.setattr(StoredTable, "manifest", lambda self, version=None, f=StoredTable.manifest: f(self, version) if version is not None or len(self.versions()) < 4 else f(self, 2))
    with pytest.raises(VersionTaken):  # a writer that began from an older version
        t.merge(rows((1, "second", 1)))
    monkeypatch.undo()
    assert get(t.read()) == whole and get(t.read(0).where("k = 2")) == [(2, "c", 1)]
    t.delete(spark.createDataFrame([(None,), (1,), (99,)], "k long"))
    assert get(t.read().where("k < 5 OR k IS NULL")) == [(2, "late", 0), (3, "newer", 6), (4, "fresh", 7)]
    assert t.merge(rows()) == t.versions()[-1] and t.history().count() == 5
    now = get(t.read())
    assert t.vacuum() > 2 and t.versions() == [4] and get(t.read()) == now and t.vacuum() == 0
    with pytest.raises(ValueError, match="not there"):
        t.read(0)
    assert t.reload(rows()) == 4 and t.reload(rows((7, "r", 1))) == 5 and get(t.read()) == [(7, "r", 1)]
    c = StoredTable(spark, str(tmp_path / "c"))
    c.create(spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)], "d int, i int"), ["d", "i"], slice_by=["d"])
    c.replace(spark.createDataFrame([(1, 0)], "d int, i int"), ["d"])
    assert get(c.read()) == [(1, 0), (2, 0), (2, 1)]


def test_keyed_files(spark, tmp_path):
    from dokuma.sources import keyed

    files, texts = tmp_path / "in", {}
    for key in ["a.json", "b/1.json", "b/2.json", "b/c/3.json", "b.json", "b-x/4.json", "d/e/f/5.json", "d/6.txt", ".hidden/7.json", "d/_x.json"]:
        (files / key).parent.mkdir(parents=True, exist_ok=True)
        (files / key).write_text(texts.setdefault(key, '{"k": "%s"}' % key))
    (files / "b/bad.json").write_bytes(b"\xff\xfe")
    (files / "b/cut.json").write_text('{"k": ')
    names = sorted(k for k in texts if k.endswith(".json") and not k.startswith(".") and "_x" not in k)
    base = keyed._opened(f"file://{files}")
    every = [k for k, _ in keyed.walk(*base, suffix=".json")]
    assert every == sorted([*names, "b/bad.json", "b/cut.json"])
    assert all([k for k, _ in keyed.walk(*base, after=a, suffix=".json")] == [k for k in every if k > a] for a in [*every, "b", "b/", "zz", "b/c"])
    for depth in (0, 1, 2, 5):
        rows = keyed.read(spark, f"file://{files}", depth=depth)
        good, bad = keyed.parsed(rows, "k string")
        assert sorted(r.record.k for r in good.collect()) == names
        assert sorted((r.key, r.error == "no JSON object") for r in bad.collect()) == [("b/bad.json", False), ("b/cut.json", True)]
    assert keyed.read(spark, f"file://{tmp_path}/none").count() == 0

    def run():
        q = keyed.stream(spark, f"file://{files}", f"file://{tmp_path}/ledger", page=3, slice=2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        return sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()), [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]

    assert run() == (every, [3, 3, 3])
    (files / "e").mkdir()
    for i in range(4):
        (files / f"e/{i}.json").write_text("{}")
    assert keyed.StreamReader({"path": f"file://{files}", "ledger": f"file://{tmp_path}/ledger", "page": 1}).latestOffset() == {"after": "e/0.json"}  # noted, then the run dies
    found, pages = run()
    assert found == sorted([*every, *(f"e/{i}.json" for i in range(4))]) and sum(pages) == 4 and max(pages) <= 4
    assert run()[0] == found


def test_turkish_stems(spark):
    from dokuma.functions import turkish

    want = {
        "davanın": "dava", "davası": "dava", "davalarının": "dava", "dava": "dava", "mahkemesinin": "mahkeme", "mahkemelerinde": "mahkeme", "mahkemeye": "mahkeme", "mahkeme": "mahkeme", "kararı": "karar",
        "kararın": "karar", "kararının": "karar", "kararlar": "karar", "kararlarımızdan": "karar", "dairesidir": "daire", "dairelerdir": "daire", "suçun": "suç", "suçtan": "suç", "kitabı": "kitap", "kitaplarla": "kitap",
        "ağacı": "ağaç", "evler": "ev", "yargıtay": "yargıtay", "yargıtayın": "yargıtay", "kanunu": "kanun", "kanunun": "kanun", "kanunlarımızda": "kanun", "kanun": "kanun", "maddesi": "madde", "maddeden": "madde",
        "madde": "madde", "hakimi": "hakim", "hakimlerin": "hakim", "sanıklara": "sanık", "sanığın": "sanık", "köprüsündeki": "köprü", "gözlerinizden": "göz", "çocuğumuz": "çocuk", "insanların": "insan",
        "öğretmenlerle": "öğretmen", "zamanındaki": "zaman", "borçludur": "borçlu", "ve": "ve", "": "", "x": "x", "hukuk": "hukuk", "ceza": "ceza", "kararler": "kararler", "evlar": "evlar",
    }
    df = spark.createDataFrame([(w,) for w in [*want, None]], "w string")
    got = {r.w: r.s for r in df.select("w", turkish.stem(F.col("w")).alias("s")).collect()}
    assert got == want | {None: None}
    import duckdb

    held = df.toPandas()  # noqa: F841  read by the SQL
    assert dict(duckdb.sql(f"SELECT w, {turkish.stem_sql('w')} FROM held WHERE w IS NOT NULL").fetchall()) == want
    assert {r.s for r in spark.createDataFrame([("kanunun",)], "w string").select(turkish.stem(F.col("w"), ()).alias("s")).collect()} == {"kanu"}  # what no rule can know


def plain_pairs(gold, result, field):
    """Every pair compared, the most alike taken first."""
    from dokuma.operators import scoring as sc

    blank, parts, identity = (None, "", []), sc.PARTS[field], sc.IDENTITY[field]
    alike = []
    for i, g in enumerate(gold):
        for j, r in enumerate(result):
            if any(g.get(n) not in blank and r.get(n) not in blank and sc.COMPARE[k](g[n], r[n]) >= sc.LEAST_ITEM for n, k in identity.items()):
                alike.append((*sc.compared(g, r, parts), i, j))
    rows, columns, taken = set(), set(), []
    for value, each, i, j in sorted(alike, key=lambda c: -c[0]):
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            taken.append((value, each))
    return taken


def test_object_lists():
    from dokuma.operators import scoring as sc

    r = random.Random(12)
    words = ["Türk", "Ceza", "Kanunu", "Borçlar", "İş", "ab", "axb", "a", "", "–"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 4)))
    for field in ("cited_law_articles", "cited_court_decisions", "legal_concepts", "appeal_outcomes_by_role"):
        for n in (0, 1, 7, 40):
            sides = []
            for _ in range(2):
                names = {*sc.PARTS[field], *sc.IDENTITY[field]}
                sides.append([{k: r.choice([None, text(), str(r.randint(1, 9)), text()]) for k in names if r.random() < 0.9} for _ in range(r.randint(n // 2, n))])
            got = sc.paired(*sides, sc.IDENTITY[field], sc.PARTS[field])
            assert got == plain_pairs(*sides, field)
    left, right = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 9))) for _ in range(60)], ["".join(r.choice("abcd ") for _ in range(r.randint(0, 9))) for _ in range(60)]
    assert sorted(sc.alike_texts(left, right, 0.7)) == [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if sc.ratio(x, y) >= 0.7 or x == y]


def test_from_sql(spark):
    from pyspark.errors import PySparkException

    from dokuma.functions import surface
    from dokuma.operators import citations, extract

    names = surface.register(spark)
    laws = "TBK m.49/1 ve CMK m.53/1-a. Yargıtay 11. HD E: 2019/366, K: 2021/945. Son!"
    docs = spark.createDataFrame([(1, laws + "\n\nHÜKÜM\nBir iki. Üç dört beş." * 3, 5), (2, None, 6), (3, "", 7), (1, "tek", 8)], "doc_id long, text string, chunk_index int")
    docs.createOrReplaceTempView("docs_for_sql")
    want = {
        "law_references": extract.extract_laws(docs), "citations": citations.extract_citations(docs), "sentence_chunks": extract.chunk(docs), "token_windows": extract.token_windows(docs, 512, 64), "sections": extract.chunk_sections(docs),
    }
    assert set(names) == set(want)
    for name, df in want.items():
        got = spark.sql(f"SELECT * FROM {name}(TABLE(docs_for_sql))")
        assert got.schema["doc_id"].dataType.simpleString() == "bigint" and got.columns == df.columns
        assert sorted(map(str, got.withColumn("doc_id", F.col("doc_id").cast("string")).collect())) == sorted(map(str, df.withColumn("doc_id", F.col("doc_id").cast("string")).collect()))
    few = spark.sql("SELECT * FROM token_windows(TABLE(docs_for_sql), most => 4, overlap => 1)")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, extract.token_windows(docs, 4, 1).collect()))
    joined = spark.sql("SELECT d.chunk_index, l.law_code FROM docs_for_sql d JOIN law_references(TABLE(SELECT doc_id, text FROM docs_for_sql WHERE doc_id = 1), width => 5) l ON l.doc_id = d.doc_id WHERE d.chunk_index = 5")
    assert joined.count() == 2
    for wrong in ("token_windows(TABLE(docs_for_sql), least => 1)", "sections(TABLE(SELECT 1 AS doc_id))", "sections(TABLE(docs_for_sql), most => -1)"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {wrong}").collect()
    spark.createDataFrame([(1, "", "2. Hukuk Dairesi", "2020/1", "")], "doc_id long, court string, chamber string, case_no string, decision_no string").createOrReplaceTempView("held")
    spark.createDataFrame([(1, 9, "2. Hukuk Dairesi", "2020/1", None), (2, 9, "x", "2020/1", None)], "citation long, source_doc_id long, chamber string, case_no string, decision_no string").createOrReplaceTempView("cited")
    surface.resolve_views(spark, "cited", "held")
    assert spark.sql("SELECT citation, target_doc_id FROM resolved").collect() == [(1, 1)] and spark.sql("SELECT citation FROM unresolved").collect() == [(2,)]


def test_places(spark):
    from dokuma.operators import evaluate, tables

    r = random.Random(7)
    rows = [(r.choice([None, 1, 2, 3]), r.randint(0, 50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = sorted(tables.placed(df, "a", "b").collect(), key=lambda x: x.place)
    assert [x.place for x in got] == list(range(1, 501)) and [(x.a, x.b) for x in got] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert tables.placed(df.limit(0), "a").count() == 0
    times = spark.createDataFrame([("x", 1.0), ("x", math.nan), ("x", None), ("x", 3.0)], "by string, ms double")
    assert evaluate.latency(times, "by", "ms").collect() == [("x", 3.0, 3.0, 2.0)]


def test_stages_and_downloads(spark, tmp_path):
    from dokuma.operators import records
    from dokuma.operators.stored import StoredTable
    from dokuma.sources import keyed

    def extract(text):
        if text == "away":
            raise OSError("no")
        return text.removesuffix("!"), text.endswith("!")

    sources = spark.createDataFrame([("a", '{"summary": 1}'), ("b", '```json\n{"summary": "x"}\n```'), ("c", '{"summ!'), ("d", "[1]"), ("e", "no"), ("f", "away"), ("g", None)], "stem string, text string")
    single = {r.stem: (r.status, r.payload) for r in records.single_pass(sources.where("stem <> 'g'"), extract).collect()}
    assert single == {"a": ("ok", '{"summary": 1}'), "b": ("ok", '{"summary": "x"}'), "c": ("truncated", None), "d": ("ok", "[1]"), "e": ("invalid_json", None), "f": ("error", None)}
    t = StoredTable(spark, str(tmp_path / "stages"))
    assert records.pending(sources, t, "summary").count() == 7
    records.store_stage(records.run_stage(sources, "summary", extract), t)
    assert [tuple(r) for r in records.outcome_table(t.read()).collect()] == [("summary", 2, 1, 2, 2)]  # a null text is the extractor's error
    left = records.pending(sources, t, "summary")
    assert {r.stem for r in left.collect()} == set("cdefg") and records.pending(sources, t, "metadata").count() == 7 == records.pending(sources, t, "summary", force=True).count()
    records.store_stage(records.run_stage(left, "summary", lambda text: ('{"summary": 2}', False)), t)
    assert [tuple(r) for r in records.outcome_table(t.read()).collect()] == [("summary", 7, 0, 0, 0)]

    base = f"file://{tmp_path}"
    assert keyed.written(spark.createDataFrame([("x/1.md", "one"), ("2.md", None), ("ü.md", "ü")], "key string, text string"), f"{base}/in") == 3
    wanted = spark.createDataFrame([("x/1.md",), ("x/1.md",), ("2.md",), ("none.md",), ("x",), (None,)], "key string")
    first = {r.key: (r.status, r["size"]) for r in keyed.downloaded(wanted, f"{base}/in", f"{base}/out").collect()}
    assert first == {"x/1.md": ("downloaded", 3), "2.md": ("downloaded", 0), "none.md": ("error", None), "x": ("error", None)}
    (tmp_path / "out/x/1.md").write_text("o")  # cut short
    again = {r.key: r.status for r in keyed.downloaded(wanted, f"{base}/in", f"{base}/out").collect()}
    assert again == {"x/1.md": "downloaded", "2.md": "skipped", "none.md": "error", "x": "error"} and (tmp_path / "out/x/1.md").read_text() == "one"


def test_token_chunks(spark):
    import public_tokenizers
    import tiktoken

    from dokuma.functions import tokens
    from dokuma.operators import extract
    from dokuma.plans import catalog, features  # noqa: F401  registers the queries

    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(tokens.encoding(*features.counter())._mergeable_ranks), special_tokens={})
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = lambda t: len(plain.encode_ordinary(t))
    assert {r.doc_id: r.n_tokens for r in catalog.QUERIES["f12_token_counts"](spark, sf).collect()} == {d: count(t) for d, t in texts.items()}
    want = {(str(d), i): c for d, t in texts.items() for i, c in enumerate(extract.chunks_of(t, 256, 32, count))}
    got = {(r.doc_id, r.chunk_index): (r.text, r.token_count) for r in catalog.QUERIES["x05_token_chunks"](spark, sf).collect()}
    assert got == want and all(n == count(t) for t, n in got.values())
    assert all(n <= 256 or len(extract.SENTENCE_END.split(t)) == 1 or n <= 256 + 32 for t, n in got.values())


def test_index_kept_up(spark, clustered, tmp_path):
    df, path = spark.createDataFrame(clustered, VECTORS), str(tmp_path / "index")
    queries = [(i, clustered[i * 50][2]) for i in range(10)]
    q = spark.createDataFrame(queries, "query_id long, query array<double>")
    got = lambda: {(r.query_id, r["rank"]): r.chunk_id for r in vector_index.search(spark, path, q, 10).collect()}
    part = [r for r in clustered if r[0] % 3 == 0]
    assert vector_index.ensure(spark.createDataFrame(part, VECTORS), path, count=12) == "build" and got() == exact(part, queries, 10)
    assert vector_index.ensure(df, path) == "resume" and got() == exact(clustered, queries, 10)
    assert vector_index.ensure(df, path) == "done" and vector_index._numbers(spark, path) == [0, 1]
    assert vector_index.vectors(spark, path).count() == 600
    with pytest.raises(ValueError, match="there is an index"):
        vector_index.build(df, path)
    assert vector_index.ensure(spark.createDataFrame(part, VECTORS), path, count=5) == "recreate" and got() == exact(part, queries, 10)
