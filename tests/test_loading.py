"""Loading, embedding, searches with their fallback, streams and counts, on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dokuma.operators import embed, evaluate, ingest, search, tables
from dokuma.streaming import incremental


def test_document_rows(spark):
    schema = "filename string, document_id string, court string, court_name string, case_no string, decision_no string, decision_date date, keywords array<string>"
    rows = [("a/b.x.md", None, "YARGITAY", "2. Ceza Dairesi", "2019/1", None, None, ["k"]), ("c.md", "", None, None, None, None, None, None), ("d.md", "id", "Özel", "", None, None, None, [])]
    got = {r.filename: r for r in ingest.document_rows(spark.createDataFrame(rows, schema)).collect()}
    a, c, d = got["a/b.x.md"], got["c.md"], got["d.md"]
    assert (a.doc_id, a.court, a.law_branch, a.court_level, a.topic_keywords) == ("b.x", "Yargıtay", "ceza", 3, ["k"])
    assert (c.doc_id, c.court, c.law_branch, c.court_level, c.topic_keywords) == ("c", "", "", 0, [])
    assert (d.doc_id, d.court, d.court_level) == ("id", "özel", 0)


def test_embedding_with_failures(spark):
    def make():
        calls = []

        def embedder(texts):
            calls.append(texts)
            if len(calls) < 3:
                raise embed.Busy
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[float(len(t))] for t in texts]

        return embedder

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", None, "bad", "three"])], "id long, text string").coalesce(1)
    waits = []
    assert embed.patient(make(), ["x"], None, waits.append) == [[1.0]] and waits == [1.0, 2.0]
    with pytest.raises(embed.Busy):
        embed.patient(make(), ["x"], 2, waits.append)
    got = {r.id: (r.embedding, r.status) for r in embed.embed(rows, make, tries=5, prefix="p").collect()}
    assert got == {0: ([4.0], "ok"), 1: ([1.0], "ok"), 2: (None, "ValueError: bad text"), 3: ([6.0], "ok")}
    assert embed.embed(rows.limit(0), make).count() == 0
    v = embed.hashing(8)(["a b a", ""])
    assert sum(x * x for x in v[0]) == pytest.approx(1) and v[1] == [0.0] * 8


def test_routing():
    assert embed.client_for("BAAI/bge-m3") == "compatible" and embed.client_for("gemini-embedding-2-preview", {"gemini": "k"}) == "gemini"
    with pytest.raises(ValueError):
        embed.client_for("gemini-embedding-2-preview")
    with pytest.raises(ValueError):
        embed.client_for("other")
    assert embed.extraction_backend("claude-x", "http://a", {"anthropic": "k"}) == "compatible"
    assert embed.extraction_backend("claude-x", keys={"anthropic": "k"}) == "anthropic" and embed.extraction_backend("claude-x", keys={"gemini": "k"}) == "gemini"
    with pytest.raises(RuntimeError):
        embed.extraction_backend("x", keys={"anthropic": "k"})


def test_search_falls_back(spark):
    dense = spark.createDataFrame([(1, "a", 0.8, 1), (1, "b", 0.4, 2)], "query_id int, doc_id string, score double, rank int")
    edges = spark.createDataFrame([("a", "c"), ("c", "b")], "src string, dst string")
    with_graph = {r.doc_id: r for r in search.search(dense, lambda: edges, seeds=1).collect()}
    assert with_graph.keys() == {"a", "b", "c"} and with_graph["c"].mode == "graph"

    def missing():
        return spark.read.parquet("/no/such/edges")

    for e, use in ((missing, True), (None, True), (lambda: edges, False)):
        assert [(r.doc_id, r.score, r.mode) for r in search.search(dense, e, use_graph=use).orderBy("rank").collect()] == [("a", 1.0, "dense"), ("b", 0.5, "dense")]
    with pytest.raises(ValueError):
        search.search(dense, None, k=101)
    assert search.search(dense.limit(0), lambda: edges).count() == 0


def test_latency_of_one_large_group(spark):
    rng = random.Random(3)
    rows = [("a" if i % 10 else None, float(rng.randrange(400))) for i in range(3000)] + [("b", 7.0), ("c", None)]
    got = {r.k: (r.p50, r.p95, round(r["mean"], 6)) for r in evaluate.latency(spark.createDataFrame(rows, "k string, ms double").repartition(7), "k", "ms").collect()}
    for k in ("a", "b", None):
        x = sorted(v for g, v in rows if g == k)
        assert got[k] == (x[len(x) // 2], x[int(len(x) * 0.95)], round(sum(x) / len(x), 6))
    assert "c" not in got


def test_newest_by_stream(spark, tmp_path):
    schema = "k long, ts long, v string"
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(1000), str(i)) for i in range(600)]
    for i in range(3):
        spark.createDataFrame(rows[200 * i : 200 * i + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.upsert_stream(incremental.file_stream(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/t", ["k"], f"{tmp_path}/c", "ts", 8).awaitTermination()
    want = {}
    for k, ts, v in rows:
        want[k] = max(want.get(k, (-1, "")), (ts, v))
    got = [(r.k, (r.ts, r.v)) for r in incremental.current(spark, f"{tmp_path}/t", schema).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert incremental.current(spark, f"{tmp_path}/none", schema).count() == 0


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "x", 5), (1, "y", 4), (3, "z", 1), (3, "w", 2)], "k int, v string, t int")
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], order="t").collect()} == {(1, "x", 5), (2, "b", 1), (3, "w", 2)}
    assert {tuple(r) for r in tables.upsert(old, new, ["k"], only=["v"], order="t").collect()} == {(1, "x", 1), (2, "b", 1), (3, "w", 2)}


def test_progress_and_report(spark, tmp_path):
    p = ingest.Progress(spark, f"{tmp_path}/progress")
    assert p.state() == {}
    p.note("schema")
    p.note("offset", 10)
    p.note("offset", 20)
    assert p.state() == {"schema": True, "offset": 20}
    p.finish()
    assert p.state() == {}
    shown = ingest.write_report(spark.createDataFrame([("court", 1.0), ("summary", 0.125)], "field string, score double"), f"{tmp_path}/report")
    assert shown.splitlines() == ["summary   12.50 %", "court    100.00 %"] and spark.read.json(f"{tmp_path}/report").count() == 2


def test_vector_table(spark, tmp_path):
    rows = spark.range(25).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0)).alias("vector")).coalesce(1)
    ingest.write_vectors(rows, f"{tmp_path}/v", 10)
    back = spark.read.parquet(f"{tmp_path}/v")
    assert len(back.inputFiles()) == 3 and ingest.vector_ids(back).count() == 25
    (tmp_path / "gold.json").write_text('{"queries": [{"id": "Q1"}]}')
    assert ingest.read_json(spark, f"{tmp_path}/gold.json", "queries array<struct<id: string>>").first().queries[0].id == "Q1"


def test_dense_search_by_blocks(spark, monkeypatch):
    import numpy as np

    from dokuma.operators import retrieve

    rng = np.random.default_rng(4)
    v = np.concatenate([x := rng.normal(size=(300, 6)), x[:100]])  # a quarter occurs twice: ties go to the smaller id
    v[50] = 0
    rows = [(i, i % 7, [float(y) for y in x]) for i, x in enumerate(v)] + [(400, 0, None), (401, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, doc_id long, vector array<double>").repartition(3)
    queries = vectors.where("chunk_id % 40 IN (1, 10)").select(F.col("chunk_id").cast("string").alias("query_id"), F.col("vector").alias("query"))
    unit = {i: x / np.sqrt((x * x).sum()) for i, x in enumerate(v) if x.any()}
    want = {}
    for r in queries.collect():
        if r.query is not None and None not in r.query and any(r.query):
            mine = np.array(r.query) / np.sqrt((np.array(r.query) ** 2).sum())
            want[r.query_id] = sorted(((-round(float(mine @ x), 9), i) for i, x in unit.items()))[:30]
    assert len(want) == 19  # the query of the zero vector takes no part
    for blocks in (1 << 22, 400):
        monkeypatch.setattr(retrieve, "PAIRS_AT_ONCE", blocks)
        got = {}
        for r in retrieve.dense_topk(queries, vectors, 30).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((-round(r.score, 9), r.chunk_id))
        assert got == want
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", 5)
    assert retrieve.dense_topk(queries, vectors, 30).count() == 19 * 30
    assert retrieve.dense_topk(queries.limit(0), vectors, 3).count() == 0


def test_token_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    from dokuma.functions import tokens
    from dokuma.operators import extract

    path = P.path("byte_bpe_50k.tiktoken")
    texts = ["A court decided.  Twice!", "", None, "Yargıtay 2. Hukuk Dairesi"]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN).collect()}
    enc = tokens.encoding(path, P.PATTERN)
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)} and all(enc.decode(enc.encode_ordinary(t or "")) == (t or "") for t in texts)
    assert [n for _, n in extract.chunks_of(texts[0], 5, 1, tokens.counter(path, P.PATTERN))] == [len(enc.encode_ordinary(x)) for x in ("A court decided.", "Twice!")]


def test_resume(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "k int")
    assert [r.k for r in tables.remaining(rows, rows.where("k % 2 = 0"), "k", limit=2).collect()] == [1, 3]
    assert tables.remaining(rows, rows, "k", force=True).count() == 6
