"""Ties, files and names as larger tables have them."""

from __future__ import annotations

import hashlib
import os
import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dokuma.functions.text import chamber_key
from dokuma.functions.pieces import pieces
from dokuma.operators import graph, names, records, resolve, retrieve, scoring, search, vector_pairs
from dokuma.plans import loading
from dokuma.plans.catalog import QUERIES
from dokuma.sources import files, keyed


def test_ties_of_a_search(spark, monkeypatch):
    """Documents whose walks differ in the last bits only come in the order of their ids."""
    walked = spark.createDataFrame([(1, 9, 0.1 + 0.2), (1, 2, 0.3), (1, 5, 0.9)], "query_id long, doc_id long, graph double")
    monkeypatch.setattr(graph, "personal_pagerank", lambda *_: walked)
    dense = spark.createDataFrame([(1, 5, 0.8, 1), (1, 6, 0.4, 2)], "query_id long, doc_id long, score double, rank int")
    edges = lambda: spark.createDataFrame([(5, 9), (5, 2)], "src long, dst long")
    found = {r["rank"]: r.doc_id for r in search.search(dense, edges).collect()}
    assert found[1] == 5 and (found[2], found[3]) == (2, 9)


def test_number_of_a_law_in_a_text(spark):
    """A law's own number counts wherever it stands as a run of digits of its own, in a telephone number too."""
    laws = spark.createDataFrame([("Türk Medeni Kanunu", ["MK"], "4721")], "law string, abbreviations array<string>, number string")
    cited = spark.createDataFrame([(f, 3, "Türk Medeni Kanunu", None) for f in "ab"], "file string, index int, law string, law_number string")
    texts = spark.createDataFrame([("a", "+1 (866) 555-4721 the"), ("b", "+1 (866) 555-47210")], "file string, text string")
    assert {r.file: r.verified for r in records.check_laws(cited, texts, laws).collect()} == {"a": True, "b": False}


def alike_names(n: int) -> list[str]:
    return ["Kurul " + hashlib.md5(str(i).encode()).hexdigest()[:24] for i in range(n)]


def test_names_with_one_beginning(spark):
    """Names that share a beginning and few letters: pairs to align are about as many as there are names that are alike."""
    right = alike_names(3000)
    left = [w[: 7 + i % 20] + "z" + w[8 + i % 20 :] for i, w in enumerate(right)] + [w[::-1] for w in right[:500]]
    a, b = (spark.createDataFrame([(w,) for w in x], "name string") for x in (left, right))
    assert names.candidates(a, b, 0.88).count() < 2 * len(right)
    assert {(r.left, r.right) for r in names.closest(a, b).collect()} == set(zip(left, right))


def test_short_names_without_common_pairs_of_letters(spark):
    a, b = (spark.createDataFrame([(w,) for w in x], "name string") for x in (["ab", "b"], ["axb", "b", "c"]))
    assert {tuple(r) for r in names.alike(a, b, 0.75).collect()} == {("ab", "axb", 0.8), ("b", "b", 1.0)}


def test_prefixes_under_one_beginning(spark):
    """A cited name meets the keys that begin with it, not all that share five letters with it."""
    keys = spark.createDataFrame([(w,) for w in alike_names(2000)], "name string").select(chamber_key(F.col("name")).alias("key"))
    cited = spark.createDataFrame([(w[:20],) for w in alike_names(1000)] + [("Kurul",), ("Kuru",), (None,)], "chamber string")
    links = resolve.name_links(cited, keys, None)
    assert {r.name: r.n for r in links.groupBy("name").agg(F.count("*").alias("n")).collect()} == {w[:20]: 1 for w in alike_names(1000)} | {"Kurul": 2000}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan


def test_files_by_folders(spark, tmp_path):
    """Files are listed and read by a task a folder, and handed over by their bytes."""
    rows = spark.createDataFrame([(f"{i % 5}/{i}.txt", None if i == 7 else "ı" * i) for i in range(40)], "key string, text string")
    assert keyed.written(rows, str(tmp_path)) == 40
    (tmp_path / "0" / "bad.txt").write_bytes(b"a\xff")
    texts, listed = files.texts(spark, str(tmp_path), "txt"), files.listing(spark, str(tmp_path), "txt")
    assert texts.rdd.getNumPartitions() == listed.rdd.getNumPartitions() == 6
    assert {r.filename: r.text for r in texts.collect()} == {f"{i}.txt": "" if i == 7 else "ı" * i for i in range(40)} | {"bad.txt": "a�"}
    assert {r.filename: r.length for r in listed.collect()} == {f"{i}.txt": 0 if i == 7 else 2 * i for i in range(40)} | {"bad.txt": 2}


def test_batches_of_large_files():
    whole = [(str(i), 1, "x" * 1_000_000, None) for i in range(40)] + [("gone", 0, None, "no file")]
    got = list(keyed.batches(iter(whole)))
    assert max(b.nbytes for b in got) < 2 * keyed.BATCH_BYTES and [tuple(r.values()) for b in got for r in b.to_pylist()] == whole


def test_embedded_documents(spark, tmp_path):
    one = '{"metadata": {"court": "c", "esas_no": "%d"}, "chunks": [{"chunk_index": 0, "embedding": [0.5]}]}'
    for name, text in {"a": one % 1, "b": f"[{one % 2},\n {one % 3}]", "c": (one % 4)[:20], "d": "", "e": "["}.items():
        (tmp_path / "0").mkdir(exist_ok=True)
        (tmp_path / "0" / f"{name}.json").write_text(text)
    good, bad = files.embedded_documents(spark, str(tmp_path))
    assert {(r.metadata.esas_no, r.chunks[0].embedding[0]) for r in good.collect()} == {("1", 0.5), ("2", 0.5), ("3", 0.5)}
    assert {r[0] for r in bad.collect()} == {(one % 4)[:20], "["}


def test_pieces():
    frames = [pd.DataFrame({"doc_id": range(5000), "text": ["x" * 1000, None] * 2500}), pd.DataFrame({"doc_id": [], "text": []}), pd.DataFrame({"doc_id": [5000], "text": ["y" * 3_000_000]})]
    got = list(pieces(iter(frames), "text"))
    assert pd.concat(got).doc_id.tolist() == list(range(5001)) and len(got) > 5
    assert max(p.text.str.len().sum() for p in got[:-1]) <= 1 << 19


def test_scores_in_pieces(spark):
    """A batch's rows of scores are handed over in pieces, and all of them."""
    whole = scoring.pieces
    scoring.pieces = lambda frames, *texts: whole(frames, *texts, most=2_000)
    try:
        both = spark.createDataFrame([(str(i), '{"court": "c"}') for i in range(100)], "file string, record string")
        got = scoring.scored(both, both).groupBy("file").agg(F.count("*").alias("n")).collect()
    finally:
        scoring.pieces = whole
    assert len(got) == 100 and {r.n for r in got} == {len(scoring.FIELDS)}


def test_most_cited_without_components(spark, monkeypatch):
    """The most cited documents need no components, which take rounds of joins."""
    monkeypatch.setattr(graph, "components", None)
    nodes = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    edges = spark.createDataFrame([(0, 3), (1, 3), (2, 4), (3, 4), (4, 1)], "src long, dst long")
    monkeypatch.setattr(loading, "nodes", lambda *_: nodes)
    monkeypatch.setattr(loading, "edges", lambda *_: edges)
    assert [tuple(r) for r in QUERIES["q18_most_cited"](spark, "").collect()] == [(3, 2), (4, 2), (1, 1), (0, 0), (2, 0)]


def test_words_scored_in_one_pass(spark, tmp_path):
    """Words as they stand score as counted terms do; what is written and shuffled are queried terms and one row a document."""
    texts = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 7, 300)) + " the the" * (i % 3)) for i in range(60)] + [(60, None), (61, "the"), (61, "other the")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "the"), (1, "waa"), (2, "none"), (2, None)], "query_id int, term string")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    written = []
    whole, retrieve.saved = retrieve.saved, lambda df, name: written.append(whole(df, name)) or written[-1]
    try:
        scored = {(r.query_id, r.doc_id): r.score for r in retrieve.bm25(q, words.withColumn("tf", F.lit(1))).collect()}
    finally:
        retrieve.saved = whole
    assert max(t.count() for t in written) <= 3 * 61
    assert scored == {(r.query_id, r.doc_id): r.score for r in retrieve.bm25(q, retrieve.terms(docs)).collect()}
    assert {d for _, d in scored} == {i for i in range(61) if i % 3 or i % 7 == 0 and i < 60} - {60} | {61}


def test_words_stemmed_once(spark):
    """Different words are stemmed, not those of every document; the scores are those of counted stems."""
    forms = ["davaların", "davası", "dava", "mahkemenin", "kanunun", "Kanunu"]
    docs = spark.createDataFrame([(i, " ".join(forms[i % 4 :])) for i in range(50)] + [(50, None)], "doc_id long, text string")
    words, counted = retrieve.words(docs), retrieve.terms(docs, stems=True)
    stems = retrieve.stems_of(words)
    assert stems.count() == len(forms) and {(r.word, r.term) for r in stems.collect()} >= {("davaların", "dava"), ("kanunu", "kanun")}
    assert "regexp_replace" not in counted._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.term, r.tf) for r in counted.where("doc_id = 1").collect()} == {("dava", 2), ("mahkeme", 1), ("kanun", 2)}
    q = spark.createDataFrame([(1, "dava"), (1, "kanun"), (2, "mahkeme"), (3, "davası")], "query_id int, term string")
    get = lambda rows: {(r.query_id, r.doc_id): round(r.score, 12) for r in rows.collect()}
    scored = get(retrieve.bm25(q, words.withColumn("tf", F.lit(1)), stems=stems))
    assert scored == get(retrieve.bm25(q, counted)) and {k for k, _ in scored} == {1, 2} and len(scored) == 100


def test_rounds_without_broadcasts(spark, monkeypatch):
    """The rounds of walks send no tables through the driver; many parts of a query and one give the same."""
    links = spark.createDataFrame([(q, i, (i * 7 + q) % 40) for q in (1, 2) for i in range(30)], "query_id long, src long, dst long")
    nodes = spark.createDataFrame([(q, i) for q in (1, 2, 3) for i in range(40)], "query_id long, doc_id long")
    seeds, plans, whole = nodes.where("doc_id % 20 = 3"), [], graph.saved

    def saved(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return whole(df, name)

    monkeypatch.setattr(graph, "saved", saved)
    get = lambda: {(r.query_id, r.doc_id): round(r.graph, 9) for r in graph.walks(nodes, seeds, links).collect()}
    one = get()
    rounds = [p for name, p in plans if name == "walks"][1:]
    assert len(rounds) > 5 and not any("Broadcast" in p for p in rounds) and len(one) == 120
    monkeypatch.setattr(graph, "LOCAL_LINKS", 7)
    assert get() == one
    for q in (1, 2, 3):
        want = graph.personal_scores(list(range(40)), [(i, (i * 7 + q) % 40) for i in range(30)] if q < 3 else [], {3, 23})
        assert all(abs(one[q, d] - v) < 1e-8 for d, v in want.items())


def test_visits_in_pieces():
    """However many blocks a batch's vectors visit, a task holds a piece of the visits at a time."""
    counts = np.array([3, 0, 100_000, 1, 0, 2])
    tracemalloc.start()
    got = [(len(i), i[0], b[-1]) for i, b in vector_pairs._dealt(np.full(200, 100_000), 1_000)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 20_000 and {n for n, _, _ in got} == {1_000} and most < 20_000_000
    rows, blocks = (np.concatenate(x) for x in zip(*vector_pairs._dealt(counts, 7)))
    assert list(zip(rows.tolist(), blocks.tolist())) == [(i, b) for i, c in enumerate(counts.tolist()) for b in range(c)]
    assert [x.tolist() for x in next(vector_pairs._dealt(counts, 9, True))] == [list(range(6)), counts.tolist()] and not list(vector_pairs._dealt(counts[:0], 5))


def test_pairs_by_slices(spark, monkeypatch):
    """Slices of any size find the same pairs, each once."""
    v = np.random.default_rng(3).normal(size=(150, 4))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(2)
    for name, n in (("ROWS", 5), ("VISITS", 7), ("MATCHED", 8)):
        monkeypatch.setattr(vector_pairs, name, n)
    got = [(r.a, r.b) for r in vector_pairs.similar(df, 0.6, block=40).collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert sorted(got) == [(a, b) for a in range(150) for b in range(a + 1, 150) if u[a] @ u[b] > 0.6]


def test_entities_of_a_hot_value(spark, monkeypatch):
    """Pairs under one value are joined and counted by as many tasks as their number asks for."""
    monkeypatch.setattr(search, "PAIRS", 100)
    asked = [(q, "law", "L") for q in range(40)] + [(q, "number", f"2001/{q}") for q in range(45)]
    entities = spark.createDataFrame([*asked, (50, "law", "none")], "query_id long, kind string, value string")
    docs = spark.createDataFrame([(i, f"2001/{i}", "") for i in range(50)], "doc_id long, case_no string, decision_no string")
    laws = spark.createDataFrame([(i, "L") for i in range(0, 50, 2)], "doc_id long, article_id string")
    got = search.targeted(entities, docs, laws)
    want = {(q, d): 1 + (q == d) for q in range(40) for d in range(0, 50, 2)} | {(q, q): 1 for q in range(45) if q % 2 or q >= 40}
    assert {(r.query_id, r.doc_id): r.hits for r in got.collect()} == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() >= 1000 / 100


def test_listings_of_a_stream(tmp_path, monkeypatch):
    """A folder is listed a few times, not twice a trigger, and what changes in it between two triggers is seen all the same."""
    monkeypatch.setattr(keyed, "SETTLED", 0.1, raising=False)
    made, real = [], keyed.fs.FileSelector
    monkeypatch.setattr(keyed.fs, "FileSelector", lambda path, **more: made.append(path) or real(path, **more))
    folder = tmp_path / "in" / "a"
    folder.mkdir(parents=True)
    for i in range(0, 400, 2):
        (folder / f"{i:03d}.json").write_text("{}")
    options = {"path": f"file://{tmp_path}/in", "ledger": f"file://{tmp_path}/ledger", "page": "4", "slice": "3"}
    reader, at, got = keyed.StreamReader(options | {"hold": "true"}), {"after": ""}, []

    def trigger():
        nonlocal at
        end = reader.latestOffset()
        keys = [k for p in reader.partitions(at, end) for k in p.keys]
        at = end
        got.extend(k for k, _ in keys)
        return dict(keys)

    trigger()
    time.sleep(0.15)
    for _ in range(40):
        trigger()
    assert sum("ledger" not in p for p in made) <= 8  # 164 before
    assert got == [f"a/{i:03d}.json" for i in range(0, 328, 2)]
    times = os.stat(folder)
    (folder / "329.json").write_text("{}")  # inside the listing that is held
    (folder / "330.json").unlink()
    os.utime(folder, ns=(times.st_atime_ns, times.st_mtime_ns))
    assert list(trigger()) == [f"a/{i}.json" for i in (328, 329, 332, 334)]
    time.sleep(0.15)
    trigger()
    (folder / "344.json").write_text("{   }")  # written over: no change of the folder
    (tmp_path / "in" / "b").mkdir()
    (tmp_path / "in" / "b" / "0.json").write_text("{}")
    assert trigger() == {"a/344.json": 5, "a/346.json": 2, "a/348.json": 2, "a/350.json": 2}
    while trigger():
        pass
    assert got == [f"a/{i:03d}.json" for i in range(400) if (i % 2 == 0 or i == 329) and i != 330] + ["b/0.json"]


def test_listings_of_a_stream_that_changes(tmp_path):
    """Files that arrive as fast as the clock ticks are not missed: a listing as young as the folder's last change is not held."""
    (tmp_path / "in").mkdir()
    reader = keyed.StreamReader({"path": f"file://{tmp_path}/in", "ledger": f"file://{tmp_path}/ledger", "page": "1", "hold": "true"})
    for i in range(300):
        (tmp_path / "in" / f"{i:03d}.json").write_text("{}")
        assert reader.latestOffset() == {"after": f"{i:03d}.json"}


def test_lines_are_parsed_once(spark):
    rows = spark.createDataFrame([("a", '{"k": 1}\n\n{"k":\n[1'), ("b", ""), ("c", None)], "key string, body string").selectExpr("key", "0L AS size", "body", "IF(body IS NULL, 'gone', NULL) AS error")
    for lines, good, bad in ((True, [("a", 1)], [("a", "no JSON object")] * 2 + [("c", "gone")]), (False, [], [("a", "no JSON object"), ("b", "no JSON object"), ("c", "gone")])):
        found, failed = keyed.parsed(rows, "k long", lines=lines)
        assert [(r.key, r.record.k) for r in found.collect() if lines] == good
        assert sorted(tuple(r) for r in failed.collect() if lines or r.key != "a") == [b for b in bad if lines or b[0] != "a"]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_keys_of_names(spark):
    """A name is dealt out by its whole pieces, some tens, not by pairs of rare grams, some hundreds."""
    right = alike_names(400)
    left = [w[: 7 + i % 20] + w[8 + i % 20 :] for i, w in enumerate(right)]
    a, b = (spark.createDataFrame([(w,) for w in x], "name string") for x in (left, right))
    news, alphabet = names._news(b)
    plans = names._plans([29], news, 0.88)
    keys = [names._keys(x, plans[side], alphabet, "rl"[not side]) for side, x in ((False, a), (True, b))]
    assert sum(k.count() for k in keys) < 60 * len(right)
    assert {(r.left, r.right) for r in names.candidates(a, b, 0.88).collect()} == set(zip(left, right))


def test_letters_counted_anew(monkeypatch):
    """Counts that are dropped when there are many do not drop the one that is needed."""
    monkeypatch.setattr(names, "COUNTS", 2)
    pairs = [(f"kurul {i}", f"kurul x{i}") for i in range(20)]
    assert all(names._ratios(*zip(*pairs), 0.88, {}))
    monkeypatch.setattr(names, "COUNTS", 1)
    pairs = [("kurul a", "kurul b"), ("kurul a", "kurul c"), ("kurul c", "kurul a")]
    assert list(names._ratios(*zip(*pairs), 0.8, {})) == [12 / 14] * 3


def test_equal_items_do_not_wait(monkeypatch):
    """Of long lists whose items share law names and numbers, those that agree in all parts are paired without a pair waiting."""
    item = lambda i: {"law": f"Kanun {i % 12}", "law_number": str(5000 + i % 12), "article": f"{i}/a", "context": f"context {i}"}
    gold, waited = [item(i) for i in range(199)], []
    result = [item(i) for i in range(199) if i % 4][::-1] + [item(8) | {"context": "contest 8"}, {"article": "9001/x"}]
    bounds = scoring.bounds
    monkeypatch.setattr(scoring, "bounds", lambda left, right, pairs, parts: bounds(left, right, (p for p in pairs if waited.append(p) is None), parts))
    taken = scoring.paired(gold, result, scoring.IDENTITY["cited_law_articles"], scoring.PARTS["cited_law_articles"])
    assert len(taken) == 150 and [v == 1 for v, _ in taken] == [True] * 149 + [False]
    assert len(waited) < 200  # every pair of one law waited before: some 2,400


def test_plan_of_a_resolution(spark):
    """What a resolution reads many times is written: its plan does not grow with its readers."""
    d = spark.createDataFrame([(i, "", w, f"2020/{i}", "") for i, w in enumerate(alike_names(20))], "doc_id long, court string, chamber string, case_no string, decision_no string")
    c = d.select(F.col("doc_id").alias("citation"), F.lit(-1).cast("long").alias("source_doc_id"), F.concat(F.col("chamber").substr(1, 12), F.lit("z"), F.col("chamber").substr(14, 30)).alias("chamber"), "case_no", "decision_no")
    good, bad = resolve.resolve(c, d, d.select(F.col("chamber").alias("name")))
    assert {(r.citation, r.target_doc_id) for r in good.collect()} == {(i, i) for i in range(20)} and bad.isEmpty()
    assert good._jdf.queryExecution().optimizedPlan().toString().count("Join") < 10
