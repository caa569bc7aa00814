"""Repeated queries and candidates, ties, clashing columns, empty tables: vector searches, encoding, quality."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dokuma.llm import ball_tree, bpe, permutation_index
from dokuma.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, rank int, query_id string, score double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    out = [(i, [float(r.randint(-3, 3)) for _ in range(6)], 1, "x", 0.5) for i in range(300)]
    out += out[:3] * 2 + out[100:101] + [(200, [1.0] * 6, 1, "y", None), (10, out[11][1], 2, None, None)]  # repeats, a second vector, ties
    return out + [(20, None, 1, "z", None), (None, [1.0] * 6, 1, "z", None), (40, [float("nan")] * 6, 1, "z", None)]


def plain(rows, step, k, change, zero):
    good = [(i, np.array(v)) for i, v, *_ in rows if i is not None and v is not None and np.isfinite(v).all() and (zero or any(v))]
    asked = {}
    for i, v in good:
        if i % step == 0 and (i not in asked or v.tolist() < asked[i].tolist()):
            asked[i] = v
    out = {}
    for q, v in asked.items():
        scored = sorted((-float(change(v) @ change(w)), i) for i, w in good if i != q)[:k]
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def test_exact(spark, rows):
    want = plain(rows, 100, 10, lambda v: np.floor(1024 * v), True)
    for df in (spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows, SCHEMA).repartition(5)):
        got = ball_tree.search(df, "vec_id", "embedding", lambda i: i % 100 == 0, 10, shard=64).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_nearest(spark, rows):
    want = plain(rows, 20, 20, lambda v: v, False)
    for df in (spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows, SCHEMA).repartition(5)):
        got = permutation_index.search(df, "vec_id", "embedding", lambda i: i % 20 == 0, 20, share=1.0).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert permutation_index.search(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", lambda i: i % 20 == 0, 20).count() == 0


def test_encoding(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "Hello  wörld", 7, b"x"), (1, "Hello  wörld", 7, b"x"), (None, "a", 1, None), (2, None, None, None), (2, "", 0, b"")], "doc_id long, text string, n_tokens int, ids binary")
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in out.select(F.col("doc_id"), F.col("n_tokens")).collect())
    assert got[0][0] == 0 and got[1] == got[2] and got[3] == got[4] == (2, 0)


@pytest.mark.parametrize("name", ["op3_permutation_index", "op4_ball_tree", "op10_quality_gam", "op11_chat_format", "op12_lexical_search", "op13_prefix_trie"])
def test_empty_tables(spark, name, tmp_path):
    for table in ("documents", "embeddings", "labels", "benchmark", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == (1 if name == "op11_chat_format" else 0)
