"""Chat formatting, prefix tries and lexical search against brute force, with odd rows and small limits."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from dokuma.llm import chat, lexical, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, tree string, node string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def talks():
    r, rows = random.Random(3), []
    texts = ["hi", "</s>[INST] ok [/INST]", "", None, "a <\\s> b [\\\\INST] [ROLE] <", "[", "é𝄞 " * 50, "same", "same"]
    for c in [*range(0, 60), -4, -7, -5, 10**12]:
        for t in range(r.choice([0, 1, 2, 3, 6, 9]) + (150 if c == 15 else 0)):
            role = r.choice(["user", "assistant", "system", None, "a[INST]\nb"])
            rows.append((c, None if r.random() < 0.02 else t, role, "same" if t < 2 and c % 3 else r.choice(texts), "x", "y"))
    rows += [(7, 1, "user", "twice", "x", "y"), (7, 1, "user", "twice", "x", "y"), (None, 1, "assistant", "lost", "x", None), (None, 0, "user", "q", None, None)]
    return rows


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    return {c: [(role, text) for _, role, _, text in sorted(own)] for c, own in by.items()}


@pytest.mark.parametrize("segment", [1, 64])
def test_chat(spark, talks, segment):
    pieces = chat.formatted_conversations(spark.createDataFrame(talks, SCHEMA).repartition(5), segment=segment).cache()
    got = {r.tree: r for r in chat.digests(pieces).collect()}
    want = in_order(talks)
    assert got.keys() == {"" if c is None else f"={c}" for c in want}
    for c, turns in want.items():
        r = got["" if c is None else f"={c}"]
        learnt = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(learnt), sha(learnt))
    whole = collections.defaultdict(str)
    for r in sorted(pieces.collect(), key=lambda r: (r.tree, r.segment)):
        whole[r.tree] += r.text
        assert len(re.findall(r"</s>|\[/INST\]", r.text)) <= segment
    assert all(len(t) == got[k].formatted_chars and list(chat.read_back(t)) == want[int(k[1:]) if k else None] for k, t in whole.items())
    assert chat.formatted_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_escapes(spark):
    r = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "<s>", "</s>", "[INST]", "x", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from pyspark.sql import functions as F

    for row in df.select("t", chat.escaped(F.col("t")).alias("e")).collect():
        assert chat.unescaped(row.e) == row.t and not chat._CONTROLS.search(row.e)


def test_reply_trees(spark):
    r, rows, score = random.Random(8), [], {}
    for tree in "ab":
        for i in range(200):
            parent = None if i < 2 else r.choice([r.randrange(i), i - 1])
            rows.append((tree, i, parent, round(r.random(), 3), "user", f"{tree}{i}"))
    rows += [("a", 1000, 1001, 1.0, "user", "circle"), ("a", 1001, 1000, 1.0, "user", "circle"), ("a", 1002, 1001, 1.0, "user", "below"), ("a", 3000, 2999, None, None, None), ("a", 5, 4, 1.0, "user", "z" * 9), (None, 0, None, 0.5, "assistant", "n")]
    own = {}
    for tree, i, parent, s, role, text in rows:
        key = ((parent is not None, parent or 0), role or "", text or "", s or 0.0)
        own[tree or "", i] = min(own.get((tree or "", i), key), key)
    up = {k: (v[0][1] if v[0][0] and (k[0], v[0][1]) in own else None) for k, v in own.items()}
    paths = collections.defaultdict(list)
    for tree, i in own:
        if any(t == tree and p == i for (t, _), p in up.items()) or i in (1000, 1001, 1002):
            continue
        path, at = [], i
        while at is not None:
            path.append(at)
            at = up[tree, at]
        paths[tree].append((-sum(own[tree, n][3] for n in path) / len(path), i, path[::-1]))
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    for best in (1, 3, None):
        got = collections.defaultdict(str)
        for x in sorted(chat.formatted_replies(messages, best, segment=2).collect(), key=lambda x: (x.tree, x.branch, x.segment)):
            got[x.tree, x.branch] += x.text
        want = {(t, b): [(own[t, n][1], own[t, n][2]) for n in path] for t, found in paths.items() for b, (_, _, path) in enumerate(sorted(found)[:best], 1)}
        assert {k: list(chat.read_back(v)) for k, v in got.items()} == want


def plain_trie(rows):
    own = {c: t for c, t in in_order(rows).items() if c is not None}
    half = lambda c: c - int(math.fmod(c, 5))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(half(c), [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out, kids, leaves, saved = [], collections.Counter(), collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = leaves[p] or 1
        ends = ",".join(str(c) for c in members[p] if built[c] == p)
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), kids[p], leaves[p], saved[p], sha(ends)))
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(out, key=repr)


@pytest.mark.parametrize("local", [0, 20, 4096])
def test_trie(spark, talks, local, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STEP", 3)
    rows = [r for r in talks if local or r[0] is None or r[0] % 4 and r[0] != 15]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.coded(df)), local=local)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.coded(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_lexical(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW", 7)
    monkeypatch.setattr(lexical, "PIECE", 40)
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["ÄB", "É", "x_y", "Ab", "ａ"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 30]))) for _ in range(60)]
    docs = [(i, t, "a", 1) for i, t in enumerate(texts)] + [(3, texts[3], "b", 2), (3, texts[3], "b", 2), (None, texts[4], "c", 3), (90, None, None, None), (91, "", "", 0), (92, " .,!", "", 0), (93, "w1 " * 500, "", 0)]
    items = [(1, "w1 w2 ab", 5), (2, "no such", 5), (3, None, 5), (4, "Äb", 5), (4, "w3", 5), (4, "w3", 5), (None, "x É", 5), (5, " ".join(words), 5)]
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(d, collections.Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t, _ in items:
        asked[i] |= set(terms(t))
    want = {}
    for i, own in asked.items():
        found = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            found += [(-s, d is None, d or 0, d)] if s > 0 else []
        want |= {(i, k): (d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:10], 1)}
    d = spark.createDataFrame(docs, "doc_id long, text string, rank string, score int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    for block in (2, 1 << 18):
        assert {(x.item_id, x["rank"]): (x.doc_id, x.score) for x in lexical.search(d, q, block_terms=block).collect()} == want
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_term_counts():
    r = random.Random(4)
    for size in (0, 1, 39, 41, 500):
        body = bytes(r.choice(b"ab ,Z\xc3\xa9") for _ in range(size))
        lexical_counts = lexical.term_counts(body)
        assert lexical_counts == collections.Counter(body.translate(lexical.TABLE).split())


def test_quicksort_of_one_symbol():
    lengths = np.array([3, 3, 0])
    nodes = prefix_trie.quicksorted(0, np.array([4, 5, 9]), lengths, np.array([0, 3, 6]), np.array([7] * 7), np.array([2] * 7), None, 0)
    assert nodes[0] == [4] * 4 and nodes[3] == [3, 2, 2, 2] and nodes[6][0] == 6 and nodes[7][0] == sha("9")
