"""Byte-level BPE encoding and decoding by recursive queries, one DuckDB database in every Python worker.

Texts are cut into pre-tokens by the tokenizer's pattern. The pre-tokens that a worker has not met lately become a table
of (word and position in one number, token), one row per byte. A recursive query joins neighbours with the merge table (left, right,
rank) and contracts each word's leftmost pair of least rank, again and again, until no word has a pair left. A pre-token
that is in the vocabulary as a whole is that token. Ids are decoded by an aggregation of the tokens' bytes ordered by
position. Finished words leave the recursion. Batches are bounded by words and by the squares of
their bytes, and results, kept in flat arrays, are forgotten beyond twice ``KEPT`` pieces, so memory is bounded.

Pre-tokens of more than ``LONGEST`` bytes, whose recursion would grow with the square of their length, are encoded by
the same rule with a heap. Null text counts as empty: no tokens. Repeated rows are encoded each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Ragged, places

LONGEST, KEPT = 192, 400_000
BATCH_WORDS, BATCH_SQUARES, TOGETHER = 20_000, 12_000_000, 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"
OTHER_SPACE = re.compile(r"[^\S \n]")
PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
IS_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
IS_CLOSER = np.array([chr(b) in '.,!?;:$#%&*|()"-' for b in range(256)])

ENCODE = """
WITH RECURSIVE st(place, tok, done) AS (
  SELECT place, tok, false FROM start
  UNION ALL
  (WITH a AS MATERIALIZED (
    SELECT place, tok, lead(place) OVER (ORDER BY place) AS nxt, lead(tok) OVER (ORDER BY place) AS nxt_tok, lag(place) OVER (ORDER BY place) AS before FROM st WHERE NOT done
  ), best AS (
    SELECT a.place >> 8 AS word, min((CAST(m.rank AS BIGINT) << 32) | a.place) AS low
    FROM a JOIN merges m ON m.l = a.tok AND m.r = a.nxt_tok WHERE a.place >> 8 = a.nxt >> 8 GROUP BY 1
  )
  SELECT a.place, CASE WHEN a.place = low & 4294967295 THEN CAST(low >> 32 AS INTEGER) ELSE a.tok END, low IS NULL
  FROM a LEFT JOIN best ON best.word = a.place >> 8
  WHERE low IS NULL OR a.before IS NULL OR a.before <> low & 4294967295)
)
SELECT list(place ORDER BY place) AS place, list(tok ORDER BY place) AS ids, string_agg(v.hex, '' ORDER BY place) AS hex
FROM st JOIN vocabulary v ON v.rank = st.tok WHERE done
"""
DECODE = "SELECT list(place ORDER BY place) AS place, list(rank ORDER BY place) AS ids, string_agg(v.hex, '' ORDER BY place) AS hex FROM given JOIN vocabulary v USING (rank)"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """(left, right, rank): every way in which a token is made of two."""
    left, right, whole = [], [], []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                left.append(a)
                right.append(b)
                whole.append(rank)
    return left, right, whole


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Contract the leftmost pair of least rank until none is left, with a heap of pairs."""
    n = len(word)
    end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Coder:
    def __init__(self, path: str, pattern: str, kept: int = KEPT, longest: int = LONGEST):
        import duckdb
        import regex

        self.ranks, self.pattern, self.kept, self.longest = read_ranks(path), regex.compile(pattern), kept, longest
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(x) for x in self.ranks]
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "500MB", "temp_directory": ""})
        l, r, w = merge_rows(self.ranks)  # noqa: E741
        self.db.register("m", pa.table({"l": pa.array(l, pa.int32()), "r": pa.array(r, pa.int32()), "rank": pa.array(w, pa.int32())}))
        self.db.register("v", pa.table({"rank": pa.array(list(self.ranks.values()), pa.int32()), "hex": [x.hex() for x in self.ranks]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocabulary AS SELECT * FROM v")
        self.forget()

    def forget(self) -> dict[str, int]:
        self.pieces: dict[str, int] = {}  # piece -> its place in ``ids`` and ``decoded``
        self.ids, self.decoded = Ragged("<u4"), Ragged("u1")
        return self.pieces

    def add_words(self, words: list[str]) -> None:
        asked, given = [], []
        for x in words:
            b = x.encode()
            if (rank := self.ranks.get(b)) is not None:
                given.append((x, [rank]))
            elif len(b) > self.longest:
                given.append((x, merge_long(b, self.ranks)))
            else:
                asked.append((x, b))
        # The recursion holds less than half the square of a word's bytes in rows: a batch is as long as memory allows.
        work = np.cumsum([len(b) ** 2 for _, b in asked])
        lo = 0
        while lo < len(asked):
            hi = min(lo + BATCH_WORDS, max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + BATCH_SQUARES, "right"))))
            part, lo = asked[lo:hi], hi
            lengths = np.array([len(b) for _, b in part])
            flat = np.frombuffer(b"".join(b for _, b in part), np.uint8)
            word = np.repeat(np.arange(len(part), dtype=np.int64), lengths)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.db.register("start", pa.table({"place": (word << 8) + pos, "tok": self.byte[flat]}))
            got = self.db.sql(ENCODE).to_arrow_table()
            self.keep([x for x, _ in part], got.column("place")[0].values.to_numpy() >> 8, got)
        for lo in range(0, len(given), 50_000):
            part = given[lo : lo + 50_000]
            lengths = [len(ids) for _, ids in part]
            rank = np.fromiter((i for _, ids in part for i in ids), np.int32, sum(lengths))
            self.db.register("given", pa.table({"place": np.arange(len(rank)), "rank": rank}))
            self.keep([x for x, _ in part], np.repeat(np.arange(len(part)), lengths), self.db.sql(DECODE).to_arrow_table())

    def keep(self, words: list[str], word: np.ndarray, got: pa.Table) -> None:
        """The ids of these words and their bytes, word being the number of each id's word."""
        self.pieces.update(zip(words, range(self.ids.count, self.ids.count + len(words))))
        ids = got.column("ids")[0].values.to_numpy()
        self.ids.add(ids, np.bincount(word, minlength=len(words)))
        self.decoded.add(np.frombuffer(bytes.fromhex(got.column("hex")[0].as_py()), np.uint8), np.bincount(word, self.sizes[ids], len(words)).astype(np.int64))

    def learn(self, new: set[str]) -> None:
        """Make these pieces known."""
        words, several, known = set(), [], self.pieces
        for x in new:
            if PLAIN.fullmatch(x):
                words.add(x)
            elif len(tokens := self.pattern.findall(x)) == 1:
                words.add(x)
            else:
                several.append((x, tokens))
                words.update(t for t in tokens if t not in known)
        self.add_words(sorted(words))
        for lo in range(0, len(several), 4096):
            part = several[lo : lo + 4096]
            at = np.fromiter((known[t] for _, tokens in part for t in tokens), np.int64)
            last = np.cumsum([len(tokens) for _, tokens in part]) - 1
            known.update(zip([x for x, _ in part], range(self.ids.count, self.ids.count + len(part))))
            for store in (self.ids, self.decoded):
                flat, ends = store.take(at)
                store.add(flat, np.diff(ends[last], prepend=0))

    def code(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids, and its bytes decoded from them. Texts are handled together up to ``TOGETHER`` bytes, or one text."""
        held, size = [], 0
        for text in texts:
            own = (text or "").encode()
            if held and size + len(own) > TOGETHER:
                yield from self.code_together(held)
                held, size = [], 0
            held.append((text or "", own))
            size += len(own)
        if held:
            yield from self.code_together(held)

    def code_together(self, texts: list[tuple[str, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat, counts = pieces_of(texts, self.pattern)
        if self.decoded.used > 64 * self.kept:  # long pieces
            self.forget()
        told = flat.dictionary_encode()  # every different piece is looked up once
        at = places(self.pieces, told.dictionary.to_pylist(), self.learn, 2 * self.kept, self.forget)  # may replace the tables
        at = at[told.indices.to_numpy()]
        ids, id_ends = self.ids.take(at)
        decoded, byte_ends = self.decoded.take(at)
        id_stops, byte_stops = (np.concatenate([[0], x])[counts].tolist() for x in (id_ends, byte_ends))
        a = b = 0
        for c, d in zip(id_stops, byte_stops):
            yield ids[a:c], decoded[b:d]
            a, b = c, d


def pieces_of(texts: list[tuple[str, bytes]], pattern) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts (as strings and bytes) one after the other, and how many there are up to each text's end.
    A piece ends where a blank or line end follows something else; no pre-token crosses that when these are the text's
    only white space. Other texts are cut into their pre-tokens. Of a blank, letters and punctuation the latter is a piece."""
    data = b"".join(own for _, own in texts)
    if not data:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    flat = np.frombuffer(data, np.uint8)
    blank = (flat == 32) | (flat == 10)
    first = np.empty(len(flat), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    stops = np.cumsum([len(own) for _, own in texts])
    begins = stops - [len(own) for _, own in texts]
    first[begins[begins < stops]] = True
    for (text, _), lo, hi in zip(texts, begins.tolist(), stops.tolist()):
        if OTHER_SPACE.search(text):
            lengths = [len(t.encode()) for t in pattern.findall(text)]
            first[lo:hi] = False
            first[lo + np.cumsum(lengths) - lengths] = True
    letter, closer = IS_LETTER[flat], IS_CLOSER[flat]
    high = np.flatnonzero(flat >= 128)
    if len(high):
        own, before = flat[high], flat[high - 1]  # a text's first byte is no continuation
        latin = (before == 0xC3) & (own != 0x97) & (own != 0xB7) | (before >= 0xC4) & (before <= 0xC8) | (before == 0xC9) & (own < 0x90)
        letter[high] = (own >= 0xC3) & (own <= 0xC9) | (own < 0xC0) & latin
    starts = np.flatnonzero(first)
    odd = ~(letter | closer)
    odd[1:] |= letter[1:] & closer[:-1]
    odd[starts] = ~(letter[starts] | (flat[starts] == 32))
    odds = np.cumsum(odd, dtype=np.int32)
    turn = np.flatnonzero(closer[1:] & letter[:-1] & ~first[1:]) + 1
    ends = np.append(starts[1:], len(flat)) - 1
    plain = odds[ends] == odds[starts] - odd[starts]
    first[turn[plain[np.searchsorted(starts, turn, "right") - 1]]] = True
    cuts = np.flatnonzero(first)
    bounds = np.append(cuts, len(flat)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(bounds), pa.py_buffer(data)), np.searchsorted(cuts, stops)


_LOADED: dict[str, Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if path not in _LOADED:
        _LOADED[path] = Coder(path, pattern)
    return _LOADED[path]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, keep: bool = True) -> DataFrame:
    """One row per document in the columns of SCHEMA; ids (little-endian 32-bit) and decoded are null unless keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                texts, rows = part.column(1).to_pylist(), []
                for ids, decoded in own.code(texts):
                    rows.append((len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), *((ids.tobytes(), decoded.tobytes()) if keep else (None, None))))
                n, a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(c, pa.binary()), pa.array(d, pa.binary())], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False).drop("ids", "decoded")
