"""MinHash near-duplicates through a multi-index Hamming join, confirmed on full shingle sets.

1. A document's set holds hashes of its distinct word shingles (ASCII letters in lower case, words split at ASCII white
   space; a text with fewer words is one shingle). Equal sets form a class; classes with empty sets link with nothing.
2. A class's signature is ``VALUES`` b-bit minimum values. Two sets with similarity J differ in (1 - J) of them on
   average; the join keeps pairs that differ in at most R = 2 * chunks - 1. By pigeonhole such a pair has a chunk with at
   most one error, so every chunk is posted once for each of its values left out: pairs within R always meet.
   With 48 values in 12 chunks, a pair at J = 0.8 exceeds R = 23 with probability 3e-6, less above.
3. Members of a posting list are joined by a union-find on their signatures' distance, as one pass over a sorted
   partition; no list is expanded into its pairs, and what leaves a task is a forest.
4. The components of these candidate edges are split into blocks by set size, and each pair of blocks whose sizes can
   reach the similarity is compared exactly, on full sets, in one task. Each such task, again, gives a forest of true
   links. The components of all true links are the result. A group of thousands of near copies thus costs some block
   pairs and no row per pair; groups within one block are compared once.

Null and empty texts have empty sets and stay alone. A null doc_id takes part under no id: such rows come back with null
component and kept = true. Repeated doc_ids share one component. Extra columns are ignored (``deduplicated`` keeps them,
whatever their names). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, row_key, text_key, written

VALUES, CHUNK, BITS = 48, 4, 16
BLOCK = 256
MASK = (1 << 64) - 1
SIGNATURE = "class binary, n int, rk long, doc_id long, signature binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (public-domain splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


_WORDS = WordHashes()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out + h[k : k + n] * np.uint64(2 * k + 1))
    return np.unique(out)


def signature(hashes: np.ndarray, values: int = VALUES) -> np.ndarray:
    """The low 16 bits of ``values`` minimum hashes."""
    seeds = mixed(np.arange(1, values + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(values, np.uint64(MASK))
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096, None] * seeds
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, part.min(0))
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def postings(sig: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """64-bit keys of a batch of signatures (rows): each chunk with each one of its values left out."""
    out = []
    for c in range(sig.shape[1] // chunk):
        own = sig[:, c * chunk : (c + 1) * chunk].astype(np.uint64)
        for skip in range(chunk):
            key = np.full(len(sig), np.uint64(c * chunk + skip + 1))
            for k in range(chunk):
                if k != skip:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
            out.append(key)
    return np.stack(out, 1)


class Union(dict):
    """Union-find whose roots are the smallest members."""

    def root(self, x):
        while (p := self.get(x, x)) != x:
            self[x] = self.get(p, p)
            x = p
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)

    def edges(self) -> Iterator[tuple]:
        for x in list(self):
            if (r := self.root(x)) != x:
                yield x, r


def near_in_list(ids: list[int], sigs: np.ndarray, most: int, found: Union) -> None:
    """Join the members of one posting list within ``most`` differing values. The first member left takes all that are
    near it, until none is left; so a list of near copies takes a pass or two. Groups then meet where any two of their
    members are near; none is near another group's first member, or that would have taken it."""
    rest, groups = np.arange(len(ids)), []
    while len(rest):
        near = (sigs[rest] != sigs[rest[0]]).sum(1) <= most
        groups.append(rest[near])
        rest = rest[~near]
    for g in groups:
        for x in g[1:].tolist():
            found.join(ids[x], ids[g[0]])
    root, others, owner = list(range(len(groups))), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b, g in enumerate(groups):
        apart = np.ones(len(others), bool)  # others: members of the groups before that are no first ones
        for m in g.tolist():
            at = np.flatnonzero(apart)
            if not len(at):
                break
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                for o in np.unique(owner[part[(sigs[others[part]] != sigs[m]).sum(1) <= most]]).tolist():
                    found.join(ids[m], ids[groups[o][0]])
                    was = root[o]
                    root = [root[b] if r == was else r for r in root]
            apart[at] = np.array(root)[owner[at]] != root[b]
        others, owner = np.concatenate([others, g[1:]]), np.concatenate([owner, np.full(len(g) - 1, b)])


def sorted_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of equal keys with two members or more, of batches (key, id, signature) sorted by key."""
    key, ids, sigs = None, [], []
    for batch in batches:
        k, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        cut = np.flatnonzero(np.diff(k)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
        wide = np.flatnonzero(ends - starts > 1).tolist()
        touched = sorted({0, len(starts) - 1, *wide})  # single rows inside a batch are lists of one
        for r in touched:
            a, b = int(starts[r]), int(ends[r])
            if key is None or k[a] != key:
                if len(ids) > 1:
                    yield ids, sigs
                key, ids, sigs = k[a], [], []
            ids += i[a:b].tolist()
            sigs += batch.column(2).slice(a, b - a).to_pylist()
    if len(ids) > 1:
        yield ids, sigs


def links_in(a: list[np.ndarray], b: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (index in a, index in b) with den * |x & y| >= num * |x | y|, counted exactly: for every x, how many
    of its hashes each y holds. b None: pairs within a."""
    own = a if b is None else b
    n = np.array([len(x) for x in own])
    flat, who = np.concatenate(own), np.repeat(np.arange(len(own)), n)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    for i, x in enumerate(a):
        lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
        take = hi - lo
        if not take.sum():
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
        both = np.bincount(who[at], minlength=len(own))
        ok = den * both >= num * (len(x) + n - both)
        if b is None:
            ok[: i + 1] = False
        for j in np.flatnonzero(ok).tolist():
            yield i, j


def grouped(docs: DataFrame, *, shingle: int = 5, num: int = 80, den: int = 100, values: int = VALUES, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (class or null, n, rk, doc_id, signature), one per input row; classes (class, doc_id, rk, n, signature, id),
    doc_id and rk being those that stand for the class; and (node, root) of the class ids that are linked."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    most = 2 * (values // CHUNK) - 1

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cls, n, sig = [], [], []
                for text in part.column(1).to_pylist():
                    h = shingle_hashes(text, shingle)
                    n.append(len(h))
                    cls.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    sig.append(signature(h, values).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(n, pa.int32()), part.column(2), part.column(0), pa.array(sig, pa.binary())], ["class", "n", "rk", "doc_id", "signature"])

    rows = written(src.select("doc_id", "text", row_key().alias("rk")).mapInArrow(sign, SIGNATURE), "signatures")
    # Of each class the least (doc_id, rk) stands for it; null ids never do if there is another.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("lead")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(lead, F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes.select("class", F.col("lead.doc_id").alias("doc_id"), F.col("lead.rk").alias("rk"), "n", "signature", F.monotonically_increasing_id().alias("id")), "classes")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                if not part.num_rows:
                    continue
                raw = part.column(1).to_pylist()
                keys = postings(np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1))
                low = np.frombuffer(b"".join(raw), np.uint16).reshape(len(raw), -1).astype(np.uint8)  # of each value 4 bits
                low = ((low[:, ::2] & 15) << 4) | (low[:, 1::2] & 15)
                per = keys.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), per)), pa.array([x for x in map(bytes, low) for _ in range(per)], pa.binary())], ["key", "id", "low"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Union()
        for ids, lows in sorted_lists(batches):
            packed = np.frombuffer(b"".join(lows), np.uint8).reshape(len(lows), -1)
            near_in_list(ids, np.concatenate([packed >> 4, packed & 15], 1), most, found)
            if len(found) > 500_000:
                yield edge_batch(found)
                found = Union()
        yield edge_batch(found)

    posted = classes.select("id", "signature").mapInArrow(post, "key long, id long, low binary")
    listed = posted.repartition("key").sortWithinPartitions("key", "id")
    candidates = components(listed.mapInArrow(gather, "a long, b long"))

    # Blocks of each candidate component, in the order of set size: a position within the component by a window whose
    # partitions hold ids only.
    from pyspark.sql import Window

    sized = candidates.join(classes.select(F.col("id").alias("node"), "n", "rk", "class"), "node")
    by_size = Window.partitionBy("root").orderBy("n", "node")
    placed = sized.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / block).cast("int"))
    placed = written(placed.select("root", "block", "node", "n", "rk", "class"), "blocks")
    spans = placed.groupBy("root", "block").agg(F.min("n").alias("least"), F.max("n").alias("largest"))
    left, right = spans.alias("x"), spans.alias("y")
    reach = (F.col("x.root") == F.col("y.root")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.largest") * den >= F.col("y.least") * num)
    pairs = left.join(right, reach).select(F.col("x.root").alias("root"), F.col("x.block").alias("bx"), F.col("y.block").alias("by"))
    asks = pairs.select("root", F.col("bx").alias("block"), "bx", "by").union(pairs.where("bx <> by").select("root", F.col("by").alias("block"), "bx", "by"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                keep, hashes = [], []
                for k, (text, cls) in enumerate(zip(part.column("text").to_pylist(), part.column("class").to_pylist())):
                    h = shingle_hashes(text, shingle)
                    if xxhash.xxh3_128_digest(h.tobytes()) == cls:  # else another text with this row key
                        keep.append(k)
                        hashes.append(h.tobytes())
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("block"), part.column("node"), pa.array(hashes, pa.binary())], ["root", "block", "node", "hashes"])

    texts = src.select("text", row_key().alias("rk")).join(placed.hint("shuffle_hash"), "rk")
    whole = texts.select("text", "class", "root", "block", "node").mapInArrow(sets, "root long, block int, node long, hashes binary")
    dealt = whole.join(asks, ["root", "block"])

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        found = Union()
        first = pdf[pdf.block == key[1]]
        second = pdf[pdf.block == key[2]] if key[1] != key[2] else None
        a = [np.frombuffer(x, np.uint64) for x in first.hashes]
        b = None if second is None else [np.frombuffer(x, np.uint64) for x in second.hashes]
        if a and (b is None or b):
            x, y = first.node.tolist(), (first if second is None else second).node.tolist()
            for i, j in links_in(a, b, num, den):
                found.join(x[i], y[j])
        return pd.DataFrame(list(found.edges()), columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("root", "bx", "by").applyInPandas(compare, "a long, b long")
    return rows, classes, components(links)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: (doc_id, n_shingles long, component_id long, kept boolean, rk long); rk is row_key of the
    row. kept is true for the rows whose doc_id is the smallest of their component. Options as for ``grouped``."""
    rows, classes, groups = grouped(docs, **options)
    # A component's id is its least doc_id: over classes first, then one row per class joins the rows.
    named = groups.join(classes.select(F.col("id").alias("node"), "class", "doc_id"), "node")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("class", "id", "doc_id").join(groups.withColumnRenamed("node", "id"), "id", "left").join(least, "root", "left")
    of_class = of_class.select("class", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n", "class", "rk").join(of_class, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "rk")


def edge_batch(found: Union) -> pa.RecordBatch:
    edges = list(found.edges())
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], ["a", "b"])


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of the input: that of the least doc_id, of several texts under it the one of the least
    row key. A null id stands for a group only where no other id does. Of repeated rows (same id and text) one stays;
    empty texts are groups of their own."""
    rows, classes, groups = grouped(docs, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("first")
    linked = classes.select("id", "doc_id", "rk").join(groups.withColumnRenamed("node", "id"), "id", "left")
    chosen = linked.groupBy(F.coalesce("root", "id").alias("root")).agg(first).select("first.rk")
    kept = chosen.union(rows.where("class IS NULL").select("rk")).distinct()
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), row_key().alias("rk"), F.col("doc_id").alias("id"), text_key().alias("content"))
    once = marked.join(kept, "rk", "left_semi").dropDuplicates(["rk", "id", "content"])
    return once.select(*[F.col("record")[c].alias(c) for c in docs.columns])


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=2).drop("rk")


OP8_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM docs),
sets AS (SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) AS c, any_value(s) AS s, list(doc_id) AS members FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY md5(array_to_string(s, E'\n'))),
counted AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
freq AS (SELECT g, count(*) AS f FROM counted GROUP BY g),
ordered AS (SELECT c, n, g, row_number() OVER (PARTITION BY c ORDER BY f, g) AS p FROM counted JOIN freq USING (g)),
prefix AS (SELECT c, n, g FROM ordered WHERE p <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b USING (g) WHERE a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM cand JOIN counted x ON x.c = a JOIN counted y ON y.c = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT e.b, r.r FROM reach r JOIN both_ways e ON e.a = r.c WHERE r.r <= e.b),
lowest AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c),
member AS (SELECT unnest(members) AS doc_id, component_id FROM classes JOIN lowest USING (c))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM sizes LEFT JOIN member USING (doc_id)
"""
