"""Dense retrieval: exact top-k by cosine, an inverted-file index of cells, chunk scores to documents, fusion."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from dokuma.functions import turkish
from dokuma.functions.text import turkish_lower
from dokuma.functions.vectors import cosine, dot, norm, unit
from dokuma.operators.graph import saved

#: Queries and centroids are broadcast up to this many rows (about 100 MB at 1536 dimensions); beyond, they are dealt
#: to blocks of vectors by an equi-join.
BROADCAST_ROWS = 8192
#: So many scores are held at once (32 MB).
PAIRS_AT_ONCE = 1 << 22
#: Centroids are fitted on about so many vectors at most, picked by a hash of the chunk id.
FIT_ROWS = 100_000


def usable(vector: str) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, a length above 0 and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    length = norm(F.col(vector))
    return F.coalesce(F.when(finite, (length > 0) & (length < F.lit(float("inf")))), F.lit(False))


def best(rows: DataFrame, by: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of every ``by`` group; the limit reaches below the shuffle (WindowGroupLimit)."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def pairs(queries: DataFrame, vectors: DataFrame, blocks: int = 64) -> DataFrame:
    """Every query with every vector: by broadcast for a checked number of queries, else block by block."""
    if queries.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return vectors.join(F.broadcast(queries))
    dealt = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return vectors.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")).join(dealt, "block").drop("block")


def scored_blocks(asked: list, vectors: DataFrame, kind: DataType, k: int, probed: dict[int, list[int]] | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score): of every block of vectors what may be among a query's best k, by matrix
    products; what is below a k-th score that the task has met before goes at once. Scores are then summed in one order
    for every pair, so equal vectors have equal scores. With ``probed``, vectors have a cell, and queries (by place in
    ``asked``) meet the cells that it lists for them only."""
    spark = vectors.sparkSession
    matrix = np.array([r["query"] for r in asked], np.float64).reshape(len(asked), -1)
    held = spark.sparkContext.broadcast((pa.array([r["query_id"] for r in asked], to_arrow_type(kind)), matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix))))
    schema = StructType([StructField("query_id", kind), *[vectors.schema[c] for c in ("chunk_id", "doc_id")], StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, lengths = held.value
        floor = np.full(len(queries), -np.inf)
        everyone = np.arange(len(queries))

        def found(part: pa.RecordBatch, own_queries: np.ndarray) -> pa.RecordBatch:
            v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(v) != part.num_rows * queries.shape[1]:
                raise ValueError("vectors and queries differ in length")
            v = v.reshape(part.num_rows, -1)
            own = np.sqrt(np.einsum("ij,ij->i", v, v))
            near = (v @ queries[own_queries].T) / (own[:, None] * lengths[own_queries][None, :])
            if len(near) >= k:
                floor[own_queries] = np.maximum(floor[own_queries], np.partition(near, len(near) - k, axis=0)[len(near) - k])
            at, q = np.nonzero(near >= floor[own_queries] - 1e-9)  # the product's own order of sums may differ a little
            q = own_queries[q]
            score = np.einsum("ij,ij->i", v[at], queries[q]) / (own[at] * lengths[q])
            columns = [ids.take(pa.array(q)), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(score)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "chunk_id", "doc_id", "score"])

        step = max(1, PAIRS_AT_ONCE // len(queries))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                if probed is None:
                    yield found(part, everyone)
                    continue
                cell = part.column(3).to_numpy()
                for c in np.unique(cell).tolist():
                    if c in probed:
                        yield found(part.take(pa.array(np.flatnonzero(cell == c))), np.array(probed[c]))

    more = [] if probed is None else ["cell"]
    return vectors.where(usable("vector")).select("chunk_id", "doc_id", "vector", *more).mapInArrow(work, schema)


def one_each(queries: DataFrame) -> DataFrame:
    """(query_id, query): one vector that has a direction for every query; of several under one id the smallest counts."""
    return queries.where(usable("query")).groupBy("query_id").agg(F.min("query").alias("query"))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): the k chunks of largest cosine for (query_id, query), ties to the smaller
    chunk_id. Vectors and queries without a direction (null, with null or non-finite components, zero) take no part; of several queries under one id the smallest counts. Up to BROADCAST_ROWS
    queries are scored block by block of the vectors; more are dealt to blocks by an equi-join."""
    if not 1 <= k <= 1000:
        raise ValueError("k must be between 1 and 1000")
    queries = one_each(queries)
    asked = queries.limit(BROADCAST_ROWS + 1).collect()  # a stated set; its size is checked
    if 0 < len(asked) <= BROADCAST_ROWS:
        scored = scored_blocks(asked, vectors, queries.schema["query_id"].dataType, k)
        return best(scored, "query_id", k, F.desc("score"), F.asc("chunk_id"))
    vectors = vectors.where(usable("vector"))
    unit = queries.select("query_id", "query", norm(F.col("query")).alias("q_norm"))
    score = dot(F.col("query"), F.col("vector")) / (F.col("q_norm") * F.col("v_norm"))
    scored = pairs(unit, vectors.withColumn("v_norm", norm(F.col("vector")))).select("query_id", "chunk_id", "doc_id", score.alias("score"))
    return best(scored, "query_id", k, F.desc("score"), F.asc("chunk_id"))


def fit_centroids(vectors: DataFrame, count: int | None = None, seed: int = 1) -> DataFrame:
    """(cell, centroid) by KMeans on normalised vectors; count: a cell for about 32 vectors, 128 cells at most. The fit
    reads at most about FIT_ROWS vectors; those without a direction take no part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(usable("vector"))
    n = rows.count()
    if not n:
        raise ValueError("no vector to fit centroids on")
    if n > FIT_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * FIT_ROWS / n))
    points = rows.select(array_to_vector(unit(F.col("vector"))).alias("features"))
    model = KMeans(k=count or max(2, min(128, n // 32)), seed=seed, maxIter=25, distanceMeasure="cosine").fit(points)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def probes_for(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, least: float = 0.95) -> int:
    """The smallest number of probed cells that finds the share ``least`` of the exact top-k of these queries."""
    exact = dense_topk(queries, index.select("chunk_id", "doc_id", "vector"), k)
    near = F.sort_array(F.transform("all", lambda c: F.struct((-cosine(F.col("query"), c["centroid"])).alias("far"), c["cell"].alias("cell"))))
    held = centroids.agg(F.collect_list(F.struct("cell", "centroid")).alias("all"))
    ranked = queries.join(F.broadcast(held)).select("query_id", F.posexplode(near).alias("place", "c")).select("query_id", "place", F.col("c.cell").alias("cell"))
    found = exact.join(index.select("chunk_id", "cell"), "chunk_id").join(ranked, ["query_id", "cell"]).groupBy("place").count()
    hits = {r["place"]: r["count"] for r in found.collect()}
    got = 0
    for place in sorted(hits):
        got += hits[place]
        if got >= least * sum(hits.values()):
            return place + 1
    raise ValueError("no query to choose the probes by")


def cells(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every vector that has a direction, with the cell of its nearest centroid (cell, centroid), the smaller of two equally
    near. The number of centroids is checked; a batch of vectors meets all of them by one matrix product."""
    held = sorted(centroids.select("cell", "centroid").limit(BROADCAST_ROWS + 1).collect(), key=lambda r: r.cell)
    if not 0 < len(held) <= BROADCAST_ROWS:
        raise ValueError("no centroids, or too many to broadcast")
    numbers, matrix = np.array([r.cell for r in held], np.int32), np.array([r.centroid for r in held], np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    place = vectors.columns.index("vector")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(place).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(v) != batch.num_rows * matrix.shape[1]:
                raise ValueError("vectors and centroids differ in length")
            near = (v.reshape(batch.num_rows, -1) @ matrix.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers[near])], [*batch.schema.names, "cell"])

    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType())])
    return vectors.where(usable("vector")).mapInArrow(work, schema)


def probe(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """Top-k within each query's ``probes`` nearest cells, exact inside them."""
    ranked = F.slice(F.sort_array(F.transform("all", lambda c: F.struct((-cosine(F.col("query"), c["centroid"])).alias("far"), c["cell"].alias("cell")))), 1, probes)
    held = centroids.agg(F.collect_list(F.struct("cell", "centroid")).alias("all"))
    asked = queries.where(usable("query")).join(F.broadcast(held)).select("query_id", "query", F.explode(ranked).alias("c")).select("query_id", "query", F.col("c.cell").alias("cell"))
    scored = index.join(asked, "cell").select("query_id", "chunk_id", "doc_id", cosine(F.col("query"), F.col("vector")).alias("score"))
    return best(scored, "query_id", k, F.desc("score"), F.asc("chunk_id"))


#: How chunk scores become a document's. max has a floor of 0.
STRATEGIES = {
    "max": lambda s: F.greatest(F.max(s), F.lit(0.0)),
    "mean": lambda s: F.avg(s),
    "combsum": lambda s: F.sum(s),
}


def to_documents(chunks: DataFrame, strategy: str = "max", k: int = 20) -> DataFrame:
    """(query_id, doc_id, score, rank) of ranked chunks; ties go to the document seen first."""
    scored = chunks.groupBy("query_id", "doc_id").agg(STRATEGIES[strategy](F.col("score")).alias("score"), F.min("rank").alias("first"))
    return best(scored, "query_id", k, F.desc("score"), F.asc("first"), F.asc("doc_id")).drop("first")


def fuse_graph(dense: DataFrame, graph: DataFrame, weight: float = 0.3) -> DataFrame:
    """(1 - weight) * min-max of the dense score + weight * graph score over the union of both. Documents that only the
    graph has count 0 on the dense side; equal dense scores all count 0."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = dense.select("query_id", "doc_id", ((F.col("score") - low) / F.when(high > low, high - low).otherwise(1.0)).alias("dense"))
    both = scaled.join(graph.select("query_id", "doc_id", "graph"), ["query_id", "doc_id"], "full_outer")
    d, g = F.coalesce("dense", F.lit(0.0)), F.coalesce("graph", F.lit(0.0))
    return both.select("query_id", "doc_id", d.alias("dense_norm"), g.alias("graph_score"), ((1 - weight) * d + weight * g).alias("score"), F.col("dense").isNotNull().alias("is_seed"))


def dense_only(dense: DataFrame) -> DataFrame:
    """Without a graph: score / max, 0 where the maximum is not positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return dense.select("query_id", "doc_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias("score"), F.lit(0.0).alias("graph_score"))


def reciprocal_ranks(*runs: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over runs of (query_id, doc_id, rank)."""
    rows = runs[0].select("query_id", "doc_id", "rank")
    for run in runs[1:]:
        rows = rows.unionByName(run.select("query_id", "doc_id", "rank"))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))


def boosted(score: Column, pagerank: Column, alpha: float = 0.8) -> Column:
    return alpha * score + (1 - alpha) * pagerank


def level_boost(score: Column, level: Column, most: int = 5, beta: float = 0.1) -> Column:
    return score * (1 + beta * level / most)


def words(docs: DataFrame, stop: list[str] | None = None, endings: list[str] | None = None, least: int = 3) -> DataFrame:
    """(doc_id, term), a row an occurrence: words of letters in Turkish lower case, without stop words; of ``endings`` the
    longest that a word has goes, as long as ``least`` letters stay. Null texts have no words."""
    word = F.explode(F.regexp_extract_all(turkish_lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0)))
    rows = docs.select("doc_id", word.alias("term"))
    if stop:
        rows = rows.where(~F.col("term").isin(stop))
    if endings:
        longest_first = "|".join(sorted(map(re.escape, endings), key=lambda e: (-len(e), e)))
        rows = rows.withColumn("term", F.regexp_replace("term", rf"(?<=\p{{L}}{{{least}}})(?:{longest_first})$", ""))
    return rows


def stems_of(rows: DataFrame, known: Iterable[str] = turkish.KNOWN) -> DataFrame:
    """(word, term): the Turkish stem (``known`` ones first) of every different word of (term). A word is stemmed once,
    however many documents have it, and the different words, few bytes but much work, are dealt to all cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    different = rows.select(F.col("term").alias("word")).distinct().repartition(4 * cores, "word")
    return saved(different.select("word", turkish.stem(F.col("word"), known).alias("term")), "stems")


def terms(docs: DataFrame, stop: list[str] | None = None, endings: list[str] | None = None, least: int = 3, *, stems: bool = False, known: Iterable[str] = turkish.KNOWN) -> DataFrame:
    """(doc_id, term, tf) of ``words``. stems: terms are Turkish stems (``known`` ones first)."""
    rows = words(docs, stop, endings, least)
    counted = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    if not stems:
        return counted
    return counted.withColumnRenamed("term", "word").join(stems_of(rows, known), "word").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def bm25(query_terms: DataFrame, postings: DataFrame, k1: float = 1.2, b: float = 0.75, *, stems: DataFrame | None = None) -> DataFrame:
    """BM25 of (query_id, term) over (doc_id, term, tf); rows of one document and term are summed, so words as they stand will
    do. With ``stems`` (word, term), postings are of words and queries of their stems. One pass keeps of every document the
    queried terms and one row for all others, which count for its length only; lengths and frequencies are sums over what is
    kept. Up to BROADCAST_ROWS words of queried terms are broadcast."""
    queried = query_terms.select("term").distinct()
    queried = queried.select(F.col("term").alias("word"), "term") if stems is None else stems.join(queried, "term", "left_semi").select("word", "term")
    wanted = saved(queried, "queried")
    near = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    rows = postings.select("doc_id", F.col("term").alias("word"), "tf").join(near, "word", "left")
    kept = saved(rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf")), "postings")
    lengths = kept.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    held = kept.where("term IS NOT NULL")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    rows = query_terms.join(held, "term").join(df, "term").join(lengths, "doc_id").join(F.broadcast(whole))
    return rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
