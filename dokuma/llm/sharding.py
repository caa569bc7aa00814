"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters whole records by a seeded hash into buckets that fit a task's memory; pass 2 runs a Fisher-Yates
shuffle inside every bucket and writes it to the shared folder. The written buckets, one after the other, are a random
order of all rows; contiguous stretches of it become the shards, whose row counts are at most one apart.

Rows are scattered by a hash of their content and their place in the input, so repeated rows, one hot source or null
ids spread evenly. A null text counts as empty. An empty table gives an empty result. Input columns may bear any name:
records travel inside one struct and come back as the column ``record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, written

BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 12
BROADCAST_BUCKETS = 1_000_000


def bucket_count(docs: DataFrame, *, text: str = "text", bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS) -> int:
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 64), F.lit(0))).first()[0]
    return max(least_buckets, -(-total // bucket_bytes))


def external_shuffle(docs: DataFrame, *, text: str = "text", seed: int = 20_24, bucket_bytes: int = BUCKET_BYTES, least_buckets: int = LEAST_BUCKETS, buckets: int | None = None) -> DataFrame:
    """All rows in a seeded random order: (bucket int, pos long from 0 in the bucket, record struct)."""
    buckets = buckets or bucket_count(docs, text=text, bucket_bytes=bucket_bytes, least_buckets=least_buckets)
    place = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), F.xxhash64(F.lit(seed), text_bytes(text), F.monotonically_increasing_id()).alias("h"), F.monotonically_increasing_id().alias("i"))
    dealt = place.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
    by_hash = lambda x, y: F.when(x.h < y.h, -1).when(x.h > y.h, 1).when(x.i < y.i, -1).when(x.i > y.i, 1).otherwise(0)
    # The order in which a shuffle delivers rows varies; sorting by hash first makes the shuffled order repeatable.
    whole = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "i", "record")), by_hash).alias("rows"))
    mixed = whole.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row"))
    return written(mixed.select("bucket", F.col("pos").cast("long").alias("pos"), F.col("row.record").alias("record")), "buckets")


def shard(docs: DataFrame, *, shards: int = 16, **options) -> DataFrame:
    """Law ``rows``: (shard int, slot long, bucket int, record struct); slots are gapless from 0 in every shard.

    The only global step is a running sum over one row per bucket (memory-sized), so it stays small: 100 TB in buckets
    of 16 MB are about six million numbers.
    """
    from pyspark.sql import Window

    buckets = options.pop("buckets", None) or bucket_count(docs, **{k: v for k, v in options.items() if k != "seed"})
    mixed = external_shuffle(docs, buckets=buckets, **options)

    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n"))
    ordered = Window.orderBy("bucket")
    starts = counts.select("bucket", (F.sum("n").over(ordered) - F.col("n")).alias("before"), F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    # One row of 24 bytes a bucket: broadcast up to a million buckets, so that the records are not shuffled again.
    rows = mixed.join(F.broadcast(starts) if buckets <= BROADCAST_BUCKETS else starts, "bucket").withColumn("at", F.col("before") + F.col("pos"))
    rows = rows.withColumn("shard", F.expr(f"at * {shards} div total"))
    return rows.select(F.col("shard").cast("int").alias("shard"), (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"), "bucket", "record")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = shard(docs, shards=16)
    body = F.coalesce(F.col("record.text"), F.lit("")).cast("binary")
    return rows.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
