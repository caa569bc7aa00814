"""File sources: whole texts, listings, name lists, JSON with corrupt rows set aside; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions.text import nfc
from dokuma.sources import keyed

EMBEDDED = (
    "metadata struct<court:string, daire:string, esas_no:string, karar_no:string, filename:string, court_level:int, law_branch:string, decision_date:string, topic_keywords:array<string>>, "
    "chunks array<struct<chunk_index:int, text:string, token_count:int, embedding:array<float>>>, _corrupt string"
)


def _name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def listing(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """(filename, length) of a folder's files and those of folders in it, contents not read. Each folder is listed by a task."""
    return keyed.read(spark, path, suffix=f".{suffix}", contents="false").select(_name(F.col("key")).alias("filename"), F.col("size").alias("length"))


def texts(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """(filename, text), one row a file, of a folder and the folders in it. Each folder is listed and read by a task, so
    many files are best laid in many folders; a file that cannot be read is an error."""
    rows = keyed.read(spark, path, suffix=f".{suffix}", replace="true")
    return rows.select(_name(F.col("key")).alias("filename"), F.when(F.col("error").isNull(), F.col("body")).otherwise(F.raise_error(F.concat_ws(": ", "key", "error")).cast("string")).alias("text"))


def with_fallback(wanted: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """(filename, text): the near copy, else the far one, else null (a missing file)."""
    far = far.withColumnRenamed("text", "__far")
    return wanted.join(near, "filename", "left").join(far, "filename", "left").select("filename", F.coalesce("text", "__far").alias("text"))


def name_list(spark: SparkSession, path: str, suffix: str = ".md") -> DataFrame:
    """File names of a list: trimmed, without blank lines and comments, the suffix added where it lacks."""
    name = F.trim("value")
    rows = spark.read.text(path).where((name != "") & ~name.startswith("#"))
    return rows.select(F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix))).alias("filename"))


def metadata_lookup(metadata: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """The last row of each wanted file name, needed columns only; batch order is ``seq``. Names are compared, and
    returned, in canonical composition."""
    composed = lambda df: df.withColumn("filename", nfc(F.col("filename")))
    rows = composed(metadata).join(composed(names.select("filename").distinct()).distinct(), "filename", "left_semi")
    return rows.groupBy("filename").agg(*[F.max_by(c, "seq").alias(c) for c in columns])


def embedded_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their chunks, corrupt files' texts) of pre-embedded JSON documents, a file each or as an array, in a
    folder and the folders in it; each folder is listed and read by a task."""
    body = texts(spark, path, "json").where(F.trim("text") != "").select("text")
    each = body.select(F.explode(F.coalesce(F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")), F.array("text"))).alias("text"))
    rows = each.select("text", F.from_json("text", EMBEDDED, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return rows.where(~bad).select("r.*").drop("_corrupt"), rows.where(bad).select(F.col("text").alias("_corrupt"))


def reload(df: DataFrame, path: str) -> bool:
    """Overwrite a table unless the new rows are none, which leave it as it is."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def run_file(ranked: DataFrame) -> DataFrame:
    """(query_id, retrieved_docs in rank order); a query's list is bounded by its top-k."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    return lists.select("query_id", F.col("x.doc_id").alias("retrieved_docs"))
