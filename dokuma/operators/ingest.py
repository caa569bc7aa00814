"""Loading decisions: document rows, logs, batches, vector tables, write-back, look-ups and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dokuma.functions.courts import court_level, law_branch

#: A source's court -> the court's name.
COURTS = {
    "yargitay": "Yargıtay", "danistay": "Danıştay", "aym": "AYM", "anayasa_mahkemesi": "AYM", "bam": "BAM", "bim": "BİM", "ticaret": "İlk Derece", "is": "İlk Derece", "idare": "İlk Derece", "sayistay": "Sayıştay",
    "uyusmazlik": "Uyuşmazlık", "tuketici": "İlk Derece", "icra_hukuk": "İlk Derece", "icra_ceza": "İlk Derece", "aihm": "AİHM", "fikri_sinai_hukuk": "İlk Derece", "fikri_sinai_ceza": "İlk Derece",
    "asliye_ceza": "İlk Derece", "agir_ceza": "İlk Derece",
}
NO_TARGET = {"target_doc_id": "", "chamber": "", "confidence": 0.0, "snippet": ""}


def document_rows(metadata: DataFrame) -> DataFrame:
    """Documents of (filename, document_id, court, court_name, case_no, decision_no, decision_date, keywords). Nulls become
    empty; a court without a name of its own keeps its lower-case value; without a court there is no branch and level 0;
    without an id the file's stem is one."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in COURTS.items() for x in pair])
    rows = metadata.select(
        F.coalesce(F.nullif(F.col("document_id").cast("string"), F.lit("")), F.regexp_replace(F.regexp_extract("filename", "[^/]*$", 0), r"(?<=.)\.[^.]+$", "")).alias("doc_id"), "filename",
        F.lower(empty("court")).alias("raw"), empty("court_name").alias("chamber"), empty("case_no").alias("case_no"), empty("decision_no").alias("decision_no"), empty("decision_date").alias("decision_date"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("topic_keywords"),
    ).withColumn("court", F.coalesce(names[F.col("raw")], "raw"))
    known = F.col("court") != ""
    return rows.select(
        "doc_id", "filename", "court", "chamber", "case_no", "decision_no", "decision_date", "topic_keywords",
        F.when(known, law_branch(F.col("court"), F.col("chamber"))).otherwise("").alias("law_branch"), F.when(known, court_level(F.col("court"))).otherwise(0).alias("court_level"),
    )


def distinct_names(documents: DataFrame, column: str) -> DataFrame:
    return documents.select(column).where(F.col(column) != "").distinct()


def log_entry(outcomes: DataFrame, folder: str) -> DataFrame:
    """One row for the log of loads: (timestamp, total_files, ingested, skipped, errors, corpus_dir) of outcomes (status)."""
    of = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(F.current_timestamp().alias("timestamp"), F.count("*").alias("total_files"), of("ingested").alias("ingested"), of("skipped").alias("skipped"), of("error").alias("errors"), F.lit(folder).alias("corpus_dir"))


def in_batches(rows: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Rows in order, with the batch (part, number) of at most ``size`` rows that each falls into: ranges of the order are
    dealt to tasks and numbered there, so no task sees them all."""
    at = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", at)
    return ordered.select(*rows.columns, F.struct(F.shiftright("__at", 33).cast("int").alias("part"), F.floor((F.col("__at").bitwiseAND((1 << 33) - 1)) / size).alias("number")).alias("batch"))


def vector_ids(vectors: DataFrame) -> DataFrame:
    return vectors.select("chunk_id")


def write_vectors(rows: DataFrame, path: str, per_file: int = 2000) -> None:
    """Add vectors to a table, in files of at most so many rows."""
    rows.write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def write_back(table: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The table with the columns of ``values`` (key, ...) put in; rows without new values keep theirs, or get nulls."""
    fresh = [c for c in values.columns if c != key]
    held = values.select(key, F.struct(*fresh).alias("__new"))
    old = lambda c: F.col(c) if c in table.columns else F.lit(None)
    joined = table.join(held, key, "left")
    put = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(old(c)).alias(c)
    return joined.select(*[put(c) if c in fresh else F.col(c) for c in table.columns], *[put(c) for c in fresh if c not in table.columns])


def resolved_edges(citations: DataFrame) -> DataFrame:
    """Stored citations that have a target, nulls filled, as the graph build takes them."""
    return citations.where("target_doc_id IS NOT NULL").fillna({c: v for c, v in NO_TARGET.items() if c in citations.columns})


def files_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, filename, error) of asked ids; the error says which are not there."""
    found = ids.select("doc_id").distinct().join(documents.select("doc_id", "filename"), "doc_id", "left")
    return found.select("doc_id", "filename", F.when(F.col("filename").isNull(), F.concat(F.lit("not found: "), F.col("doc_id").cast("string"))).alias("error"))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_stats(wanted: DataFrame, done: DataFrame, stages: list[str]) -> DataFrame:
    """(merged, skipped, complete, partial) of wanted (stem) and finished stages (stem, stage)."""
    have = done.where(F.col("stage").isin(stages)).groupBy("stem").agg(F.count_distinct("stage").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = wanted.select("stem").distinct().join(have, "stem", "left")
    return rows.agg(F.count_if(n > 0).alias("merged"), F.count_if(n == 0).alias("skipped"), F.count_if(n == len(stages)).alias("complete"), F.count_if((n > 0) & (n < len(stages))).alias("partial"))


def runs_with_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    return runs.where(F.col("run_id").startswith(prefix))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A gold standard, run, manifest or settings file; a file that is no such JSON is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_report(scores: DataFrame, path: str, most: int = 200) -> str:
    """Write (field, score) rows as JSON and return them as text lines, lowest first; at most ``most`` fields are shown."""
    scores.write.mode("overwrite").json(path)
    rows = scores.orderBy("score", "field").limit(most).collect()
    width = max((len(r["field"]) for r in rows), default=0)
    return "\n".join(f"{r['field']:<{width}}  {100 * r['score']:6.2f} %" for r in rows)


class Progress:
    """Which steps of a load are done, for one that goes on after a stop: a small table in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """The last value noted of each step."""
        if not self.fs.exists(self.folder):
            return {}
        rows = self.spark.read.schema("step string, value string, seq long").parquet(self.path)
        return {r["step"]: json.loads(r["value"]) for r in rows.groupBy("step").agg(F.max_by("value", "seq").alias("value")).collect()}

    def note(self, step: str, value=True) -> None:
        seq = 1 + sum(1 for _ in self.fs.listStatus(self.folder)) if self.fs.exists(self.folder) else 0
        self.spark.createDataFrame([(step, json.dumps(value), seq)], "step string, value string, seq long").coalesce(1).write.mode("append").parquet(self.path)

    def finish(self) -> None:
        """Everything is done: nothing is left to go on from."""
        self.fs.delete(self.folder, True)
