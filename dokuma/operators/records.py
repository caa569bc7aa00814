"""Machine-extracted records: stages, merging, checking against the source, outcome counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dokuma.functions.pieces import pieces
from dokuma.functions.text import compact_id, has_number, has_word, strip_fence
from dokuma.operators.stored import StoredTable

#: Stage -> keys it may give.
STAGES = {
    "metadata": (
        "court_type", "court", "case_number", "decision_number", "decision_date", "decision_type", "is_final", "finality_basis", "decision_outcome",
        "decision_outcome_raw", "vote_unanimity", "has_dissent", "dissent_summary", "appellants", "appeal_outcomes_by_role", "subject", "keywords",
        "legal_issues", "legal_concepts", "dispositive_reasoning", "fact_pattern",
    ),
    "summary": ("summary",),
    "citations_decisions": ("cited_court_decisions",),
    "citations_laws": ("cited_law_articles",),
}
#: Keys of a merged record in order.
ORDER = (
    "file", "court_type", "court", "case_number", "decision_number", "decision_date", "decision_type", "is_final", "finality_basis", "decision_outcome",
    "decision_outcome_raw", "vote_unanimity", "has_dissent", "dissent_summary", "appellants", "appeal_outcomes_by_role", "subject", "summary",
    "keywords", "legal_issues", "legal_concepts", "dispositive_reasoning", "fact_pattern", "cited_court_decisions", "cited_law_articles",
)


def resolved_setting(*layers: str) -> Column:
    """The first layer that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in layers])


def run_stage(sources: DataFrame, stage: str, extract: Callable[[str], tuple[str, bool]], *, objects: bool = True) -> DataFrame:
    """(stem, stage, status, payload, raw) of (stem, text); extract gives (answer, cut off). Invalid answers, of which with
    ``objects`` whatever is no JSON object is one, stay in raw."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(frames, "text"):
            rows = []
            for r in pdf.itertuples():
                try:
                    answer, cut = extract(r.text)
                    rows.append((r.stem, "truncated" if cut else "answer", answer))
                except Exception as error:  # noqa: BLE001  the extractor is the caller's; its failure is an outcome
                    rows.append((r.stem, "error", str(error)))
            yield pd.DataFrame(rows, columns=["stem", "status", "raw"])

    got = sources.select("stem", "text").mapInPandas(work, "stem string, status string, raw string")
    body = strip_fence(F.col("raw"))
    valid = F.try_parse_json(body).isNotNull() & (body.startswith("{") if objects else F.lit(True))
    status = F.when(F.col("status") != "answer", F.col("status")).when(valid, "ok").otherwise("invalid_json")
    return got.select("stem", F.lit(stage).alias("stage"), status.alias("status"), F.when(status == "ok", body).alias("payload"), F.when(status != "ok", F.col("raw")).alias("raw"))


def single_pass(sources: DataFrame, extract: Callable[[str], tuple[str, bool]]) -> DataFrame:
    """(stem, status, payload, raw): one answer a document, any JSON, neither merged nor cut to a stage's keys."""
    return run_stage(sources, "single", extract, objects=False).drop("stage")


def store_stage(rows: DataFrame, table: StoredTable) -> int:
    """Put a stage's rows into a table of (stem, stage), where the newest answer stands; the table is made at the first call."""
    if table.manifest() is None:
        return table.create(rows, ["stem", "stage"], slice_by=["stem"])
    return table.merge(rows)


def pending(sources: DataFrame, table: StoredTable, stage: str, *, force: bool = False) -> DataFrame:
    """The sources (stem, text) that have no valid answer of the stage yet; with ``force`` all of them."""
    if force or table.manifest() is None:
        return sources
    return sources.join(table.read().where((F.col("stage") == stage) & (F.col("status") == "ok")).select("stem"), "stem", "left_anti")


def outcomes(stage_rows: DataFrame) -> DataFrame:
    return stage_rows.groupBy("stage", "status").agg(F.count("*").alias("n"))


def outcome_table(stage_rows: DataFrame) -> DataFrame:
    """(stage, ok, truncated, invalid_json, errors): counts of the four outcomes, of which every row has one."""
    names = {"ok": "ok", "truncated": "truncated", "invalid_json": "invalid_json", "errors": "error"}
    return stage_rows.groupBy("stage").agg(*[F.count_if(F.col("status") == status).alias(n) for n, status in names.items()])


def merged(stage_rows: DataFrame) -> DataFrame:
    """(stem, record, present, missing): payloads merged in canonical key order; each stage's own keys only; documents
    without any valid stage are left out. Values are kept as JSON text, so nothing is reinterpreted."""
    valid = stage_rows.where(F.col("payload").isNotNull() & F.try_parse_json("payload").isNotNull())
    own = F.lit(None).cast("array<string>")
    for stage, keys in STAGES.items():
        own = F.when(F.col("stage") == stage, F.array(*[F.lit(k) for k in keys])).otherwise(own)
    entries = F.from_json("payload", "map<string,string>")
    pieces = valid.where(own.isNotNull()).select("stem", "stage", F.map_filter(entries, lambda k, v: F.array_contains(own, k)).alias("m"), F.json_object_keys("payload").alias("k"), own.alias("own"))
    per = pieces.groupBy("stem").agg(F.collect_set("stage").alias("stages"), F.map_from_entries(F.flatten(F.collect_list(F.map_entries("m")))).alias("m"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect("k", "own")))).alias("keys"))
    names = F.array(*[F.lit(s) for s in STAGES])
    order = F.array(*[F.lit(k) for k in ORDER])
    held = F.filter(order, lambda k: F.array_contains("keys", k))
    plain = lambda v: F.when(v.isNull(), "null").when(F.try_parse_json(v).isNotNull() & v.rlike(r'^\s*(?:[\[{]|true$|false$|-?[0-9.eE+-]+$)'), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    items = F.transform(held, lambda k: F.concat(F.lit('"'), k, F.lit('":'), plain(F.element_at("m", k))))
    record = F.concat(F.lit('{"file":"'), "stem", F.lit('.md"'), F.when(F.size(items) > 0, F.concat(F.lit(","), F.array_join(items, ","))).otherwise(""), F.lit("}"))
    return per.select("stem", record.alias("record"), F.array_intersect(names, "stages").alias("present"), F.array_except(names, "stages").alias("missing"))


def check_decisions(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(file, index, verified, signals, reason) of cited decisions (file, index, case_number, decision_number): a number
    counts when its digits and slashes occur in the source's."""
    compact = sources.select("file", compact_id(F.col("text")).alias("source"))
    rows = citations.join(compact, "file")
    token = lambda c: F.coalesce(compact_id(F.col(c)), F.lit(""))
    hit = lambda c: F.when((token(c) != "") & F.contains("source", token(c)), F.concat(F.lit(f"{c}:"), c))
    signals = F.array_compact(F.array(hit("case_number"), hit("decision_number")))
    none = (token("case_number") == "") & (token("decision_number") == "")
    reason = F.when(F.size(signals) == 0, F.when(none, "citation has no case_number or decision_number to check").otherwise("neither case_number nor decision_number found in source"))
    return rows.select("file", "index", (F.size(signals) > 0).alias("verified"), signals.alias("signals"), reason.alias("reason"))


def check_laws(citations: DataFrame, sources: DataFrame, laws: DataFrame) -> DataFrame:
    """The same for laws (file, index, law, law_number), with laws (law, abbreviations, number): the number on its own,
    the first abbreviation found as a word, the law's own number when none is cited, the full name."""
    text = sources.select("file", "text", F.trim(F.regexp_replace(F.lower("text"), "\\s+", " ")).alias("lowered"))
    rows = citations.join(text, "file").join(laws.hint("broadcast") if laws.limit(10_001).count() <= 10_000 else laws, "law", "left")
    number = F.when(has_number(F.col("text"), F.col("law_number")), F.concat(F.lit("law_number:"), "law_number"))
    abbreviation = F.get(F.filter("abbreviations", lambda a: has_word(F.col("text"), a)), F.lit(0))
    blank = F.coalesce(F.col("law_number"), F.lit("")) == ""
    own = F.when(blank & has_number(F.col("text"), F.col("number")), F.concat(F.lit("law_number:"), "number"))
    name = F.trim(F.regexp_replace(F.lower(F.regexp_replace("law", "\\(mülga\\)", "")), "\\s+", " "))
    full = F.when((F.length(name) >= 6) & F.contains("lowered", name), F.lit("full_name"))
    signals = F.array_compact(F.array(number, F.concat(F.lit("abbreviation:"), abbreviation), own, full))
    none = (F.coalesce("law", F.lit("")) == "") & blank
    reason = F.when(F.size(signals) == 0, F.when(none, "citation has no law name or law_number").otherwise("no law_number, abbreviation, or full name found in source"))
    return rows.select("file", "index", (F.size(signals) > 0).alias("verified"), signals.alias("signals"), reason.alias("reason"))


def verification_totals(checks: DataFrame) -> DataFrame:
    per = checks.groupBy("file").agg(F.count_if("verified").alias("v"), F.count_if(~F.col("verified")).alias("h"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("v"), F.lit(0)).alias("verified"), F.coalesce(F.sum("h"), F.lit(0)).alias("hallucinated"), F.count_if(F.col("h") > 0).alias("files_with_hallucinations"))


def cleaned(records: DataFrame, checks: DataFrame, array: str) -> DataFrame:
    """(file, kept, backup): the array without entries that a check rejects; entries keep their order."""
    bad = checks.where(~F.col("verified")).groupBy("file").agg(F.collect_set("index").alias("__bad"))
    rows = records.join(bad, "file", "left")
    keep = F.filter(F.col(array), lambda x, i: ~F.coalesce(F.array_contains("__bad", i), F.lit(False)))
    return rows.select("file", keep.alias("kept"), F.col(array).alias("backup"))


def write_verification(records: DataFrame, checks: DataFrame, array: str, path: str, *, strict: bool = False) -> DataFrame:
    """Write what a verification found below ``path``: report (the checks), and with ``strict`` backup (the records as they were,
    before anything else) and cleaned (without entries that a check rejects). Returns the records that stand."""
    checks.write.mode("overwrite").parquet(f"{path}/report")
    if not strict:
        return records
    records.write.mode("overwrite").parquet(f"{path}/backup")
    spark = records.sparkSession
    kept, found = spark.read.parquet(f"{path}/backup"), spark.read.parquet(f"{path}/report")
    left = cleaned(kept, found, array).select("file", F.col("kept").alias("__kept"))
    kept.join(left, "file").withColumn(array, F.col("__kept")).drop("__kept").write.mode("overwrite").parquet(f"{path}/cleaned")
    return spark.read.parquet(f"{path}/cleaned")
