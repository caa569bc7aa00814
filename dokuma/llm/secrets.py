"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Base kinds are found in every whole text: ``assign`` (a keyword, = or : and a value of 6+ characters), ``access`` (AKIA
and 20+ characters in all) and ``hex`` (24+ digits). A further kind, ``owned``, comes from the method: every long token
(16+ characters with a letter and a digit) outside the base spans is a candidate; candidates and base values are hashed
and counted over the corpus by distinct repositories and owners. A candidate becomes a span when its value is assigned
to a keyword anywhere in the corpus (a bare copy of a secret), or when it looks like a live credential (20+ characters
of both cases and digits) and only one owner has it. Every span gets a class: ``example`` when at least ``WIDE`` owners
have its value, else ``live``.

Positions are code points, end exclusive. Java finds the same matches for split and for extraction, so the lengths of
the pieces between matches and of the matches give every position without a user function.

A null text counts as empty; a null repository is one repository of its own; repeated rows are scanned each; empty
tables give empty results; input columns travel in a struct, so any names may occur. Counts by value are aggregated
before the shuffle, and the join back to a value that a third of all rows hold is a plain equi-join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed patterns. Keywords match in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_.=-]{16,}"
KINDS = ("assign", "access", "hex", "owned")
WIDE = 3
GROUP = 128


def find(text: Column, pattern: str, group: int, kind: int, keep) -> Column:
    """Spans (kind, start, end, value) of a pattern's leftmost non-overlapping matches whose value passes keep. Matches are
    handled in groups of ``GROUP``: a list that grows by appending is copied at every step, so none grows with the text."""
    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("whole"), values.alias("value"))
    rows = F.transform(zipped, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["whole"]), F.lit(0)).alias("size"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + x["size"]
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.when(x["value"].isNotNull() & keep(x["value"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def begin(acc: Column, g: Column) -> Column:
        size = F.aggregate(g, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        return F.struct((acc["at"] + size).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))

    def placed(groups: Column) -> Column:
        begins = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), begin)["all"]
        own = lambda x: F.aggregate(x["g"], F.struct(x["at"].alias("at"), none.alias("spans")), step)["spans"]
        return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), begins.alias("at")), own))

    cut = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / GROUP).cast("int")), lambda g: F.slice(r, g * GROUP + 1, GROUP))
    once = lambda x, use: F.get(F.transform(F.array(x), use), F.lit(0))  # noqa: E731  evaluates x a single time
    return F.when(text.rlike(pattern), once(rows, lambda r: once(cut(r), placed))).otherwise(none)


def scan(docs: DataFrame, *, text: str = "text", repo: str = "source", wide: int = WIDE, keep_text: bool = False) -> DataFrame:
    """(record struct of the input without the text unless keep_text, base, spans): arrays of (start, kind, end, class),
    ordered by start and kind. The owner of a repository is what precedes its first slash."""
    body = F.coalesce(F.col(text), F.lit(""))
    always = lambda v: F.lit(True)
    kept = [c for c in docs.columns if keep_text or c != text]
    base = F.concat(find(body, ASSIGN, 2, 0, lambda v: F.length(v) >= 6), find(body, ACCESS, 0, 1, always), find(body, HEX, 0, 2, always))
    token = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    more = F.when(body.rlike("[0-9]"), find(body, TOKEN, 0, 3, token))
    home = F.coalesce(F.col(repo).cast("string"), F.lit(""))
    first = docs.select(F.struct(*[docs[c] for c in kept]).alias("record"), home.alias("repo"), base.alias("base"), more.alias("more"))
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"].cast("binary"), 256).alias("hash"), ((F.length(x["value"]) >= 20) & x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")).alias("looks")))
    spans = F.concat(hashed(F.col("base")), hashed(F.filter(F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")), clear)))
    rows = written(first.select(F.monotonically_increasing_id().alias("row"), "record", "repo", spans.alias("all")), "secrets")

    each = rows.where(F.size("all") > 0).select("row", "repo", F.explode("all").alias("x")).select("row", "repo", "x.*")
    counts = each.groupBy("hash", "repo").agg(F.max((F.col("kind") == 0).cast("int")).alias("assigned"))
    counts = counts.groupBy("hash").agg(F.countDistinct(F.substring_index("repo", "/", 1)).alias("owners"), F.max("assigned").alias("assigned"))
    judged = each.join(counts, "hash")
    judged = judged.where((F.col("kind") < 3) | (F.col("assigned") == 1) | (F.col("looks") & (F.col("owners") == 1)))
    judged = judged.select("row", F.struct("start", "kind", "end", F.when(F.col("owners") >= wide, "example").otherwise("live").alias("class")).alias("span"))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,class:string>>")
    out = rows.select("row", "record").join(by_row, "row", "left").select("record", F.coalesce("spans", none).alias("spans"))
    return out.select("record", F.filter("spans", lambda s: s["kind"] < 3).alias("base"), "spans")


def listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The input with every span replaced by <SECRET>, or <EXAMPLE> for values of the class ``example``; overlapping
    spans become one. Texts without spans stay as they are, null ones too."""
    found = scan(docs, text=text, keep_text=True, **options)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.col(f"record.{text}")

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["class"] == "example", "<EXAMPLE>").otherwise("<SECRET>")
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], body.substr(acc["at"] + 1, s["start"] - acc["at"]), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.size("spans") == 0, body).otherwise(F.concat(done["out"], body.substr(done["at"] + 1, F.length(body))))
    return found.select(*[clean.alias(c) if c == text else F.col("record")[c].alias(c) for c in docs.columns])


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        F.col("record.doc_id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


OP5_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repo FROM documents),
found AS (
  SELECT row, repo, 0 AS kind, string_split_regex(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals FROM docs
  UNION ALL SELECT row, repo, 1, string_split_regex(text, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}', 0) FROM docs
  UNION ALL SELECT row, repo, 2, string_split_regex(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}', 0), regexp_extract_all(text, '[0-9a-f]{24,}', 0) FROM docs
  UNION ALL SELECT row, repo, 3, string_split_regex(text, '[A-Za-z0-9+/_.=-]{16,}'), regexp_extract_all(text, '[A-Za-z0-9+/_.=-]{16,}', 0), regexp_extract_all(text, '[A-Za-z0-9+/_.=-]{16,}', 0) FROM docs),
each AS (SELECT row, repo, kind, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, vals FROM found WHERE len(whole) > 0),
placed AS (
  SELECT row, repo, kind, whole[i] AS w, vals[i] AS value,
    CAST(sum(length(gaps[i])) OVER (PARTITION BY row, kind ORDER BY i) + coalesce(sum(length(whole[i])) OVER (PARTITION BY row, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM each),
cand AS (SELECT row, repo, kind, s, s + length(w) AS e, value FROM placed
  WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= 6 OR kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
free AS (SELECT * FROM cand c WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM cand b WHERE b.row = c.row AND b.kind < 3 AND b.s < c.e AND b.e > c.s)),
counts AS (SELECT value, count(DISTINCT string_split(repo, '/')[1]) AS owners, max((kind = 0)::INT) AS assigned FROM free GROUP BY value),
spans AS (
  SELECT row, kind, s, e, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || s || ':' || e AS word
  FROM free JOIN counts USING (value)
  WHERE kind < 3 OR assigned = 1 OR owners = 1 AND length(value) >= 20 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')),
by_row AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(word, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(word, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_row USING (row)
"""
