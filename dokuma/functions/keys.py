"""Deterministic identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 16)


def document_id(court: Column, chamber: Column, case_no: Column, decision_no: Column) -> Column:
    return short_hash(*[F.trim(F.coalesce(c, F.lit(""))) for c in (court, chamber, case_no, decision_no)])


def chunk_id(doc_id: Column, index: Column) -> Column:
    return short_hash(doc_id, index)


def citation_id(source: Column, case_no: Column, decision_no: Column) -> Column:
    """Without the chamber, as the stored keys have it."""
    return short_hash(source, case_no, decision_no)


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, "\\.md$", "")
