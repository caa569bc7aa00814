"""Turns of conversations: what both conversation operators share.

A turn stands for its role and text (null: empty) and is known by a SHA-256 of each, so that sorts and joins over many
turns carry no texts. Turns of one conversation are ordered by turn number, null first, then by role and by the hash of the
text; repeated rows stay, one behind the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed(rows: DataFrame, *, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, digest); null roles and texts count as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(ident).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), whole.alias("text"), digest(whole).alias("digest"))


def numbered(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv, turn, role, digest, ...) with pos long, from 1 in each conversation.

    Rows are sorted by ranges of (conv, turn, role, digest), so one conversation with very many turns lies in many
    partitions. A row's place is its place in the partition's run plus the lengths of the conversation's runs in earlier
    partitions; of those there is one row a conversation and partition.
    """
    order = ("conv", "turn", "role", "digest")
    rows = written(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("part", F.shiftright("row", 33))
    runs = rows.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part")
    runs = runs.select(F.col("conv").alias("c"), F.col("part").alias("p"), (F.sum("n").over(earlier) - F.col("n") + 1 - F.col("first")).alias("shift"))
    found = rows.join(runs, rows["conv"].eqNullSafe(runs["c"]) & (rows["part"] == runs["p"]))
    return found.withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "c", "p", "shift")
