"""Keyed tables without a table format: upserts, duplicates, resume, reload, run logs, graph merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dokuma.operators.graph import saved


def newest(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the last by ``order``, and among equals the last by all columns that can be ordered."""
    rest = [F.col(c).desc_nulls_last() for c, t in rows.dtypes if c not in keys and "map<" not in t]
    if not order and not rest:
        return rows.dropDuplicates(keys)
    last = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(o) if isinstance(o, str) else o.desc_nulls_last() for o in order], *rest)
    return rows.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, only: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows of old and new by key, new ones winning; with ``only``, just these columns of an existing row change. Of new
    rows with one key the last by ``order`` counts, or where that lacks or is equal, by all columns."""
    order_by = [order] if order else []
    if only is None:
        rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        return newest(rows, keys, "__new", *order_by).drop("__new")
    new = newest(new, keys, *order_by)
    fresh = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in only], F.lit(True).alias("__hit"))
    changed = old.join(fresh, keys, "left").select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in only else F.col(c) for c in old.columns])
    return changed.unionByName(new.join(old, keys, "left_anti"))


def placed(rows: DataFrame, *order: str, place: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the order of all of them: ranges are sorted where they are and begin behind the
    ranges before, of which one count each comes to the driver. Rows that are equal in ``order`` stand in any order."""
    spark = rows.sparkSession
    dealt = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "placed")
    part, begin, before = F.shiftright("__row", 33), 0, []
    for p, n in dealt.groupBy(part.alias("p")).count().orderBy("p").collect():
        before.append((p, begin))
        begin += n
    starts = F.broadcast(spark.createDataFrame(before, "__part long, __before long"))  # one row a partition
    here = F.col("__row") - F.shiftleft("__part", 33)
    return dealt.withColumn("__part", part).join(starts, "__part").withColumn(place, here + F.col("__before") + 1).drop("__row", "__part", "__before")


def divert_duplicates(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(first of each key by ``order``, the others with exclude_reason naming the first)."""
    w = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("__r", F.row_number().over(w)).withColumn("__first", F.first(order).over(w))
    others = marked.where("__r > 1").select(order, F.concat(F.lit("duplicate: same legal identity as "), "__first").alias("exclude_reason"))
    return marked.where("__r = 1").drop("__r", "__first"), others


def remaining(wanted: DataFrame, done: DataFrame, key: str, *, force: bool = False, limit: int | None = None) -> DataFrame:
    """What a resumed run still has to do: with ``force`` everything; at most the first ``limit`` keys of it."""
    left = wanted if force else wanted.join(done.select(key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def with_status(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    there = present.select(key).distinct().withColumn("__there", F.lit(True))
    return wanted.join(there, key, "left").select(*wanted.columns, F.when(F.col("__there"), "skipped").otherwise("wanted").alias("status"))


def index_plan(chunks: int, vectors: int) -> str:
    """What an embedding run does: nothing, start again, or go on."""
    return "done" if chunks == vectors else "recreate" if vectors > chunks else "resume"


def append_run(log: DataFrame, run: DataFrame) -> DataFrame:
    """The log with a run; a run id that is there already is an error."""
    if log.join(run.select("run_id"), "run_id", "left_semi").limit(1).count():
        raise ValueError("run_id exists")
    return log.unionByName(run)


def merge_nodes(rows: DataFrame, key: str, order: Column, keep: str = "last") -> DataFrame:
    """One node a key: the properties of its last row (SET) or first (ON CREATE SET)."""
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(key).agg(*[pick(c, order).alias(c) for c in rows.columns if c != key])


def merge_edges(rows: DataFrame, order: Column) -> DataFrame:
    """One edge (src, dst, type); the last properties win."""
    return rows.groupBy("src", "dst", "type").agg(*[F.max_by(c, order).alias(c) for c in rows.columns if c not in ("src", "dst", "type")])


def manifest_rows(rows: DataFrame, keep: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns contain one of the given words each, in lower case: any within a list, all across columns."""
    for column, words in keep.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower(column).contains(w.lower())
        rows = rows.where(hit)
    return rows


def remapped(array: str, mapping: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Arrays of ids with known ids replaced, order kept."""
    flat = rows.select(key, F.posexplode(array).alias("__i", "__old"))
    new = flat.join(mapping.select(F.col("old").alias("__old"), F.col("new").alias("__n")), "__old", "left")
    back = new.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", F.coalesce("__n", "__old").alias("v")))).alias("__a"))
    return rows.join(back, key, "left").withColumn(array, F.coalesce(F.col("__a.v"), array)).drop("__a")
