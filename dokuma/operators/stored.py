"""Keyed tables that are changed in place: merges that rewrite only the slices they touch, snapshots and vacuum.

A table is a folder. Its rows lie in ``slices`` parts by a hash of ``slice_by`` (the key, or a part of it), each a folder of
Parquet files that is never changed. A version is a manifest, a small text that names every slice's folder. A change reads
the slices that its rows fall in, writes them anew under a new name and then puts the next manifest in place by one rename;
so readers see the old version or the new one whole, a change that is killed leaves the old one, and two writers of one
version do not both succeed. ``read`` gives any version that is still there; ``vacuum`` deletes old manifests and every
folder that no manifest names, what killed changes left included.

Of several rows with one key in a change the last by ``order`` counts, or where that is equal or lacks, by all columns.
Null is a key like any other, but for merges with ``only``, which match no null key. A change without rows makes no version.
Columns may bear any name that does not begin with two underscores.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dokuma.operators import tables
from dokuma.operators.graph import _files, discard, saved

SLICES = 64


class VersionTaken(RuntimeError):
    """Another writer has put this version in place first."""


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- manifests

    def versions(self) -> list[int]:
        folder, files = _files(self.spark, f"{self.path}/manifests/*.json")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.globStatus(folder) or [])

    def manifest(self, version: int | None = None) -> dict | None:
        known = self.versions()
        if not known:
            return None
        wanted = known[-1] if version is None else version
        if wanted not in known:
            raise ValueError(f"version {wanted} of {self.path} is not there; there are {known}")
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{wanted}.json", wholetext=True).first()[0])

    def _put(self, manifest: dict) -> int:
        whole, files = _files(self.spark, f"{self.path}/manifests/{manifest['version']}.json")
        part, _ = _files(self.spark, f"{self.path}/writing/{uuid.uuid4().hex}")
        out = files.create(part, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        files.mkdirs(whole.getParent())
        if files.exists(whole) or not files.rename(part, whole):
            raise VersionTaken(f"version {manifest['version']} of {self.path}")
        return manifest["version"]

    # --- reading

    def read(self, version: int | None = None, slices: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one by default), or of some of its slices."""
        m = self.manifest(version)
        if m is None:
            raise ValueError(f"no table at {self.path}")
        schema = StructType.fromJson(m["schema"])
        held = [f"{self.path}/{p}" for s, own in m["slices"].items() if slices is None or int(s) in slices for p in own]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """(version, change, at, slices): the versions still there."""
        rows = [(m["version"], m["change"], m["at"], len(m["slices"])) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version long, change string, at double, slices int")

    # --- changes

    def create(self, rows: DataFrame, keys: list[str], *, slice_by: list[str] | None = None, slices: int = SLICES, spread: int = 1, order: str | None = None) -> int:
        """Version 0 of rows, one a key. A slice is written by up to ``spread`` tasks: more where slices are large."""
        first = {"version": -1, "schema": json.loads(rows.schema.json()), "keys": keys, "slice_by": slice_by or keys, "count": slices, "spread": spread, "slices": {}, "mark": None}
        return self._write(first, tables.newest(rows, keys, *([order] if order else [])), [], "create", None)

    def merge(self, rows: DataFrame, *, only: list[str] | None = None, order: str | None = None, newest: bool = False, mark: str | None = None) -> int:
        """Insert rows and let them replace those of their key, or with ``only`` just these columns of them. newest: the last
        row by ``order`` counts, old or new. mark: a change of this name that is the last one already is not made twice."""
        if newest and not order:
            raise ValueError("newest needs an order")

        def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
            return tables.newest(old.unionByName(new), keys, order) if newest else tables.upsert(old, new, keys, only=only, order=order)

        return self._change(rows, merged, "merge", mark)

    def replace(self, rows: DataFrame, by: list[str]) -> int:
        """Insert rows and delete all others with the same values in ``by``, which must be what the table is sliced by: a
        document's new chunks replace all its old ones."""
        if set(by) != set(self.manifest()["slice_by"]):
            raise ValueError("replace needs the columns that the table is sliced by")
        return self._change(rows, lambda old, new, keys: self._without(old, new, by).unionByName(tables.newest(new, keys)), "replace", None)

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows with these keys (columns: the table's keys)."""
        own = self.manifest()["keys"]
        return self._change(keys.select(*own), lambda old, gone, k: self._without(old, gone, k), "delete", None)

    def reload(self, rows: DataFrame) -> int:
        """All rows anew, unless there are none, which leave the table as it is."""
        m = self.manifest()
        rows = saved(rows.select(*[f["name"] for f in m["schema"]["fields"]]), "change")
        if rows.isEmpty():
            return m["version"]
        return self._write(m | {"slices": {}}, tables.newest(rows, m["keys"]), [], "reload", None)

    @staticmethod
    def _without(old: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
        other = gone.select(*[F.col(c).alias(f"__{c}") for c in by]).distinct()
        same = F.lit(True)
        for c in by:
            same = same & old[c].eqNullSafe(other[f"__{c}"])
        return old.join(other, same, "left_anti")

    def _slice(self, m: dict):
        return F.pmod(F.xxhash64(*m["slice_by"]), F.lit(m["count"])).cast("int")

    def _change(self, rows: DataFrame, combine, change: str, mark: str | None) -> int:
        m = self.manifest()
        if m is None:
            raise ValueError(f"no table at {self.path}")
        if mark is not None and m["mark"] == mark:
            return m["version"]
        rows = saved(rows, "change")
        touched = [r[0] for r in rows.select(self._slice(m)).distinct().collect()]  # at most the number of slices
        if not touched:
            return m["version"]
        number = self._write(m, combine(self.read(m["version"], touched), rows, m["keys"]), touched, change, mark)
        discard(rows)
        return number

    def _write(self, m: dict, rows: DataFrame, touched: list[int], change: str, mark: str | None) -> int:
        where = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__slice", self._slice(m)).repartition("__slice", F.pmod(F.xxhash64(*m["keys"], F.lit(1)), F.lit(m["spread"])))
        dealt.write.partitionBy("__slice").parquet(f"{self.path}/{where}")
        folder, files = _files(self.spark, f"{self.path}/{where}/__slice=*")
        made = {f.getPath().getName().split("=")[1]: [f"{where}/{f.getPath().getName()}"] for f in files.globStatus(folder) or []}
        kept = {s: p for s, p in m["slices"].items() if int(s) not in touched}
        return self._put(m | {"version": m["version"] + 1, "slices": kept | made, "change": change, "mark": mark, "at": time.time()})

    # --- cleaning

    def vacuum(self, keep: int = 1) -> int:
        """Keep the last ``keep`` versions; delete the others and every folder that none of those kept names. Returns how many
        folders went. No change may be under way."""
        known = self.versions()
        held = {p.split("/")[1] for v in known[-keep:] for own in self.manifest(v)["slices"].values() for p in own}
        for v in known[:-keep]:
            path, files = _files(self.spark, f"{self.path}/manifests/{v}.json")
            files.delete(path, False)
        folder, files = _files(self.spark, f"{self.path}/data/*")
        gone = [f.getPath() for f in files.globStatus(folder) or [] if f.getPath().getName() not in held]
        for path in gone:
            files.delete(path, True)
        left, files = _files(self.spark, f"{self.path}/writing")
        files.delete(left, True)
        return len(gone)
