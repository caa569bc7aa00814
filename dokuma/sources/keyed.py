"""A Spark data source of files by key: folders or object stores, read whole or as a stream.

``spark.dataSource.register(KeyedFiles)`` makes the format ``keyed_files`` known. Options: ``path`` (a folder's URI that Arrow's
file systems open), ``suffix`` (.json), ``depth`` (of the folders that become partitions, 1), ``page`` (keys a trigger of
the stream, 1000), ``slice`` (keys a partition of a trigger, 100), ``ledger`` (the stream's own folder), ``contents`` (false:
keys and sizes only), ``replace`` (true: bytes that are no UTF-8 are replaced, not an error).

A row is (key, size, body, error): the key below ``path``, and the file's text, or why it could not be read; no file stops a
load. Rows are handed over by their bytes, so a task holds some files at a time, whatever their size. Read whole, every folder at ``depth`` is a partition that its task lists itself, so no list of all keys is anywhere.

As a stream, the offset is the last key read: keys are walked in order, folders that lie before it are not listed, and a
trigger takes the next ``page`` keys. So files must arrive under rising keys; one that sorts before the offset is not seen.
Spark asks for the next offset without saying where its checkpoint stands, so each offset is noted in ``ledger`` before it is
given; after a restart the next batch runs from the checkpoint's own offset to beyond the note, and every key is read once.
Each trigger lists the folders it reads from twice, which grows with the square of a folder's files. With ``hold`` (false), listings
of local folders are held over triggers until the folder changes, see ``Held``. That is for file systems that keep the times of
their folders; mounts of object stores often do not, and other file systems than local ones are always listed anew.
"""

from __future__ import annotations

import os
import time
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "key string, size long, body string, error string"
COLUMNS = pa.schema([("key", pa.string()), ("size", pa.int64()), ("body", pa.string()), ("error", pa.string())])
#: Bytes and rows of files handed over at once.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
#: Seconds after which a change of a folder shows in its times, however coarse they are.
SETTLED = 3.0


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    files, base = fs.FileSystem.from_uri(path)
    return files, base.rstrip("/")


def listed(files: fs.FileSystem, base: str, folder: str) -> tuple[list[str], list[int]]:
    """Names in a folder in the order of their keys, those of folders with a slash, and sizes; hidden names are left out."""
    found = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True))
    named = sorted((i.base_name + "/" * (i.type == fs.FileType.Directory), i.size) for i in found if i.base_name[:1] not in "._")
    return [n for n, _ in named], [size for _, size in named]


class Held:
    """``listed`` for folders that are asked for again and again. What enters or leaves a local folder changes its times, so a
    listing is held until they differ. Times are coarse: two changes in one tick leave the same ones. So a listing is held only
    if it was begun ``SETTLED`` seconds, by this process' clock, after the times were first seen; until then each is made anew."""

    def __init__(self, files: fs.FileSystem, base: str, hold: bool):
        self.files, self.base = files, base
        self.hold = hold and isinstance(files, fs.LocalFileSystem)
        self.first: dict[str, tuple] = {}
        self.held: dict[str, tuple[list[str], list[int]]] = {}

    def _stamp(self, folder: str) -> tuple | None:
        try:
            at = os.stat(f"{self.base}/{folder}") if self.hold else None
        except OSError:
            return None
        return at and (at.st_dev, at.st_ino, at.st_mtime_ns, at.st_ctime_ns)

    def __call__(self, folder: str) -> tuple[list[str], list[int]]:
        for behind in [f for f in self.first if not folder.startswith(f) and not f.startswith(folder)]:  # a walk does not soon come back
            del self.first[behind]
            self.held.pop(behind, None)
        stamp, now = self._stamp(folder), time.monotonic()
        if folder not in self.first or self.first[folder][0] != stamp:
            self.first[folder] = stamp, now
            self.held.pop(folder, None)
        if folder in self.held:
            return self.held[folder]
        found = listed(self.files, self.base, folder)
        if stamp and now - self.first[folder][1] >= SETTLED:
            self.held[folder] = found
        return found


def walk(files: fs.FileSystem, base: str, folder: str = "", after: str = "", suffix: str = "", deep: bool = True, listing: Callable | None = None) -> Iterator[tuple[str, int]]:
    """(key, size) of the files below a folder in the order of their keys, from behind ``after`` on; hidden names are left
    out. Folders all of whose keys lie before ``after`` are not listed. ``listing`` stands in for ``listed``."""
    names, sizes = listing(folder) if listing else listed(files, base, folder)
    head, slash, _ = after[len(folder) :].partition("/") if after.startswith(folder) else ("", "", "")
    for at in range(bisect_left(names, head + slash), len(names)):
        name, key = names[at], folder + names[at]
        if name.endswith("/"):
            if deep and (key > after or after.startswith(key)):
                yield from walk(files, base, key, after, suffix, listing=listing)
        elif key > after and key.endswith(suffix):
            yield key, sizes[at]


def folders(files: fs.FileSystem, base: str, depth: int, folder: str = "") -> Iterator[tuple[str, bool]]:
    """(folder, whether with all below it) at ``depth``, and those above for the files in them."""
    yield folder, depth == 0
    if depth:
        for i in files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), allow_not_found=True)):
            if i.type == fs.FileType.Directory and i.base_name[:1] not in "._":
                yield from folders(files, base, depth - 1, f"{folder}{i.base_name}/")


def fetched(files: fs.FileSystem, base: str, keys: Iterator[tuple[str, int]], replace: bool = False) -> Iterator[tuple]:
    for key, size in keys:
        try:
            with files.open_input_stream(f"{base}/{key}") as f:
                yield key, size, f.read().decode(errors="replace" if replace else "strict"), None
        except (OSError, UnicodeDecodeError) as failed:
            yield key, size, None, str(failed)[:300]


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that hold about ``BATCH_BYTES`` of texts."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[2] or "") + 100
        if n >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), COLUMNS)], schema=COLUMNS)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), COLUMNS)], schema=COLUMNS)


def _rows(options: dict, files: fs.FileSystem, base: str, keys: Iterator[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    if options.get("contents", "true").lower() == "false":
        return batches((key, size, None, None) for key, size in keys)
    return batches(fetched(files, base, keys, options.get("replace", "false").lower() == "true"))


@dataclass
class Folder(InputPartition):
    folder: str
    deep: bool


@dataclass
class Keys(InputPartition):
    keys: list


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Folder]:
        return [Folder(*x) for x in folders(*_opened(self.options["path"]), int(self.options.get("depth", 1)))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, base = _opened(self.options["path"])
        yield from _rows(self.options, files, base, walk(files, base, partition.folder, suffix=self.options.get("suffix", ".json"), deep=partition.deep))


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.page, self.slice = int(self.options.get("page", 1000)), int(self.options.get("slice", 100))
        if not self.options.get("ledger"):
            raise ValueError("the stream of keyed_files needs the option ledger, a folder of its own")
        self.listing: Held | None = None

    def _keys(self, after: str) -> Iterator[tuple[str, int]]:
        self.listing = self.listing or Held(*_opened(self.options["path"]), self.options.get("hold", "false").lower() == "true")
        return walk(self.listing.files, self.listing.base, after=after, suffix=self.options.get("suffix", ".json"), listing=self.listing)

    def _noted(self) -> str:
        """The last offset given. Notes are numbered files, so one that is cut short does not hide the one before it."""
        files, base = _opened(self.options["ledger"])
        for i in sorted(files.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda i: i.base_name, reverse=True):
            with files.open_input_stream(i.path) as f:
                text = f.read().decode(errors="replace")
            if text.endswith("\n"):
                return text[:-1]
        return ""

    def _note(self, key: str) -> None:
        files, base = _opened(self.options["ledger"])
        files.create_dir(base, recursive=True)
        old = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(base)))
        with files.open_output_stream(f"{base}/{int(old[-1]) + 1 if old else 0:012d}") as f:
            f.write(f"{key}\n".encode())
        for name in old[:-2]:
            files.delete_file(f"{base}/{name}")

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        noted = last = self._noted()
        for last, _ in islice(self._keys(noted), self.page):
            pass
        if last != noted:
            self._note(last)
        return {"after": last}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        keys = list(takewhile(lambda k: k[0] <= end["after"], self._keys(start["after"])))
        if self.listing.hold:  # a file that is written over does not change its folder, and a held size may be old
            now = self.listing.files.get_file_info([f"{self.listing.base}/{key}" for key, _ in keys])
            keys = [(key, size if i.size is None else i.size) for (key, size), i in zip(keys, now)]
        return [Keys(keys[i : i + self.slice]) for i in range(0, len(keys), self.slice)]

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.options, *_opened(self.options["path"]), iter(partition.keys))

    def commit(self, end: dict) -> None:
        pass


class KeyedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(KeyedFiles)
    return spark.read.format("keyed_files").options(path=path, **options).load()


def stream(spark: SparkSession, path: str, ledger: str, **options) -> DataFrame:
    spark.dataSource.register(KeyedFiles)
    return spark.readStream.format("keyed_files").options(path=path, ledger=ledger, **options).load()


def parsed(rows: DataFrame, schema: str, *, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, record), (key, error)): the JSON of bodies (``lines``: of their lines) and what could not be read or parsed."""
    lines_of = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "") if lines else F.array("body")
    # Parsed inside the generator, a line is parsed once; as a column it would be once for the filter and again for the record.
    each = F.transform(lines_of, lambda x: F.from_json(x, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    read = rows.where("error IS NULL").select("key", F.explode(each).alias("r"))
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull()
    unread = rows.where("error IS NOT NULL").select("key", "error")
    return read.where(~bad).select("key", F.col("r").dropFields("_broken").alias("record")), unread.union(read.where(bad).select("key", F.lit("no JSON object").alias("error")))


def downloaded(wanted: DataFrame, source: str, target: str) -> DataFrame:
    """Copy files (key) from one folder's URI to another's: (key, status, size, error) with the status downloaded, skipped (it is
    there with the source's size) or error. A file is written under a hidden name first, so that one that was cut short is not
    taken for whole; each key is copied by one task, and repeated keys once."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (read, base), (write, end) = _opened(source), _opened(target)
        for pdf in frames:
            rows = []
            for key in pdf.key:
                try:
                    there = read.get_file_info(f"{base}/{key}")
                    if there.type != fs.FileType.File:
                        raise FileNotFoundError(key)
                    if write.get_file_info(f"{end}/{key}").size == there.size:
                        rows.append((key, "skipped", there.size, None))
                        continue
                    folder, _, name = f"{end}/{key}".rpartition("/")
                    write.create_dir(folder, recursive=True)
                    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    with read.open_input_stream(f"{base}/{key}") as a, write.open_output_stream(part) as b:
                        while block := a.read(1 << 20):
                            b.write(block)
                    write.move(part, f"{end}/{key}")
                    rows.append((key, "downloaded", there.size, None))
                except OSError as failed:
                    rows.append((key, "error", None, str(failed)[:300]))
            yield pd.DataFrame(rows, columns=["key", "status", "size", "error"]).astype({"size": "Int64"})

    return wanted.select("key").where("key IS NOT NULL").distinct().repartition("key").mapInPandas(work, "key string, status string, size long, error string")


def written(rows: DataFrame, target: str) -> int:
    """Write texts (key, text) as files below a folder's URI, one each; returns their number. A null text is an empty file."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(target)
        made = set()
        for pdf in frames:
            for key, text in zip(pdf.key, pdf.text):
                folder = f"{base}/{key}".rpartition("/")[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{base}/{key}") as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("key", "text").mapInPandas(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
