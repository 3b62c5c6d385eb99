"""Readers that take ranges of files, not whole ones: heads of disk images, directories of zip containers, entries as streams.

Paths come as a DataFrame (as ``listing`` makes it, which reads no content), so Spark deals the files to tasks and the driver holds none. A task opens a
file in its store (a local or shared folder, or a store that pyarrow knows by its URI), seeks, and keeps a chunk at a time, whatever the file's size.
"""

from __future__ import annotations

import hashlib
import os
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..lineage import cut
from .inventories import COPIER, COPIER_MOST, HEADERS

CHUNK = 1 << 20
ROWS = 5_000
#: Fixed value: bytes of a disk image's header.
DISK_HEADER = 124
BROKEN = (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, zlib.error, ValueError, OSError)


def opened(path: str):
    """A file for reading, at any place."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


LISTED = "root string, path string, kind string, size long, mtime double, depth int"


def plain(path: str) -> str:
    """A path without the scheme of local files, which other readers leave out as well."""
    return re.sub("^file:/*", "/", path).rstrip("/") or "/"


def children(root: str, folder: str, depth: int) -> Iterator[tuple]:
    """What a folder holds: files and folders, hidden ones and links left out. A root that is a file is itself, spelt as its folder spells it; one that isn't there is gone."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    link = os.path.islink if isinstance(store, fs.LocalFileSystem) else lambda _: False
    full = lambda p: folder[: len(folder) - len(at)] + p if folder.endswith(at) else p
    try:
        found = store.get_file_info(fs.FileSelector(at))
        own = depth + 1
    except (NotADirectoryError, FileNotFoundError, OSError):
        if depth:
            return
        parent, name = at.rsplit("/", 1)
        try:
            beside = [i for i in store.get_file_info(fs.FileSelector(parent or "/")) if i.type == fs.FileType.File and i.base_name.lower() == name.lower()]
        except OSError:
            beside = []
        found = sorted(beside, key=lambda i: (i.base_name != name, i.base_name))[:1]
        own = 1
        if not found:
            yield root, folder, "gone", None, None, 0
    for info in found:
        if not info.base_name.startswith(".") and not link(info.path):
            kind = "file" if info.type == fs.FileType.File else "folder"
            yield root, full(info.path), kind, info.size, info.mtime and info.mtime.timestamp(), own


def looked(places: DataFrame) -> DataFrame:
    """The children of places (root, path, depth), each place listed by one task."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["root", "path", "kind", "size", "mtime", "depth"]
        for pdf in parts:
            for root, path, depth in zip(pdf["root"], pdf["path"], pdf["depth"], strict=True):
                rows = list(children(root, path, int(depth)))
                for k in range(0, len(rows), ROWS):
                    yield pd.DataFrame(rows[k : k + ROWS], columns=columns).astype({"size": object, "mtime": object})

    return places.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(look, LISTED)


def as_files(found: DataFrame) -> DataFrame:
    files = found.where("kind = 'file'").dropDuplicates(["path"])
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("entry_name"), "size", F.timestamp_micros((F.col("mtime") * 1_000_000).cast("long")).alias("mtime"))


def files_named(paths: DataFrame) -> DataFrame:
    """Files that a table names (path) in any letter case, spelt as their folders spell them; those that aren't there have no row.

    Each folder is listed once, however many of its files are named; names meet what it holds by an equi-join.
    """
    own = paths.select(F.regexp_replace("path", "^file:/*", "/").alias("root")).distinct().withColumn("folder", F.coalesce(F.nullif(F.regexp_extract("root", "(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit("/")))
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    found = cut(looked(own.select(F.col("folder").alias("root"), F.col("folder").alias("path"), F.lit(1).alias("depth")).distinct()))
    files = found.where("kind = 'file'").select(F.col("root").alias("folder"), "path", "kind", "size", "mtime", name("path").alias("name"))
    met = cut(own.withColumn("name", name("root")).join(files, ["folder", "name"]))
    # Of several files that differ by case alone the one of the name's own case, else the first.
    best = met.groupBy("root").agg(F.min_by(F.struct("path", "kind", "size", "mtime"), F.struct(F.element_at(F.split("path", "/"), -1) != F.element_at(F.split("root", "/"), -1), F.col("path"))).alias("f"))
    return as_files(best.select("f.*"))


def walk(spark: SparkSession, roots: Sequence[str], most_depth: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, skipped folders, roots that aren't there): everything under the roots, the folders of one level a round.

    Files are (path, entry_name, size, mtime), empty ones included; a path under two roots comes once. Folders below ``most_depth`` levels are skipped, and told.
    """

    front = spark.createDataFrame([(plain(r), plain(r), 0) for r in roots], "root string, path string, depth int")
    rounds = []
    while not front.isEmpty():
        rounds.append(cut(looked(front)))
        # A file counts in the level of its folder, so folders of the last level are skipped.
        open_ = F.col("kind") == "folder"
        front = rounds[-1].where(open_ if most_depth is None else open_ & (F.col("depth") < most_depth)).select("root", "path", "depth")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    files = as_files(every)
    skipped = every.where((F.col("kind") == "folder") & (F.col("depth") >= (most_depth or 1 << 30))).select(F.col("path").alias("folder")).distinct()
    return files, skipped, every.where("kind = 'gone'").select("root").distinct()


def listing(spark: SparkSession, roots: Sequence[str], most_depth: int | None = None) -> DataFrame:
    """(path, entry_name, size, mtime) of all files under the roots; their content isn't read."""
    return walk(spark, roots, most_depth)[0]


def each_file(paths: DataFrame, rows_of: Callable[[str], Iterator[tuple]], schema: str, columns: Sequence[str]) -> DataFrame:
    """Rows of each path, some thousands at a time. Files are dealt one by one, so a task's share doesn't hang on how paths lay together."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in parts:
            for path in pdf["path"]:
                for row in rows_of(path):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=list(columns), dtype=object)
                        rows = []
        yield pd.DataFrame(rows, columns=list(columns), dtype=object)

    return paths.select("path").distinct().mapInPandas(run, schema)


def heads(paths: DataFrame, n: int = DISK_HEADER) -> DataFrame:
    """(path, content): the first ``n`` bytes of each file, fewer if it has fewer; null if it can't be read."""

    def head(path: str) -> Iterator[tuple]:
        try:
            with opened(path) as f:
                yield path, f.read(n)
        except OSError:
            yield path, None

    return each_file(paths, head, "path string, content binary", ["path", "content"])


DIRECTORY = ("path", "entry_name", "size", "stored_crc32", "local_crc32", "comment", "read_state")


def entries_of(f, path: str, z: zipfile.ZipFile) -> Iterator[tuple[zipfile.ZipInfo, tuple]]:
    comment = z.comment.decode("utf-8", "replace") or None
    for info in z.infolist():
        if not info.is_dir():
            f.seek(info.header_offset + 14)
            local = int.from_bytes(f.read(4), "little")
            told = f"{local:08x}" if not info.flag_bits & 8 else None
            yield info, (path, info.filename, info.file_size, f"{info.CRC:08x}", told, comment, "skipped" if info.flag_bits & 1 else "ok")


def zip_directory(paths: DataFrame) -> DataFrame:
    """The entries of zip containers as ``inventories.zip_entries`` tells them, from the end record, the directory and four bytes of each entry's own header."""

    def rows(path: str) -> Iterator[tuple]:
        try:
            with opened(path) as f, zipfile.ZipFile(f) as z:
                for _, row in entries_of(f, path, z):
                    yield row
        except BROKEN:
            yield path, None, None, None, None, None, "corrupt"

    schema = "path string, entry_name string, size long, stored_crc32 string, local_crc32 string, comment string, read_state string"
    return each_file(paths.where(extension(F.col("path")) == "zip"), rows, schema, DIRECTORY)


class Digests:
    """crc32, md5 and sha1 of a stream."""

    def __init__(self):
        self.size, self.crc, self.rest = 0, 0, (hashlib.md5(), hashlib.sha1())

    def add(self, data: bytes) -> None:
        self.size, self.crc = self.size + len(data), zlib.crc32(data, self.crc)
        for h in self.rest:
            h.update(data)

    def told(self) -> tuple:
        return self.size, f"{self.crc:08x}", *[h.hexdigest() for h in self.rest]


def skipped_bytes(first: bytes, size: int) -> int | None:
    """Bytes before the payload, by the rules of ``inventories.header_length``."""
    for magic, n in HEADERS:
        if first.startswith(magic):
            return n
    return COPIER if size % 1024 == COPIER and size <= COPIER_MOST else None


def digests(stream, size: int) -> tuple[tuple, tuple | None]:
    """Digests of a stream of ``size`` bytes, and of what is behind its header, null without one; a chunk is held at a time."""
    whole, behind, data = Digests(), None, stream.read(CHUNK)
    skip = skipped_bytes(data, size)
    if skip is not None:
        behind = Digests()
        behind.add(data[skip:])
    while data:
        whole.add(data)
        data = stream.read(CHUNK)
        if behind is not None:
            behind.add(data)
    return whole.told(), behind and behind.told()


PRINTS = ("path", "entry_name", "size", "crc32", "md5", "sha1", "stripped", "read_state")
STRIPPED = ("size", "crc32", "md5", "sha1")


def streamed_fingerprints(paths: DataFrame) -> DataFrame:
    """(path, entry_name, size, crc32, md5, sha1, stripped, read_state) of loose files and of the entries of zip containers.

    An unreadable file is one row in state corrupt, so is a container whose entries can't be unpacked; encrypted entries are skipped. Markers have no hashes.
    """

    def rows(path: str) -> Iterator[tuple]:
        name = path.rsplit("/", 1)[-1]
        print_ = lambda entry, found: (path, entry, *found[0], found[1] and dict(zip(STRIPPED, found[1], strict=True)), "ok")
        try:
            with opened(path) as f:
                if not name.lower().endswith(".zip"):
                    yield print_(name, digests(f, f.size()))
                    return
                with zipfile.ZipFile(f) as z:
                    for info, row in list(entries_of(f, path, z)):
                        if row[-1] == "ok":
                            with z.open(info) as stream:
                                yield print_(info.filename, digests(stream, info.file_size))
                        else:
                            yield path, info.filename, info.file_size, None, None, None, None, "skipped"
        except BROKEN:
            yield path, None, None, None, None, None, None, "corrupt"

    schema = "path string, entry_name string, size long, crc32 string, md5 string, sha1 string, stripped struct<size:long,crc32:string,md5:string,sha1:string>, read_state string"
    found = cut(each_file(paths, rows, schema, PRINTS))
    # Entries before the one that failed were told already: a broken container is its marker alone.
    broken = found.where("read_state = 'corrupt'").select("path").distinct()
    return found.where("read_state <> 'corrupt'").join(broken, "path", "left_anti").unionByName(found.where("read_state = 'corrupt'"))
