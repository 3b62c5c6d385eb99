"""Inventory readers: files, entries of zip containers, fingerprints."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, file_name, unsupported_container

#: Header lengths by the first bytes, and where a copier's header makes sizes odd.
HEADERS = ((b"NES\x1a", 16), (b"LYNX", 64))
COPIER, COPIER_MOST = 512, 64 << 20
#: Entries of several containers are handed on together, up to so many or so many bytes of content.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def present_roots(spark: SparkSession, roots: Sequence[str]) -> tuple[list[str], list[str]]:
    """(roots that can be reached, roots that can't)."""
    there, gone = [], []
    for root in roots:
        folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        (there if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else gone).append(root)
    return there, gone


def files_below(spark: SparkSession, roots: Sequence[str]) -> DataFrame | None:
    found = None
    for root in present_roots(spark, roots)[0]:
        part = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path = F.regexp_replace("path", "^file:", "")
        below = re.sub("^file:/*", "/", root.rstrip("/"))
        depth = F.size(F.split(F.substring(path, len(below) + 2, 1 << 20), "/"))
        part = part.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content", depth.alias("depth"))
        found = part if found is None else found.unionByName(part)
    return found


def scan(spark: SparkSession, roots: Sequence[str], most_depth: int | None = None) -> DataFrame:
    """(path, entry_name, size, mtime, content) of all files under the roots that can be reached; hidden ones are left out, a path under two roots comes once.

    ``content`` is read only if a query uses it. See ``present_roots`` and ``too_deep`` for what is not in it.
    """
    found = files_below(spark, roots)
    if found is None:
        return spark.createDataFrame([], "path string, entry_name string, size long, mtime timestamp, content binary")
    found = found.where(F.col("depth") <= most_depth) if most_depth else found
    return found.where(~F.col("path").rlike(r"/\.[^/]+(/|$)")).dropDuplicates(["path"]).select("path", file_name(F.col("path")).alias("entry_name"), "size", "mtime", "content")


def too_deep(spark: SparkSession, roots: Sequence[str], most_depth: int) -> DataFrame:
    """(folder, n): the folders that a scan of that depth skips, and how many files are in each or below."""
    found = files_below(spark, roots)
    if found is None:
        return spark.createDataFrame([], "folder string, n long")
    keep = F.size(F.split("path", "/")) - (F.col("depth") - most_depth)
    return found.where(F.col("depth") > most_depth).groupBy(F.array_join(F.slice(F.split("path", "/"), F.lit(1), keep), "/").alias("folder")).agg(F.count("*").alias("n"))


def supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, count of unsupported containers by extension)."""
    return files.where(~unsupported_container(F.col("path"))), files.where(unsupported_container(F.col("path"))).groupBy(extension(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


def zip_entries(files: DataFrame, content: bool = False) -> DataFrame:
    """(path, entry_name, size, stored_crc32, local_crc32, comment, read_state[, content]) of zip containers.

    A container that can't be read is one row in state corrupt without hashes, an encrypted entry one in state skipped. local_crc32 is what the entry's own header
    says, null where the header leaves it to a descriptor.
    """

    columns = ["path", "entry_name", "size", "stored_crc32", "local_crc32", "comment", "read_state", "content"]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, held = [], 0
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        for info in z.infolist():
                            if info.is_dir():
                                continue
                            local = int.from_bytes(data[info.header_offset + 14 : info.header_offset + 18], "little")
                            state = "skipped" if info.flag_bits & 1 else "ok"
                            body = z.read(info) if content and state == "ok" else None
                            rows.append((path, info.filename, info.file_size, f"{info.CRC:08x}", f"{local:08x}" if not info.flag_bits & 8 else None, z.comment.decode("utf-8", "replace") or None, state, body))
                except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, zlib.error, ValueError):
                    rows = [(path, None, None, None, None, None, "corrupt", None)]
                told += rows
                held += sum(len(r[7] or b"") for r in rows)
                if len(told) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pd.DataFrame(told, columns=columns)
                    told, held = [], 0
        if told:
            yield pd.DataFrame(told, columns=columns)

    out = files.where(extension(F.col("path")) == "zip").select("path", "content").mapInPandas(read, "path string, entry_name string, size long, stored_crc32 string, local_crc32 string, comment string, read_state string, content binary")
    return out if content else out.drop("content")


def from_directory(entries: DataFrame) -> DataFrame:
    """Entries with the checksum that their container's directory states as their identity: nothing is unpacked for it."""
    return entries.where("read_state = 'ok'").select("path", "entry_name", "size", F.col("stored_crc32").alias("crc32"))


def checksum_conflicts(entries: DataFrame) -> DataFrame:
    """Entries whose own header has another checksum than the container's directory; an unknown one is no conflict."""
    return entries.where("read_state = 'ok' AND local_crc32 <> stored_crc32").select("path", "entry_name")


def fingerprints(df: DataFrame, content: str = "content", hashes: Sequence[str] = ("crc32", "md5", "sha1")) -> DataFrame:
    """``df`` with the chosen hashes of a text or binary column."""
    data = F.col(content).cast("binary")
    how = {"crc32": F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0"), "md5": F.md5(data), "sha1": F.sha1(data)}
    return df.withColumns({h: how[h] for h in hashes})


def header_length(content: Column) -> Column:
    """Bytes before the payload by the first rule that fits; null without one."""
    out = None
    for magic, n in HEADERS:
        hit = F.substring(content, 1, len(magic)) == F.lit(magic)
        out = F.when(hit, n) if out is None else out.when(hit, n)
    return out.when((F.length(content) % 1024 == COPIER) & (F.length(content) <= COPIER_MOST), COPIER)


def stripped_fingerprints(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with stripped: struct<size, crc32, md5, sha1> of the content behind its header, null without one."""
    n = header_length(F.col(content))
    body = F.substr(F.col(content), n + 1, F.length(content))
    return df.withColumn("stripped", F.when(n.isNotNull(), F.struct((F.length(content) - n).cast("long").alias("size"), F.lpad(F.lower(F.hex(F.crc32(body))), 8, "0").alias("crc32"), F.md5(body).alias("md5"), F.sha1(body).alias("sha1"))))


def normalised_bytes(name: str, data: bytes) -> bytes:
    """Contents in one byte order: interleaved 16 KiB blocks behind a copier's header, and 4-byte words of swapped images."""
    low = name.lower()
    if low.endswith(".smd") and len(data) % 16384 == COPIER:
        blocks = np.frombuffer(data[COPIER:], np.uint8).reshape(-1, 2, 8192)
        return np.stack([blocks[:, 1], blocks[:, 0]], 2).tobytes()
    if len(data) % 4 == 0 and data[:4] == b"\x37\x80\x40\x12":
        return np.frombuffer(data, np.uint8).reshape(-1, 2)[:, ::-1].tobytes()
    if len(data) % 4 == 0 and data[:4] == b"\x40\x12\x37\x80":
        return np.frombuffer(data, np.uint8).reshape(-1, 4)[:, ::-1].tobytes()
    return data


def normalised(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with content in one byte order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(content=[normalised_bytes(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)])

    return files.mapInPandas(run, files.schema)
