"""Queries of readers over files that Spark writes from the sample tables into its shared folder, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import headers
from .lineage import scratch
from .operators import titles
from .queries_layout import ENTRIES, cartridges, packed
from .queries_more import TITLES
from .sources import catalogs, inventories, ranges, stores

c = F.col


def written(spark: SparkSession, files: DataFrame) -> str:
    """``files`` (path, content) as files below a new folder, which each task writes its own of."""
    folder = scratch(spark)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                store, at = fs.FileSystem.from_uri(folder.replace("file:///", "/").replace("file:/", "/") + path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def below(df: DataFrame, folder: str) -> DataFrame:
    """Paths as they were before they were written below ``folder``."""
    return df.withColumn("path", F.regexp_replace("path", "^.*?" + folder.rsplit("/", 1)[-1], ""))


def disk_images(spark, d):
    """Disk files with a header: every ninth of an older version, every fourth with a parent."""
    rows = view(spark, d, "fx_disk_files").groupBy("path").agg(F.min("sha1").alias("sha1"))
    n, zeros = F.length("path"), lambda k: F.lit(bytes(k))
    version = F.when(c("sha1").startswith("a"), F.lit(bytes([0, 0, 0, 4]))).otherwise(F.lit(bytes([0, 0, 0, 5])))
    size = F.unhex(F.lpad(F.hex((n * 4096).cast("long")), 16, "0"))
    parent = F.when(c("sha1").substr(2, 1) < "8", F.unhex(F.sha1("path"))).otherwise(zeros(20))
    head = F.concat(F.lit(b"MComprHD"), zeros(4), version, zeros(16), size, zeros(44), F.unhex("sha1"), parent, F.encode(F.repeat("path", 50), "UTF-8"))
    return rows.select("path", head.alias("content"))


def disk_headers(spark, d):
    folder = written(spark, disk_images(spark, d))
    found = below(ranges.heads(ranges.listing(spark, [folder])), folder).withColumn("h", headers.disk_image_header(c("content")))
    return found.select("path", "h.version", "h.logical_bytes", "h.sha1", "h.parent_sha1")


def tree(spark, d):
    """The inventory's files, a few bytes each, beside hidden ones."""
    paths = view(spark, d, "fx_inventory").select("path").distinct()
    hidden = paths.where("path LIKE '/r1/%'").select(F.concat(F.lit("/r1/.hidden"), "path").alias("path"))
    return written(spark, paths.unionByName(hidden).withColumn("content", F.encode(F.col("path"), "UTF-8")))


def scanned(spark, d):
    folder = tree(spark, d)
    return below(ranges.listing(spark, [f"{folder}/{r}" for r in ("r0", "r1", "r0/sub", "nowhere")], 1), folder).select("path", "entry_name", "size")


def skipped(spark, d):
    folder = tree(spark, d)
    found = inventories.too_deep(spark, [f"{folder}/r0", f"{folder}/r2"], 1)
    return below(found.withColumnRenamed("folder", "path"), folder)


def at_the_limit(spark, d):
    folder = tree(spark, d)
    return below(ranges.walk(spark, [f"{folder}/r0", f"{folder}/r2"], 1)[1].withColumnRenamed("folder", "path"), folder)


def letter_case(spark, d):
    """Every file of a root named one by one, in capitals: they come as they are spelt."""
    folder = tree(spark, d)
    names = view(spark, d, "fx_inventory").where("path LIKE '/r1/%' AND path NOT LIKE '/r1/%/%'").select(F.upper(F.regexp_extract("path", "[^/]*$", 0)).alias("name")).distinct()
    return below(ranges.files_named(names.select(F.concat(F.lit(f"{folder}/r1/"), "name").alias("path"))), folder).select("path", "entry_name", "size")


def directory(spark, d):
    folder = written(spark, packed(spark, d))
    return below(ranges.zip_directory(ranges.listing(spark, [folder])), folder)


def prints(spark, d):
    folder = written(spark, packed(spark, d))
    return below(ranges.streamed_fingerprints(ranges.listing(spark, [folder])), folder).select("path", "entry_name", "size", "crc32", "md5", "sha1")


def title_catalog(spark, d):
    """Title sets written as a catalog in XML, and read again."""
    path = scratch(spark)
    stores.title_catalog(titles.title_sets(view(spark, d, "fx_titles")), path)
    return catalogs.catalog_items(catalogs.read_sets(spark, path, "datafile")).select("set_name", "item_name")


#: crc32 of short texts: each byte is mixed in, then eight shifts by the polynomial 0xEDB88320.
CRC = """lpad(lower(hex(xor(list_reduce(flatten(list_transform(string_split({t}, ''), lambda d: list_concat([CAST(ascii(d) AS BIGINT)], list_resize(CAST([] AS BIGINT[]), 8, 256)))),
  lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(4294967295 AS BIGINT)), 4294967295))), 8, '0')"""
NAME = "regexp_extract(path, '[^/]*$')"

QUERIES = {
    "S15_disk_headers": (disk_headers, """SELECT path, CASE WHEN ok THEN 5 END AS version, CASE WHEN ok THEN length(path) * 4096 END AS logical_bytes, CASE WHEN ok THEN sha1 END AS sha1, CASE WHEN ok AND substr(sha1, 2, 1) < '8' THEN sha1(path) END AS parent_sha1
      FROM (SELECT path, min(sha1) AS sha1, NOT starts_with(min(sha1), 'a') AS ok FROM fx_disk_files GROUP BY 1)"""),
    "S16_cartridge_headers": (lambda s, d: cartridges(s, d).withColumn("h", headers.cartridge_header(c("hex"))).select("doc_id", "h.mapper", "h.prg_kb", "h.audio_chip"), """SELECT doc_id, mapper, prg_kb, CASE mapper WHEN 5 THEN 'Nintendo MMC5 — audio expansion' WHEN 19 THEN 'Namco 163 — audio expansion' WHEN 24 THEN 'Konami VRC6 — audio expansion' WHEN 26 THEN 'Konami VRC6 — audio expansion' WHEN 85 THEN 'Konami VRC7 — audio expansion' END AS audio_chip
      FROM (SELECT doc_id, CAST(((doc_id * 11 % 256) & 240) | ((doc_id * 7 % 256) >> 4) AS INTEGER) AS mapper, CAST(doc_id * 3 % 256 * 16 AS INTEGER) AS prg_kb FROM documents)"""),
    "S6_scan_of_a_tree": (scanned, f"SELECT DISTINCT path, {NAME} AS entry_name, length(path) AS size FROM fx_inventory WHERE (path LIKE '/r0/%' OR path LIKE '/r1/%') AND (path NOT LIKE '/r1/%/%' AND (path NOT LIKE '/r0/%/%' OR path LIKE '/r0/sub/%'))"),
    "S6_skipped_folders": (skipped, "SELECT regexp_replace(path, '/[^/]*$', '') AS path, count(DISTINCT path) AS n FROM fx_inventory WHERE path LIKE '/r0/%/%' OR path LIKE '/r2/%/%' GROUP BY 1"),
    "S6_folders_at_the_limit": (at_the_limit, "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM fx_inventory WHERE path LIKE '/r0/%/%' OR path LIKE '/r2/%/%'"),
    "S7_letter_case": (letter_case, f"SELECT DISTINCT path, {NAME} AS entry_name, length(path) AS size FROM fx_inventory WHERE path LIKE '/r1/%' AND path NOT LIKE '/r1/%/%'"),
    "K4_title_catalog": (title_catalog, f"""WITH {TITLES}, g AS (SELECT base_id, arg_min(file_name, (rank, file_name)) AS lead FROM k GROUP BY 1), n AS (SELECT *, trim(split_part(lead, '[', 1)) AS nm FROM g), s AS (SELECT base_id, CASE WHEN row_number() OVER (PARTITION BY lower(nm) ORDER BY base_id) > 1 THEN concat(nm, ' [', base_id, ']') ELSE nm END AS set_name FROM n)
      SELECT set_name, file_name AS item_name FROM s JOIN k ON k.base_id = s.base_id"""),
    "S8_zip_directory": (directory, f"WITH {ENTRIES}, k AS (SELECT path, entry_name, concat('content of ', entry_name) AS t, length(path) % 3 = 0 AS noted, length(entry_name) % 4 = 0 AS wrong FROM e), x AS (SELECT *, {CRC.format(t='t')} AS crc FROM k) SELECT path, entry_name, length(t) AS size, crc AS stored_crc32, CASE WHEN wrong THEN concat(substr(crc, 1, 6), lpad(lower(hex(xor(CAST('0x' || substr(crc, 7, 2) AS BIGINT), 255))), 2, '0')) ELSE crc END AS local_crc32, CASE WHEN noted THEN 'note' END AS comment, 'ok' AS read_state FROM x"),
    "S9_streamed_fingerprints": (prints, f"WITH {ENTRIES}, k AS (SELECT path, entry_name, concat('content of ', entry_name) AS t FROM e) SELECT path, entry_name, length(t) AS size, {CRC.format(t='t')} AS crc32, md5(t) AS md5, sha1(t) AS sha1 FROM k"),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items()}
