"""Queries of layouts, snapshots, readers and stores, each with its SQL. Files that readers need are made by Spark from the sample tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import headers, names
from .lineage import scratch
from .operators import alternates, disks, layout, match, snapshots
from .plans import changes
from .queries_match import CTES, left, report
from .queries_more import DISKS, NULLS, REDUNDANT, plan_cols
from .sources import catalogs, inventories, stores, versions
from .streaming import incremental

c = F.col
OUT = ("set_name", "item_name", "size", "crc32")


def machines(spark, d):
    sets = view(spark, d, "fx_machines").withColumn("refs", F.array_compact(F.array("ref", "ref2")))
    return sets, view(spark, d, "fx_parts")


def laid_out(mode, base="split"):
    return lambda s, d: layout.build_layout(*machines(s, d), mode, base).select(*OUT)


def layout_sizes(spark, d):
    each = [laid_out(mode)(spark, d).withColumn("mode", F.lit(mode)) for mode in layout.MODES]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("mode", "set_name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


SPLIT = "sp AS (SELECT DISTINCT set_name, item_name, size, crc32 FROM fx_parts WHERE merge_name IS NULL)"
#: Each set and what is above it, from the set on; chains here have three sets at most. Those with an unknown name above are left out.
CHAINS = """m AS (SELECT * FROM fx_machines),
c1 AS (SELECT set_name AS s, set_name AS x, 0 AS depth, rom_of FROM m UNION ALL SELECT a.set_name, b.set_name, 1, b.rom_of FROM m a JOIN m b ON b.set_name = a.rom_of
  UNION ALL SELECT a.set_name, e.set_name, 2, e.rom_of FROM m a JOIN m b ON b.set_name = a.rom_of JOIN m e ON e.set_name = b.rom_of),
ch AS (SELECT c1.s, c1.x, c1.depth, m.is_bios FROM c1 JOIN m ON m.set_name = c1.x WHERE c1.s IN (SELECT s FROM c1 WHERE rom_of IS NULL))"""
#: Rows of a set in the order in which they replace each other: own ones, then components, in the order in which a walk in depth meets them.
NON_MERGED = CHAINS + """,
rf AS (SELECT set_name, 0 AS k, ref AS dev FROM m WHERE ref IS NOT NULL UNION ALL SELECT set_name, CASE WHEN ref IS NULL THEN 0 ELSE 1 END, ref2 FROM m WHERE ref2 IS NOT NULL),
d1 AS (SELECT s, dev, [-depth, k] AS p FROM ch JOIN rf ON rf.set_name = ch.x WHERE NOT is_bios OR depth = 0),
d2 AS (SELECT s, rf.dev, list_append(p, k) AS p FROM d1 JOIN rf ON rf.set_name = d1.dev), d3 AS (SELECT s, rf.dev, list_append(p, k) AS p FROM d2 JOIN rf ON rf.set_name = d2.dev),
dv AS (SELECT s, dev, min(p) AS p FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY 1, 2),
al AS (SELECT i.set_name, item_name, size, crc32, item_ord, CAST([] AS INTEGER[]) AS p FROM fx_parts i WHERE merge_name IS NULL AND set_name IN (SELECT s FROM ch)
  UNION ALL SELECT set_name, item_name, size, crc32, item_ord, CAST([] AS INTEGER[]) FROM (SELECT i.set_name, q.item_name, q.size, q.crc32, i.item_ord, row_number() OVER (PARTITION BY i.set_name, i.item_ord ORDER BY depth) AS r FROM fx_parts i JOIN ch ON ch.s = i.set_name AND depth > 0 AND NOT is_bios JOIN fx_parts q ON q.set_name = ch.x AND q.item_name = i.merge_name AND q.merge_name IS NULL) WHERE r = 1
  UNION ALL SELECT s, item_name, size, crc32, item_ord, p FROM dv JOIN fx_parts q ON q.set_name = dv.dev),
nm AS (SELECT set_name, item_name, size, crc32 FROM (SELECT *, row_number() OVER (PARTITION BY set_name, item_name ORDER BY p DESC, item_ord DESC) AS r FROM al) WHERE r = 1)"""
#: Sets and names are told from the first owner's; parents here hold each name once.
MERGED = """fm AS (SELECT i.*, coalesce(m.clone_of, m.set_name) AS parent, m.set_ord, m.clone_of IS NOT NULL AS variant FROM fx_parts i JOIN fx_machines m ON m.set_name = i.set_name WHERE merge_name IS NULL AND coalesce(m.clone_of, m.set_name) IN (SELECT set_name FROM fx_machines WHERE clone_of IS NULL)),
fo AS (SELECT *, first_value(crc32) OVER w AS first_crc, first_value(size) OVER w AS first_size, row_number() OVER w AS r FROM fm WINDOW w AS (PARTITION BY parent, item_name ORDER BY variant, set_ord, item_ord)),
me AS (SELECT parent AS set_name, CASE WHEN r = 1 THEN item_name ELSE concat(set_name, '/', item_name) END AS item_name, size, crc32 FROM fo WHERE r = 1 OR crc32 <> first_crc OR size <> first_size)"""
#: Base sets' items that a set lacks, the base nearest to the root first.
BASES = "ba AS (SELECT s AS set_name, item_name, size, crc32, clone_of, row_number() OVER (PARTITION BY s, item_name ORDER BY depth DESC, item_ord) AS r FROM ch JOIN fx_machines g ON g.set_name = ch.s JOIN fx_parts q ON q.set_name = ch.x WHERE ch.is_bios)"


def scanned(spark, d):
    return snapshots.reuse(view(spark, d, "fx_scan"), view(spark, d, "fx_known"), ["md5"])


#: What is known of the scan: all entries of a container, or none.
KNOWN = """k AS (SELECT s.*, o.md5, coalesce(o.mtime = s.mtime AND o.size = s.size AND o.md5 IS NOT NULL, FALSE) AS good FROM fx_scan s LEFT JOIN fx_known o ON o.path = s.path AND o.entry_path = s.entry_path),
w AS (SELECT *, bool_and(good) OVER (PARTITION BY path) AS whole FROM k)"""


def packed(spark, d):
    """The containers of the inventory as zip files (path, content); every third has a comment, and entries of every fourth length of name state another checksum than their directory."""

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = []
            for path, entries in zip(pdf["path"], pdf["entries"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for name in entries:
                        z.writestr(zipfile.ZipInfo(name), b"content of " + name.encode())
                    if len(path) % 3 == 0:
                        z.comment = b"note"
                raw = bytearray(data.getvalue())
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    for info in z.infolist():
                        if len(info.filename) % 4 == 0:
                            raw[info.header_offset + 14] ^= 255
                made.append(bytes(raw))
            yield pd.DataFrame({"path": pdf["path"], "content": made})

    rows = view(spark, d, "fx_inventory").where("path LIKE '%.zip'").groupBy("path").agg(F.sort_array(F.collect_set("entry_name")).alias("entries"))
    return rows.mapInPandas(build, "path string, content binary")


ENTRIES = "e AS (SELECT DISTINCT path, entry_name FROM fx_inventory WHERE path LIKE '%.zip')"


def round_trip(spark, d):
    """The catalog written as a data file, and read again."""
    items = view(spark, d, "fx_catalog")
    path = scratch(spark)
    catalogs.fix_catalog(items.select("set_name", "item_name", F.lit("missing").alias("status")), items, path)
    return catalogs.read_sets(spark, path, "datafile")


def headed(spark, d):
    """All documents, two of three behind a header: of 16 bytes, or of 64."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    head = F.when(c("doc_id") % 3 == 0, F.lit(b"NES\x1a" + b"\x02" * 12)).when(c("doc_id") % 3 == 1, F.lit(b"LYNX" + b"\x03" * 60)).when((F.octet_length("text") + 6) % 1024 == 512, F.lit(b"plain  ")).otherwise(F.lit(b"plain "))  # of no length that a copier's header makes
    return docs.select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"))


def redundant_with_disks(spark, d):
    x = left(spark, d)
    return plan_cols(changes.remove_redundant(x[3], match.redundant_containers(x[3], x[1]), disks.leftover_disks(view(spark, d, "fx_disks"), view(spark, d, "fx_disk_files"))))


def cartridges(spark, d):
    byte = lambda n: F.lpad(F.hex((c("doc_id") * n % 256).cast("long")), 2, "0")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("4E45531A"), *[byte(n) for n in (3, 5, 7, 11, 13, 17)]).alias("hex"))


def stored_catalog(spark, d):
    source, path = {"size": 10, "mtime": 5, "mode": "split"}, scratch(spark)
    stores.save_catalog({"items": view(spark, d, "fx_catalog")}, path, source)
    return stores.load_catalog(spark, path, ["items"], source)["items"].select("set_name", "item_name", "md5")


def stored_report(spark, d):
    path = scratch(spark)
    stores.save_report(view(spark, d, "fx_audit").drop("scanned_at"), path)
    return stores.load_report(spark, path, 3).select("row_ord", "status")


def stored_diff(spark, d):
    """A report's new rows by partition: what changed is written, and a partition whose rows all went is gone."""
    path, part = scratch(spark), (c("key") % 7).alias("part")
    before, after = (view(spark, d, n).select(part, "key", "status") for n in ("fx_prev", "fx_next"))
    versions.commit(before, path, "part")
    snapshots.save_diff(snapshots.diff(before, after.where("part <> 5"), ["part", "key"]), path, "part")
    return versions.load(spark, path, "part").select("key", "status")


def followed_snapshot(spark, d):
    """A snapshot that gets what a scan adds, batch by batch: what it knew, and the rest with fingerprints."""
    path, found = scratch(spark), ("path", "entry_path", "size", "mtime", "md5")
    now, known = view(spark, d, "fx_scan"), view(spark, d, "fx_known").where("md5 IS NOT NULL")
    incremental.save_snapshot(known.select(*found), path)
    for part in range(3):
        batch = now.where(F.pmod(F.xxhash64("path"), F.lit(3)) == part)
        _, fresh = snapshots.reuse(batch, incremental.load_snapshot(spark, path, batch), ["md5"])
        incremental.save_snapshot(fresh.withColumn("md5", F.md5(F.concat(F.lit("new"), c("size").cast("string")))).select(*found), path)
    incremental.compact(spark, path, 2)
    return incremental.load_snapshot(spark, path).select("path", "entry_path", "md5")


def written(write, read):
    def run(spark, d):
        path = scratch(spark)
        write(spark, d, path)
        return read(spark, path)

    return run


def serials(spark, d):
    left_ = view(spark, d, "fx_inventory").select("path", "entry_name", F.concat(F.lit("S"), (c("size") % 300).cast("string")).alias("serial"), (c("size") % 2).alias("image_size"))
    sets = view(spark, d, "fx_sets").select("set_name", F.concat(F.lit("S"), (c("set_ord") % 300).cast("string")).alias("serial"), (c("set_ord") % 2).alias("image_size"))
    return alternates.match_serials(left_, sets)


QUERIES = {
    "U3_split": (laid_out("split"), f"WITH {SPLIT} SELECT * FROM sp"),
    "U4_non_merged": (laid_out("non-merged"), f"WITH {NON_MERGED} SELECT * FROM nm"),
    "U5_merged": (laid_out("merged"), f"WITH {MERGED} SELECT * FROM me"),
    "U6_bases_everywhere": (laid_out("non-merged", "non-merged"), f"WITH {NON_MERGED}, {BASES} SELECT * FROM nm UNION ALL SELECT set_name, item_name, size, crc32 FROM ba WHERE r = 1 AND (set_name, item_name) NOT IN (SELECT (set_name, item_name) FROM nm)"),
    "U6_bases_of_parents": (laid_out("merged", "merged"), f"WITH {MERGED}, {CHAINS}, {BASES} SELECT * FROM me WHERE set_name IN (SELECT s FROM ch) UNION ALL SELECT set_name, item_name, size, crc32 FROM ba WHERE r = 1 AND clone_of IS NULL AND (set_name, item_name) NOT IN (SELECT (set_name, item_name) FROM me)"),
    "U7_layout_sizes": (layout_sizes, f"WITH {SPLIT}, {NON_MERGED}, {MERGED} SELECT mode, set_name, count(*) AS n, sum(size) AS bytes FROM (SELECT 'split' AS mode, * FROM sp UNION ALL SELECT 'non-merged', * FROM nm UNION ALL SELECT 'merged', * FROM me) GROUP BY 1, 2"),
    "U8_merged_disks": (lambda s, d: layout.merged_disks(machines(s, d)[0], view(s, d, "fx_parts").where("item_ord > 1").select("set_name", c("item_name").alias("disk_name"), c("crc32").alias("sha1"))), "SELECT DISTINCT coalesce(m.clone_of, m.set_name) AS set_name, item_name AS disk_name, crc32 AS sha1 FROM fx_parts p JOIN fx_machines m ON m.set_name = p.set_name WHERE item_ord > 1"),
    "I1_reused": (lambda s, d: scanned(s, d)[0].select("path", "entry_path", "md5"), f"WITH {KNOWN} SELECT path, entry_path, md5 FROM w WHERE whole"),
    "I2_to_hash": (lambda s, d: scanned(s, d)[1].select("path", "entry_path"), f"WITH {KNOWN} SELECT path, entry_path FROM w WHERE NOT whole"),
    "X20_same_time": (lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", snapshots.same_time(c("ts"), F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + c("event_id") % 3 * 500)).alias("same")), "SELECT event_id, event_id % 3 * 500 < 1000 AS same FROM events"),
    "S1_catalog_again": (lambda s, d: catalogs.catalog_items(round_trip(s, d), strict=True).select("set_name", "item_name", "size", "md5", "dump_status"), "SELECT set_name, item_name, size, md5, dump_status FROM fx_catalog"),
    "S5_catalog_names": (lambda s, d: catalogs.catalog_names(round_trip(s, d)), "SELECT DISTINCT lower(set_name) AS name_lc FROM fx_catalog"),
    "S8_zip_entries": (lambda s, d: inventories.fingerprints(inventories.zip_entries(packed(s, d), content=True).where("read_state = 'ok'"), hashes=("md5",)).select("path", "entry_name", "size", "md5", "comment"), f"WITH {ENTRIES} SELECT path, entry_name, length(entry_name) + 11 AS size, md5(concat('content of ', entry_name)) AS md5, CASE WHEN length(path) % 3 = 0 THEN 'note' END AS comment FROM e"),
    "S10_from_directory": (lambda s, d: inventories.from_directory(inventories.zip_entries(packed(s, d))).select("path", "entry_name", "size", (F.length("crc32") == 8).alias("stated")), f"WITH {ENTRIES} SELECT path, entry_name, length(entry_name) + 11 AS size, TRUE AS stated FROM e"),
    "S11_behind_headers": (lambda s, d: inventories.stripped_fingerprints(headed(s, d)).select("doc_id", "stripped.size", "stripped.md5", "stripped.sha1"), "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN strlen(text) END AS size, CASE WHEN doc_id % 3 < 2 THEN md5(text) END AS md5, CASE WHEN doc_id % 3 < 2 THEN sha1(text) END AS sha1 FROM documents"),
    "S15_cartridge_headers": (lambda s, d: cartridges(s, d).select("doc_id", headers.cartridge_header(c("hex")).alias("h")).select("doc_id", "h.mapper", "h.prg_kb", "h.chr_kb", "h.has_battery", "h.mirroring", "h.tv_system"), """SELECT doc_id, CAST(((doc_id * 11 % 256) & 240) | ((doc_id * 7 % 256) >> 4) AS INTEGER) AS mapper, CAST(doc_id * 3 % 256 * 16 AS INTEGER) AS prg_kb, CAST(doc_id * 5 % 256 * 8 AS INTEGER) AS chr_kb, (doc_id * 7 % 256) & 2 <> 0 AS has_battery,
      CASE WHEN (doc_id * 7 % 256) & 8 <> 0 THEN 'Four-screen' WHEN (doc_id * 7 % 256) & 1 <> 0 THEN 'Vertical' ELSE 'Horizontal' END AS mirroring, CASE WHEN (doc_id * 17 % 256) & 1 <> 0 THEN 'PAL' ELSE 'NTSC' END AS tv_system FROM documents"""),
    "S17_title_names": (written(lambda s, d, p: view(s, d, "fx_titles").select(F.to_json(F.create_map(F.coalesce(names.title_id(c("file_name")), F.lit("-")), F.regexp_replace("file_name", r" \[.*$", ""))).alias("value")).write.option("maxRecordsPerFile", 1000).text(p), catalogs.title_names), "SELECT regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1) AS id, regexp_replace(file_name, ' \\[.*$', '') AS name FROM fx_titles"),
    "S18_title_versions": (written(lambda s, d, p: view(s, d, "fx_titles").select(F.concat_ws("|", names.title_id(c("file_name")), F.lit("0"), F.when(c("size") % 70 != 0, (c("size") % 9 * 65536).cast("string")).otherwise("none")).alias("value")).write.text(p), catalogs.title_versions), "SELECT regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1) AS id, size % 9 * 65536 AS version FROM fx_titles WHERE size % 70 <> 0"),
    "I1_followed_snapshot": (followed_snapshot, f"""WITH {KNOWN}, h AS (SELECT path, bool_and(good) AS whole FROM k GROUP BY 1), a AS (SELECT k.path, k.entry_path, CASE WHEN whole THEN md5 ELSE md5(concat('new', CAST(size AS VARCHAR))) END AS md5, mtime FROM k JOIN h ON h.path = k.path)
      SELECT path, entry_path, md5 FROM (SELECT *, row_number() OVER (PARTITION BY path, entry_path ORDER BY mtime DESC, md5 DESC) AS r FROM (SELECT path, entry_path, md5, mtime FROM a UNION ALL SELECT path, entry_path, md5, mtime FROM fx_known WHERE md5 IS NOT NULL)) WHERE r = 1"""),
    "S19_report_of_a_system": (stored_report, "SELECT row_ord, status FROM fx_audit WHERE system_id = 3"),
    "F15_checksum_conflicts": (lambda s, d: inventories.checksum_conflicts(inventories.zip_entries(packed(s, d))), f"WITH {ENTRIES} SELECT path, entry_name FROM e WHERE length(entry_name) % 4 = 0"),
    "P15_corrupt_deleted": (lambda s, d: (lambda x: plan_cols(changes.corrupt_entries(x[2], inventories.checksum_conflicts(inventories.zip_entries(packed(s, d))), "delete")))(report(s, d)), f"WITH {CTES} SELECT 'remove_entry' AS op, concat(path, '::', entry_name) AS group_id, path AS source, entry_name AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM matches WHERE match_status = 'correct' AND path LIKE '%.zip' AND length(entry_name) % 4 = 0"),
    "P15_corrupt_moved": (lambda s, d: (lambda x: plan_cols(changes.corrupt_entries(x[2], inventories.checksum_conflicts(inventories.zip_entries(packed(s, d))), "quarantine", "/q", x[1])))(report(s, d)), f"WITH {CTES}, r AS (SELECT * FROM matches WHERE match_status = 'correct' AND path LIKE '%.zip' AND length(entry_name) % 4 = 0) SELECT 'remove_entry' AS op, concat(path, '::', entry_name) AS group_id, path AS source, entry_name AS source_entry, NULL AS target, NULL AS target_entry FROM r UNION ALL SELECT 'extract', concat(path, '::', entry_name), path, entry_name, concat('/q/', set_name, '_', entry_name), NULL FROM r"),
    "P17_remove_comments": (lambda s, d: (lambda x: plan_cols(changes.remove_comments(x[2], match.leftovers(x[2], x[1]), inventories.zip_entries(packed(s, d)))))(report(s, d)), f"WITH {CTES} SELECT DISTINCT 'clear_comment' AS op, path AS group_id, path AS source, {NULLS} AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM (SELECT path FROM matches WHERE match_status IN ('correct', 'misnamed') UNION ALL SELECT path FROM rest) WHERE path LIKE '%.zip' AND length(path) % 3 = 0"),
    "J25_serials": (serials, """WITH l AS (SELECT path, entry_name, concat('S', CAST(size % 300 AS VARCHAR)) AS serial, size % 2 AS k FROM fx_inventory), s AS (SELECT set_name, concat('S', CAST(set_ord % 300 AS VARCHAR)) AS serial, set_ord % 2 AS k FROM fx_sets),
      m AS (SELECT l.path, l.entry_name, s.set_name, l.k = s.k AS sized FROM l JOIN s ON s.serial = l.serial), w AS (SELECT *, bool_or(sized) OVER (PARTITION BY path, entry_name) AS any_sized FROM m) SELECT path, entry_name, min(set_name) AS set_name FROM w WHERE sized OR NOT any_sized GROUP BY 1, 2 HAVING count(*) = 1"""),
    "K1_stored_diff": (stored_diff, "SELECT key, status FROM fx_next WHERE key % 7 <> 5"),
    "K3_fix_catalog": (written(lambda s, d, p: (lambda i: catalogs.fix_catalog(i.select("set_name", "item_name", F.when(c("size") % 3 == 0, "missing").otherwise("correct").alias("status")), i, p))(view(s, d, "fx_catalog")), lambda s, p: catalogs.catalog_items(catalogs.read_sets(s, p, "datafile")).select("set_name", "item_name", "size", "md5", "dump_status")), "SELECT set_name, item_name, size, md5, dump_status FROM fx_catalog WHERE size % 3 = 0"),
    "K6_sets_as_csv": (written(lambda s, d, p: stores.export_csv(view(s, d, "fx_sets").select("set_name", "description"), p), lambda s, p: s.read.option("header", True).schema("set_name string, description string").csv(p)), "SELECT set_name, description FROM fx_sets"),
    "K7_stored_catalog": (stored_catalog, "SELECT set_name, item_name, md5 FROM fx_catalog"),
    "K8_stored_inventory": (written(lambda s, d, p: stores.save_inventory(view(s, d, "fx_inventory").withColumn("read_state", F.when(c("size") % 4 == 0, "corrupt").otherwise("ok")), p), lambda s, p: s.read.parquet(p).select("path", "entry_name", "md5")), "SELECT path, entry_name, md5 FROM fx_inventory WHERE size % 4 <> 0"),
    "K9_notes": (written(lambda s, d, p: stores.save_notes(view(s, d, "fx_sets").select(c("set_name").alias("family"), "year"), p), lambda s, p: s.read.schema("family string, year string").json(p)), "SELECT set_name AS family, year FROM fx_sets"),
    "P7_remove_disks": (redundant_with_disks, f"""WITH {CTES},\n{REDUNDANT}, {DISKS} SELECT 'remove_container' AS op, path AS group_id, path AS source, {NULLS} AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM rc
      UNION ALL SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'remove' ELSE 'remove_entry' END, path, path, CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN NULL ELSE entry_name END, NULL, NULL FROM flagged WHERE redundant AND path NOT IN (SELECT path FROM rc)
      UNION ALL SELECT 'remove_disk', path, path, NULL, NULL, NULL FROM fx_disk_files WHERE path NOT IN (SELECT path FROM m WHERE path IS NOT NULL) AND sha1 IN (SELECT sha1 FROM fx_disks WHERE sha1 IS NOT NULL)"""),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
