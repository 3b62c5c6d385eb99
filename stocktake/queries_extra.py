"""Queries of single functions, flags and smaller operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view, with_views
from .functions import names, paths
from .operators import audit, browse, disks, duplicates, families, match, suggest
from .plans import changes
from .queries_match import CTES, left, report, sql
from .queries_more import DISKS, DONORS, wanted

c = F.col
CAT = "fx_name_catalog"
STATUS = "CASE WHEN set_ord % 5 = 0 THEN 'missing' ELSE 'correct' END"


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def named(spark, d):
    """Documents as files whose name states a checksum, a wrong one for every fifth."""
    md5 = F.md5("text")
    stated = F.when(c("doc_id") % 5 == 0, F.lit("deadbeef")).otherwise(F.substring(md5, 1, 8))
    return documents(spark, d).select("doc_id", F.concat(F.lit("d"), c("doc_id").cast("string"), F.lit(" ["), F.upper(stated), F.lit("].txt")).alias("file_name"), F.substring(md5, 1, 8).alias("actual"))


def bases(spark, d):
    sets = view(spark, d, "fx_sets")
    needs = F.when(c("set_ord") % 50 == 3, F.lit("set1, set9"))
    return sets.select("set_name", F.when(c("set_ord") % 5 == 0, "missing").otherwise("correct").alias("status"), "is_bios", needs.alias("required_bios"))


def notes(spark, d):
    sets = view(spark, d, "fx_sets").where("set_ord % 8 = 0")
    return sets.select(names.base_title(c("description")).alias("family"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("array<string>").alias("alternate_titles"), F.lit("USA").alias("recommended_region"), F.lit(False).alias("is_override"), (c("set_ord") % 16 == 0).alias("disabled")).distinct()


def chosen(k, *texts):
    """One of the texts, by a row's size."""
    return F.get(F.array(*[F.lit(t) for t in texts]), (c("size") % k).cast("int"))


def tagged_names(spark, d):
    """Names with short region tags, of one region or several, behind an article, unknown, and full ones."""
    bare = F.regexp_replace("set_name", r" \(USA\)$", "")
    return view(spark, d, CAT).withColumn("tagged", F.concat(bare, chosen(6, " (U)", " (JU)", " The (E)", " (X)", " (JUE)", " (USA)")))


def special(spark, d):
    """Names of special releases, some of whose words the local name has as well."""
    name = F.concat("set_name", chosen(4, " (Beta 2) (Demo)", " (Proto)", "", " (Kiosk Demo)"))
    return view(spark, d, CAT).select("set_name", suggest.special_words(name, F.concat("set_name", chosen(3, " demo", "", " beta proto"))).alias("n"))


QUERIES = {
    "X5_aliases": (lambda s, d: tagged_names(s, d).select("set_name", F.array_join(names.aliases(c("tagged")), "|").alias("aliases")), """SELECT set_name, CASE size % 6 WHEN 0 THEN concat(b, ' (USA)') WHEN 1 THEN concat(b, ' (Japan, USA)|', b, ' (USA, Japan)') WHEN 2 THEN concat(b, ' The (Europe)|', b, ', The (Europe)')
      WHEN 4 THEN concat(b, ' (Japan, USA, Europe)|', b, ' (World)') ELSE '' END AS aliases FROM (SELECT *, replace(set_name, ' (USA)', '') AS b FROM fx_name_catalog)"""),
    "X6_variants": (lambda s, d: view(s, d, CAT).select("set_name", names.numeric_revision(F.concat("set_name", F.lit(" (Rev B)"))).alias("revised"), names.without_languages(F.concat("set_name", F.lit(" (En,Fr+De)"))).alias("bare")), "SELECT set_name, concat(set_name, ' (Rev 2)') AS revised, set_name AS bare FROM fx_name_catalog"),
    "X7_embedded_checksum": (lambda s, d: named(s, d).select("doc_id", names.embedded_checksum(c("file_name")).alias("stated")), "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'deadbeef' ELSE substr(md5(text), 1, 8) END AS stated FROM documents"),
    "F14_name_checksum_mismatch": (lambda s, d: named(s, d).where(names.embedded_checksum(c("file_name")) != c("actual")).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 AND substr(md5(text), 1, 8) <> 'deadbeef'"),
    "X9_special_words": (special, "SELECT set_name, CASE size % 4 WHEN 0 THEN CAST(size % 3 <> 2 AS INTEGER) + CAST(size % 3 <> 0 AS INTEGER) WHEN 1 THEN CAST(size % 3 <> 2 AS INTEGER) WHEN 3 THEN CAST(size % 3 <> 0 AS INTEGER) ELSE 0 END AS n FROM fx_name_catalog"),
    "X13_clean_name": (lambda s, d: view(s, d, CAT).select("set_name", names.clean_name(F.concat(F.lit("A™:  "), F.regexp_replace("set_name", " ", "/"), F.lit("?. "))).alias("clean")), "SELECT set_name, concat('A - ', replace(set_name, ' ', '-')) AS clean FROM fx_name_catalog"),
    "X14_case": (lambda s, d: view(s, d, "fx_catalog").select("item_name", paths.with_case(c("item_name"), "upper").alias("up")), "SELECT item_name, concat(upper(split_part(item_name, '.', 1)), '.txt') AS up FROM fx_catalog"),
    "X15_layout_extension": (lambda s, d: view(s, d, "fx_catalog").select("item_name", paths.keep_layout_extension(F.concat(F.lit("/r/"), "item_name", F.lit(".V64")), F.concat("item_name", F.lit(".z64"))).alias("kept")), "SELECT item_name, concat(item_name, '.v64') AS kept FROM fx_catalog"),
    "X19_display_name": (lambda s, d: view(s, d, "fx_inventory").select("path", paths.file_name(c("path")).alias("shown")).distinct(), "SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS shown FROM fx_inventory"),
    "X23_file_roles": (lambda s, d: view(s, d, "fx_inventory").select("path", "entry_name", *[v.alias(k) for k, v in paths.roles(c("path"), c("entry_name")).items()]), "SELECT path, entry_name, regexp_extract(path, '[^/]*$') <> entry_name AS in_container, path LIKE '%.zip' AS is_zip, regexp_extract(path, '[^/]*$') = entry_name AS is_loose, path LIKE '%.zip' AS rewritable FROM fx_inventory"),
    "F8_os_junk": (lambda s, d: view(s, d, "fx_inventory").withColumn("entry_name", F.when(c("size") % 3 == 0, F.concat(F.lit("._"), "entry_name")).otherwise(c("entry_name"))).where(paths.os_junk(c("entry_name"))).select("path", "entry_name"), "SELECT path, concat('._', entry_name) AS entry_name FROM fx_inventory WHERE size % 3 = 0"),
    "F9_size_comparable": (lambda s, d: view(s, d, "fx_inventory").withColumn("n", F.when(c("size") % 2 == 0, F.concat("entry_name", F.lit(".RVZ"))).otherwise(c("entry_name"))).where(paths.size_comparable(c("n"))).select("path", "entry_name"), "SELECT path, entry_name FROM fx_inventory WHERE size % 2 <> 0"),
    "F10_protected": (lambda s, d: view(s, d, "fx_inventory").withColumn("p", F.when(c("size") % 4 == 0, F.concat(F.lit("/r/Images/x/"), "entry_name")).when(c("size") % 4 == 1, F.concat(F.lit("/r/"), "entry_name", F.lit(".srm"))).otherwise(c("path"))).where(paths.protected(c("p"))).select("path", "entry_name"), "SELECT path, entry_name FROM fx_inventory WHERE size % 4 IN (0, 1)"),
    "F16_container_case": (lambda s, d: view(s, d, "fx_sets").withColumn("container", F.when(c("set_ord") % 3 == 0, F.upper("set_name")).otherwise(c("set_name"))).where(browse.case_mismatch(c("container"), c("set_name"))).select("set_name"), "SELECT set_name FROM fx_sets WHERE set_ord % 3 = 0"),
    "J28_donor_flag": (lambda s, d: (lambda w: duplicates.with_donor_flag(w[2].select("set_name", "set_ord", "item_ord", F.when(c("match_status") == "correct", "correct").otherwise("other").alias("status")), duplicates.donors(w[0], w[1])).select("set_ord", "item_ord", "donor_available"))(wanted(s, d)),
      f"WITH {CTES},\n{DONORS} SELECT set_ord, item_ord, match_status <> 'correct' AND uid IN (SELECT uid FROM dn) AND set_name IN (SELECT set_name FROM matches WHERE match_status = 'correct') AS donor_available FROM matches"),
    "J31_unused_bases": (lambda s, d: audit.unused_bases(bases(s, d)), f"SELECT set_name AS name FROM fx_sets WHERE is_bios AND {STATUS} <> 'missing' AND set_name NOT IN (SELECT unnest(['set1', 'set9']) FROM fx_sets WHERE set_ord % 50 = 3 AND {STATUS} <> 'missing')"),
    "J33_system_copies": (lambda s, d: (lambda x: duplicates.system_copies(x[3], match.to_audit(x[2], x[3], x[0])))(left(s, d)), sql("""SELECT path, min(owner) AS owner FROM flagged WHERE owner IN (SELECT set_name FROM aud WHERE set_name IS NOT NULL AND status <> 'missing') AND path NOT IN (SELECT path FROM aud WHERE set_name IS NOT NULL AND path IS NOT NULL) GROUP BY path""")),
    "J34_region_notes": (lambda s, d: families.notes_for(view(s, d, "fx_sets").select(c("description").alias("set_name")).distinct(), notes(s, d)).select("set_name", "recommended_region"), "SELECT DISTINCT a.description AS set_name, 'USA' AS recommended_region FROM fx_sets a JOIN fx_sets b ON trim(split_part(a.description, '(', 1)) = trim(split_part(b.description, '(', 1)) WHERE b.set_ord % 8 = 0 AND b.set_ord % 16 <> 0"),
    "U1_disks_in_report": (lambda s, d: audit.counters(disks.with_disks(view(s, d, "fx_audit"), disks.match_disks(view(s, d, "fx_disks"), view(s, d, "fx_disk_files")))).select("correct", "incorrect", "missing", "unverifiable"), f"""WITH {DISKS}, u AS (SELECT status FROM fx_audit UNION ALL SELECT status FROM m) SELECT count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable FROM u"""),
    "P21_restricted_plan": (lambda s, d: changes.restrict(changes.rename_entries(report(s, d)[2]), ["/r0"]).select("op", "group_id", "source", "source_entry"), f"""WITH {CTES}, r AS (SELECT * FROM matches WHERE match_status = 'misnamed' AND regexp_extract(path, '[^/]*$') <> entry_name AND starts_with(path, '/r0/')) SELECT op, concat(path, '::', entry_name) AS group_id, path AS source, entry_name AS source_entry FROM r, (VALUES ('add_entry'), ('remove_entry')) AS o(op)"""),
    "P22_preview": (lambda s, d: (lambda x: changes.preview(changes.rename_entries(x[2]), changes.rebuild_to_folder(x[2], "/out", x[1]), changes.consolidate(x[2], x[1])))(report(s, d)), f"""WITH {CTES}, r AS (SELECT * FROM matches WHERE match_status = 'misnamed'), k AS (SELECT * FROM matches WHERE match_status IN ('correct', 'misnamed'))
      SELECT 'add_entry' AS op, count(*) AS n, count(DISTINCT concat(path, '::', entry_name)) AS groups FROM r UNION ALL SELECT 'remove_entry', count(*), count(DISTINCT concat(path, '::', entry_name)) FROM r UNION ALL SELECT 'extract', count(*), count(DISTINCT set_name) FROM k
      UNION ALL SELECT 'copy_entry', count(*), count(DISTINCT set_name) FROM matches m WHERE match_status = 'foundElsewhere' AND set_name IN (SELECT set_name FROM k)"""),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
