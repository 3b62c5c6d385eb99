"""Queries of disks, near names, duplicates, donors, titles, snapshots, fingerprints and plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view, with_views
from .operators import disks, duplicates, match, snapshots, suggest, titles
from .plans import changes
from .queries_match import CTES, KEY, left, owned, report

DISKS = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disk_name ORDER BY sha1 IS NULL, ord) AS r FROM fx_disks) WHERE r = 1),
  m AS (SELECT d.disk_name, d.set_name, CASE WHEN h.p IS NOT NULL THEN 'correct' WHEN s.p IS NOT NULL AND d.sha1 IS NULL THEN 'unverifiable' WHEN s.p IS NOT NULL THEN 'incorrect' ELSE 'missing' END AS status, coalesce(h.p, s.p) AS path
  FROM d LEFT JOIN (SELECT d.disk_name, arg_min(path, (lower(split_part(path, '/', -2)) = lower(d.disk_name), path)) AS p FROM d JOIN fx_disk_files f ON f.sha1 = d.sha1 GROUP BY 1) h ON h.disk_name = d.disk_name LEFT JOIN (SELECT stem, min(path) AS p FROM fx_disk_files GROUP BY 1) s ON s.stem = d.disk_name)"""
SUBFOLDER = "lower(split_part(path, '/', -2)) = lower(d.disk_name)"
LEV = "(1 - levenshtein(lower({a}), lower({b}))::DOUBLE / greatest(length({a}), length({b})))"
NEAR = f"""a AS (SELECT local_name, size, trim(regexp_replace(local_name, '\\.[^. ]*$', '')) AS a FROM fx_name_local),
  p AS (SELECT local_name, set_name, a, set_name AS b, trim(split_part(a, ' (', 1)) AS ta, trim(split_part(set_name, ' (', 1)) AS tb FROM a JOIN fx_name_catalog c ON c.size BETWEEN a.size - 512 AND a.size + 512),
  s AS (SELECT local_name, set_name, greatest({LEV.format(a='a', b='b')}, 0.9 * {LEV.format(a='ta', b='tb')} + 0.1) AS score FROM p),
  near AS (SELECT * FROM s WHERE score >= 0.75 - 1e-12)"""
CATALOG, FILES = "fx_catalog", "fx_inventory"


def diff_rows(spark, d):
    return snapshots.diff(view(spark, d, "fx_prev"), view(spark, d, "fx_next"), ["key"]).select("key", "action", F.col("old.status").alias("old_status"), F.col("new.status").alias("new_status"))


def wanted(spark, d):
    items, files, matches = report(spark, d)
    return matches.where("match_status IN ('missing', 'hashMismatch', 'foundElsewhere')").select(*KEY).join(items, list(KEY)), files, matches


def known_versions(spark, d):
    """A title table that knows an update for each base of a file, of a version made from its size."""
    own = titles.title_files(view(spark, d, "fx_titles")).where("tid IS NOT NULL").join(view(spark, d, "fx_titles").select("file_name", "size"), "file_name")
    return own.select(F.concat(F.substring("base_id", 1, 13), F.lit("800")).alias("id"), (F.col("size") % 9 * 65536).alias("version"))


def near_renames(spark, d):
    """Files of a near name, of 0.9 or more, take their set's name."""
    files = view(spark, d, "fx_name_local").select(F.concat(F.lit("/n/"), "local_name").alias("path"), F.col("local_name").alias("entry_name"), "local_name").distinct()
    near = suggest.best_name(suggest.near_names(view(spark, d, "fx_name_local"), view(spark, d, "fx_name_catalog"))).join(files, "local_name").select("path", "set_name", "score")
    items, _, matches = report(spark, d)
    none = matches.where("match_status = 'unknown'")
    return changes.rename_files(none, items, none.select("path", F.col("set_name").alias("suggested")), files, near).select("op", "source", "target")


DONORS = "dn AS (SELECT m.uid, min(f.path) AS donor_path, arg_min(f.entry_name, f.path) AS donor_entry FROM matches m JOIN cat c ON c.uid = m.uid JOIN f ON f.size = c.size AND f.md5 = c.md5 WHERE m.match_status IN ('missing', 'hashMismatch', 'foundElsewhere') GROUP BY 1)"
ANCHOR = "an AS (SELECT set_name, arg_min(path, uid) AS anchor FROM matches WHERE match_status IN ('correct', 'misnamed') GROUP BY 1)"


def plan_cols(df):
    return df.select("op", "group_id", "source", "source_entry", "target", "target_entry")


def suggested(spark, d):
    x = owned(spark, d)
    return match.misnamed_containers(x[3], x[0], x[2]), x


#: A container's set by what its leftovers are; a name that is a set's own stays, but for a container of nothing of that set, and a set of one item that has no file.
SUGGESTED = """sg AS (SELECT path, min(y.set_name) AS suggested FROM (SELECT path, stem_lc, owner, count(*) AS n FROM owned o JOIN n ON n.set_lc = lower(o.owner) WHERE n.n_items = 1 OR regexp_extract(path, '[^/]*$') <> entry_name GROUP BY 1, 2, 3) x
  JOIN (SELECT set_name, count(*) AS n_items FROM cat GROUP BY 1) y ON y.set_name = x.owner WHERE x.n * 5 >= n_items * 3 GROUP BY path, stem_lc
  HAVING count(*) = 1 AND (stem_lc NOT IN (SELECT set_lc FROM n) OR (min(n_items) = 1 AND lower(min(y.set_name)) <> stem_lc AND lower(min(y.set_name)) NOT IN (SELECT lower(set_name) FROM matches WHERE match_status IN ('correct', 'misnamed')) AND (stem_lc, path) NOT IN (SELECT (lower(set_name), path) FROM matches WHERE match_status IN ('correct', 'misnamed')))))"""
NULLS = "CAST(NULL AS VARCHAR)"
REDUNDANT = """rc AS (SELECT f.path FROM f LEFT JOIN flagged g ON g.path = f.path AND g.entry_name = f.entry_name GROUP BY 1 HAVING bool_and(coalesce(g.redundant, FALSE)))"""
TID = "regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1)"
TITLES = f"""t AS (SELECT file_name, {TID} AS tid, CAST(regexp_extract(file_name, '\\[v([0-9]+)\\]', 1) AS BIGINT) AS version FROM fx_titles),
  k AS (SELECT *, CASE right(tid, 3) WHEN '000' THEN 0 WHEN '800' THEN 1 ELSE 2 END AS rank, CASE WHEN right(tid, 3) IN ('000', '800') THEN concat(substr(tid, 1, 13), '000') ELSE lpad(upper(to_hex((CAST('0x' || tid AS BIGINT) - 4096) // 4096 * 4096)), 16, '0') END AS base_id FROM t WHERE tid <> '')"""

QUERIES = {
    "J19_misnamed_containers": (lambda s, d: suggested(s, d)[0], f"WITH {CTES},\n{SUGGESTED} SELECT path, suggested FROM sg"),
    "J23_disk_match": (lambda s, d: disks.match_disks(view(s, d, "fx_disks"), view(s, d, "fx_disk_files")), f"WITH {DISKS} SELECT disk_name, set_name, status, path FROM m"),
    "J23_disks_in_subfolders": (lambda s, d: disks.match_disks(view(s, d, "fx_disks"), view(s, d, "fx_disk_files"), prefer_subfolder=True), f"WITH {DISKS.replace(SUBFOLDER, SUBFOLDER.replace('=', '<>'))} SELECT disk_name, set_name, status, path FROM m"),
    "J24_disk_leftovers": (lambda s, d: disks.leftover_disks(view(s, d, "fx_disks"), view(s, d, "fx_disk_files")), f"WITH {DISKS} SELECT f.path, o.owner, o.owner IS NOT NULL AS redundant FROM fx_disk_files f LEFT JOIN (SELECT sha1, arg_min(set_name, ord) AS owner FROM fx_disks WHERE sha1 IS NOT NULL GROUP BY 1) o ON o.sha1 = f.sha1 WHERE f.path NOT IN (SELECT path FROM m WHERE path IS NOT NULL)"),
    "J26_near_names": (lambda s, d: suggest.near_names(view(s, d, "fx_name_local"), view(s, d, "fx_name_catalog")).withColumn("score", F.round("score", 6)), f"WITH {NEAR} SELECT local_name, set_name, round(score, 6) AS score FROM near"),
    "W6_best_name": (lambda s, d: suggest.best_name(suggest.near_names(view(s, d, "fx_name_local"), view(s, d, "fx_name_catalog"))).select("local_name", "set_name"), f"WITH {NEAR} SELECT local_name, set_name FROM (SELECT *, row_number() OVER (PARTITION BY local_name ORDER BY round(score, 9) DESC, length(set_name), set_name) AS r FROM near) WHERE r = 1"),
    "J32_duplicate_sets": (lambda s, d: duplicates.duplicate_sets(view(s, d, FILES), view(s, d, "fx_roots")), """WITH p AS (SELECT i.path, arg_max(r.root, length(r.root)) AS root, arg_max(r.root_ord, length(r.root)) AS root_ord, lower(regexp_replace(regexp_extract(i.path, '[^/]*$'), '\\.[^.]*$', '')) AS set_lc FROM (SELECT DISTINCT path FROM fx_inventory) i JOIN fx_roots r ON starts_with(i.path, concat(r.root, '/')) GROUP BY i.path),
      o AS (SELECT set_lc, root, root_ord, min(path) AS path FROM p GROUP BY 1, 2, 3) SELECT set_lc, root, path, primary_root FROM (SELECT *, row_number() OVER w AS k, first_value(root) OVER w AS primary_root FROM o WINDOW w AS (PARTITION BY set_lc ORDER BY root_ord)) WHERE k > 1"""),
    "F6_root_of_path": (lambda s, d: duplicates.root_of(view(s, d, FILES).select("path", "entry_name"), view(s, d, "fx_roots")).select("path", "entry_name", "root"), "SELECT i.path, i.entry_name, arg_max(r.root, length(r.root)) AS root FROM fx_inventory i LEFT JOIN fx_roots r ON starts_with(i.path, concat(r.root, '/')) GROUP BY 1, 2"),
    "J27_donors": (lambda s, d: (lambda x: duplicates.donors(x[0], x[1]))(wanted(s, d)), f"WITH {CTES},\n{DONORS}\nSELECT c.set_ord, c.item_ord, donor_path, donor_entry FROM dn JOIN cat c ON c.uid = dn.uid"),
    "J29_sibling_donors": (lambda s, d: duplicates.sibling_donors(view(s, d, CATALOG), view(s, d, "fx_sets")), """WITH o AS (SELECT c.*, coalesce(s.clone_of, s.set_name) AS family FROM fx_catalog c JOIN fx_sets s ON s.set_name = c.set_name WHERE md5 IS NOT NULL),
      p AS (SELECT a.set_ord, a.item_ord, min(b.set_ord * 16 + b.item_ord) AS sib FROM o a JOIN o b ON a.family = b.family AND a.size = b.size AND a.md5 = b.md5 AND a.set_name <> b.set_name GROUP BY 1, 2) SELECT set_ord, item_ord, CAST(sib // 16 AS BIGINT) AS sibling_set, CAST(sib % 16 AS BIGINT) AS sibling_item FROM p"""),
    "J30_parent_has": (lambda s, d: duplicates.parent_has(view(s, d, CATALOG), view(s, d, "fx_sets")), "SELECT c.set_ord, c.item_ord FROM fx_catalog c JOIN fx_sets s ON s.set_name = c.set_name WHERE EXISTS (SELECT 1 FROM fx_catalog p WHERE p.set_name = s.clone_of AND p.size = c.size AND p.md5 = c.md5)"),
    "K1_report_diff": (diff_rows, "SELECT coalesce(p.key, n.key) AS key, CASE WHEN p.key IS NULL THEN 'insert' WHEN n.key IS NULL THEN 'delete' WHEN p.status IS NOT DISTINCT FROM n.status THEN 'same' ELSE 'update' END AS action, p.status AS old_status, n.status AS new_status FROM fx_prev p FULL JOIN fx_next n ON n.key = p.key"),
    "K2_remove_prefix": (lambda s, d: snapshots.remove(view(s, d, "fx_audit"), prefix="/r1").select("system_id", "row_ord"), "SELECT system_id, row_ord FROM fx_audit WHERE path IS NULL OR NOT (path = '/r1' OR starts_with(path, '/r1/') OR starts_with(path, '/r1::'))"),
    "I3_carry_over": (lambda s, d: (lambda v: snapshots.carry_over(v.where("path LIKE '/r0/%' AND size % 2 = 0"), v, ["/r0"]).select("path", "entry_name", "md5"))(view(s, d, FILES)), "SELECT path, entry_name, md5 FROM fx_inventory WHERE NOT starts_with(path, '/r0/') OR size % 2 = 0"),
    "S9_fingerprints": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1")), "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1 FROM documents"),
    "A17_title_sets": (lambda s, d: titles.title_sets(view(s, d, "fx_titles")), f"""WITH {TITLES}, g AS (SELECT base_id, arg_min(file_name, (rank, file_name)) AS lead, string_agg(file_name, '|' ORDER BY rank, file_name) AS members FROM k GROUP BY 1), n AS (SELECT *, trim(split_part(lead, '[', 1)) AS nm FROM g)
      SELECT base_id, CASE WHEN row_number() OVER (PARTITION BY lower(nm) ORDER BY base_id) > 1 THEN concat(nm, ' [', base_id, ']') ELSE nm END AS set_name, members FROM n"""),
    "A17_generated_items": (lambda s, d: titles.title_items(view(s, d, "fx_titles"), known_versions(s, d)), f"""WITH {TITLES}, g AS (SELECT base_id, arg_min(file_name, (rank, file_name)) AS lead FROM k GROUP BY 1), n AS (SELECT *, trim(split_part(lead, '[', 1)) AS nm FROM g), s AS (SELECT base_id, CASE WHEN row_number() OVER (PARTITION BY lower(nm) ORDER BY base_id) > 1 THEN concat(nm, ' [', base_id, ']') ELSE nm END AS set_name FROM n),
      v AS (SELECT concat(substr(base_id, 1, 13), '800') AS id, base_id, max(size % 9 * 65536) AS newest FROM k JOIN fx_titles USING (file_name) GROUP BY 1, 2), h AS (SELECT base_id, max(version) AS held FROM k WHERE rank = 1 GROUP BY 1)
      SELECT s.base_id, set_name, file_name AS item_name, size, FALSE AS expected FROM s JOIN k ON k.base_id = s.base_id JOIN fx_titles USING (file_name)
      UNION ALL SELECT s.base_id, set_name, concat(set_name, ' [', id, '][v', CAST(newest AS VARCHAR), '].nsp'), 0, TRUE FROM s JOIN v ON v.base_id = s.base_id LEFT JOIN h ON h.base_id = s.base_id WHERE newest > 0 AND newest > coalesce(held, -1)"""),
    "A17_unidentified": (lambda s, d: titles.unidentified(view(s, d, "fx_titles").withColumn("file_name", F.when(F.col("size") % 130 == 0, F.replace("file_name", F.lit("[0100"), F.lit("[x"))).otherwise(F.col("file_name")))), "SELECT replace(file_name, '[0100', '[x') AS file_name FROM fx_titles WHERE size % 130 = 0"),
    "P1_near_names": (lambda s, d: near_renames(s, d), f"""WITH {NEAR}, b AS (SELECT *, row_number() OVER (PARTITION BY local_name ORDER BY round(score, 9) DESC, length(set_name), set_name) AS r FROM near), t AS (SELECT concat('/n/', local_name) AS source, concat('/n/', set_name, '.zip') AS target FROM b WHERE r = 1 AND score >= 0.9),
      u AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY source) AS k FROM t) SELECT 'rename' AS op, source, target FROM u WHERE k = 1 AND source <> target AND lower(target) NOT IN (SELECT lower(concat('/n/', local_name)) FROM fx_name_local)"""),
    "A22_title_summary": (lambda s, d: titles.title_summary(view(s, d, "fx_titles")), f"WITH {TITLES} SELECT base_id, bool_or(rank = 0) AS has_base, max(CASE WHEN rank = 1 THEN version END) AS newest_update, count(*) FILTER (WHERE rank = 2) AS extras FROM k GROUP BY 1"),
    "P1_rename_containers": (lambda s, d: (lambda x: plan_cols(changes.rename_containers(x[0], x[1][1])))(suggested(s, d)), f"""WITH {CTES},\n{SUGGESTED}, t AS (SELECT path, regexp_replace(path, '[^/]*$', '') || suggested || '.zip' AS target FROM sg), q AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY path) AS r FROM t WHERE lower(target) NOT IN (SELECT lower(path) FROM fx_inventory))
      SELECT 'rename' AS op, path AS group_id, path AS source, {NULLS} AS source_entry, target, {NULLS} AS target_entry FROM q WHERE r = 1"""),
    "P2_rename_outcomes": (lambda s, d: (lambda x: changes.rename_outcomes(x[0], x[1][1]))(suggested(s, d)), f"""WITH {CTES},\n{SUGGESTED} SELECT i.path, CASE WHEN suggested IS NULL THEN 'none' WHEN t = i.path THEN 'already correct' WHEN lower(t) IN (SELECT lower(path) FROM fx_inventory) THEN 'collides' ELSE 'rename' END AS outcome
      FROM (SELECT DISTINCT path FROM fx_inventory) i LEFT JOIN (SELECT *, regexp_replace(path, '[^/]*$', '') || suggested || '.zip' AS t FROM sg) x ON x.path = i.path"""),
    "P3_rename_entries": (lambda s, d: (lambda x: plan_cols(changes.rename_entries(x[2], x[3], x[0])))(left(s, d)), f"""WITH {CTES}, r AS (SELECT path, entry_name, item_name FROM matches WHERE match_status = 'misnamed' AND regexp_extract(path, '[^/]*$') <> entry_name
      UNION SELECT g.path, g.entry_name, c.item_name FROM flagged g JOIN (SELECT set_name, md5, arg_min(item_name, uid) AS item_name FROM cat WHERE md5 IS NOT NULL GROUP BY 1, 2) c ON c.set_name = g.owner AND c.md5 = g.md5 WHERE regexp_extract(path, '[^/]*$') <> entry_name AND c.item_name <> g.entry_name) SELECT 'add_entry' AS op, concat(path, '::', entry_name) AS group_id, path AS source, entry_name AS source_entry, path AS target, item_name AS target_entry FROM r
      UNION ALL SELECT 'remove_entry', concat(path, '::', entry_name), path, entry_name, NULL, NULL FROM r"""),
    "P4_rebuild_folder": (lambda s, d: plan_cols((lambda x: changes.rebuild_to_folder(x[2], "/out", x[1]))(report(s, d))), f"WITH {CTES} SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'copy' ELSE 'extract' END AS op, set_name AS group_id, path AS source, CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN NULL ELSE entry_name END AS source_entry, concat('/out/', set_name, '/', item_name) AS target, {NULLS} AS target_entry FROM matches WHERE match_status IN ('correct', 'misnamed')"),
    "P5_rebuild_containers": (lambda s, d: changes.rebuild_containers(report(s, d)[2], "/out"), f"WITH {CTES} SELECT set_name, concat('/out/', set_name, '.zip') AS target, string_agg(concat(path, '::', entry_name, '>', item_name), '|' ORDER BY uid) AS entries FROM matches WHERE match_status IN ('correct', 'misnamed') GROUP BY set_name"),
    "P7_remove_redundant": (lambda s, d: (lambda x: plan_cols(changes.remove_redundant(x[3], match.redundant_containers(x[3], x[1]))))(left(s, d)), f"""WITH {CTES},\n{REDUNDANT} SELECT 'remove_container' AS op, path AS group_id, path AS source, {NULLS} AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM rc
      UNION ALL SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'remove' ELSE 'remove_entry' END, path, path, CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN NULL ELSE entry_name END, NULL, NULL FROM flagged WHERE redundant AND path NOT IN (SELECT path FROM rc)"""),
    "P6_remove_useless": (lambda s, d: (lambda x: plan_cols(changes.remove_useless(x[3], x[1], match.emptied_containers(x[3], x[1]))))(left(s, d)), f"""WITH {CTES}, em AS (SELECT f.path FROM f LEFT JOIN flagged g ON g.path = f.path AND g.entry_name = f.entry_name WHERE f.in_container GROUP BY 1 HAVING bool_and(g.path IS NOT NULL AND g.owner IS NULL AND NOT g.nodump_name))
      SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'remove' ELSE 'remove_entry' END AS op, path AS group_id, path AS source, CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN NULL ELSE entry_name END AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM flagged WHERE owner IS NULL AND NOT nodump_name AND path NOT IN (SELECT path FROM em)"""),
    "P9_repair_missing": (lambda s, d: (lambda x: plan_cols(changes.repair(x[2], duplicates.donors(x[0], x[1]), "fill", ("missing", "foundElsewhere"), x[1])))(wanted(s, d)), f"WITH {CTES},\n{DONORS},\n{ANCHOR} SELECT 'fill' AS op, m.set_name AS group_id, donor_path AS source, donor_entry AS source_entry, anchor AS target, item_name AS target_entry FROM matches m JOIN dn ON dn.uid = m.uid JOIN an ON an.set_name = m.set_name WHERE m.match_status IN ('missing', 'foundElsewhere')"),
    "P10_replace_corrupt": (lambda s, d: (lambda x: plan_cols(changes.repair(x[2], duplicates.donors(x[0], x[1]), "replace", ("hashMismatch",), x[1])))(wanted(s, d)), f"WITH {CTES},\n{DONORS},\n{ANCHOR} SELECT 'replace' AS op, m.set_name AS group_id, donor_path AS source, donor_entry AS source_entry, anchor AS target, item_name AS target_entry FROM matches m JOIN dn ON dn.uid = m.uid JOIN an ON an.set_name = m.set_name WHERE m.match_status = 'hashMismatch'"),
    "P11_consolidate": (lambda s, d: (lambda x: plan_cols(changes.consolidate(x[2], x[1])))(report(s, d)), f"WITH {CTES},\n{ANCHOR} SELECT 'copy_entry' AS op, m.set_name AS group_id, path AS source, entry_name AS source_entry, anchor AS target, item_name AS target_entry FROM matches m JOIN an ON an.set_name = m.set_name WHERE m.match_status = 'foundElsewhere'"),
    "P14_case_policy": (lambda s, d: plan_cols(changes.case_policy(report(s, d)[2], "upper")), f"WITH {CTES} SELECT 'rename_entry' AS op, path AS group_id, path AS source, entry_name AS source_entry, path AS target, concat(upper(regexp_replace(entry_name, '\\.[^.]*$', '')), '.txt') AS target_entry FROM matches WHERE match_status = 'correct'"),
    "P16_placeholders": (lambda s, d: (lambda x: plan_cols(changes.placeholders(x[0], x[2], "/out")))(report(s, d)), f"WITH {CTES} SELECT 'placeholder' AS op, set_name AS group_id, {NULLS} AS source, {NULLS} AS source_entry, concat('/out/', set_name, '/', item_name) AS target, {NULLS} AS target_entry FROM cat WHERE dump_status = 'nodump' AND uid NOT IN (SELECT uid FROM matches)"),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
