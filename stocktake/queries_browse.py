"""Queries of the browser's columns, further plans and modes of the match, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view, with_views
from .operators import alternates, audit, browse, duplicates, families, match, snapshots
from .plans import changes
from .queries_audit import COUNTERS, on_sets
from .queries_match import CTES, KEY, audited, both, left, owned, report, sql
from .queries_more import ANCHOR, NULLS, SUGGESTED, plan_cols

c = F.col
COLUMNS = "op, group_id, source, source_entry, target, target_entry"
SQL_BASES = "SELECT c.set_name FROM (WITH RECURSIVE x(set_name, up) AS (SELECT set_name, rom_of FROM fx_sets WHERE rom_of IS NOT NULL UNION SELECT x.set_name, p.rom_of FROM x JOIN fx_sets p ON p.set_name = x.up WHERE p.rom_of IS NOT NULL) SELECT * FROM x) c JOIN fx_sets b ON b.set_name = c.up WHERE b.is_bios GROUP BY 1"
CATEGORIES = {
    "F2_all": ("allGames", "TRUE"), "F2_originals": ("originals", "clone_of IS NULL"), "F2_clones": ("clones", "clone_of IS NOT NULL"), "F2_base_sets": ("biosFiles", "is_bios"), "F2_disks": ("gamesWithCHD", "has_disk"),
    "F2_samples": ("gamesWithSamples", "has_samples"), "F2_components": ("gamesWithDeviceRefs", "trim(device_refs) <> ''"), "F2_component_sets": ("deviceMachines", "is_device"),
}
FLAGS = {"gamesWithCHD": "has_disk", "gamesWithSamples": "has_samples", "deviceMachines": "is_device"}

EXPLAINED = "required_by, satisfied, redundant, misnamed_for, elsewhere_name"
#: Leftovers' owners and what is found elsewhere, made up from the row's number; the rest of the audit is the view's.
AUDIT = """SELECT system_id, row_ord, set_name, status, is_disk, is_optional, path, CASE WHEN set_name IS NULL AND row_ord % 3 = 0 OR set_name IS NOT NULL AND status = 'incorrect' AND row_ord % 4 = 0 THEN concat('set', CAST(row_ord % 50 AS STRING)) END AS required_by,
  row_ord % 2 = 0 AS satisfied, row_ord % 5 = 0 AS redundant, CASE WHEN set_name IS NULL AND row_ord % 7 = 0 THEN concat('set', CAST(row_ord % 40 AS STRING)) END AS misnamed_for, CASE WHEN status = 'incorrect' AND row_ord % 6 = 1 THEN concat('set', CAST(row_ord % 30 AS STRING), '.zip') END AS elsewhere_name"""


def explained(spark, d):
    rows = spark.sql(f"{AUDIT} FROM {{a}}", a=view(spark, d, "fx_audit"))
    return rows.withColumn("status", F.when(c("set_name").isNull() & c("required_by").isNotNull(), "incorrect").otherwise(c("status")))


OWNED = "CASE WHEN w.satisfied THEN concat('Duplicated {what}, not needed here (required by ', w.required_by, ')') WHEN w.redundant THEN concat('Extra copy of unused content — ', w.required_by, ' still has no real copy') ELSE concat('Recognized content, but ', w.required_by, ' doesn''t have it either') END"
EXPLANATIONS = f"""WITH x AS (SELECT * REPLACE (CASE WHEN set_name IS NULL AND required_by IS NOT NULL THEN 'incorrect' ELSE status END AS status) FROM ({AUDIT} FROM fx_audit)),
s AS (SELECT set_name, is_disk, CASE WHEN bool_or(status = 'missing' AND NOT is_optional) THEN 'missing' WHEN bool_or(status = 'badDump') THEN 'badDump' WHEN bool_or(status = 'incorrect') THEN 'incorrect' WHEN bool_or(status = 'correct') THEN 'correct' WHEN bool_or(status = 'unverifiable') THEN 'unverifiable' ELSE 'correct' END AS status,
  arg_min({{'required_by': required_by, 'satisfied': satisfied, 'redundant': redundant}}, row_ord) FILTER (WHERE status = 'incorrect' AND required_by IS NOT NULL) AS w, bool_or(status = 'incorrect' AND required_by IS NULL) AS own_problem, count(DISTINCT elsewhere_name) AS places, min(elsewhere_name) AS place FROM x WHERE set_name IS NOT NULL GROUP BY 1, 2),
p AS (SELECT set_name, path FROM (SELECT *, sum(n) OVER (PARTITION BY set_name) AS total, row_number() OVER (PARTITION BY set_name ORDER BY n DESC, path) AS r FROM (SELECT set_name, path, count(*) AS n FROM x WHERE set_name IS NOT NULL AND path IS NOT NULL AND NOT is_disk AND required_by IS NULL AND elsewhere_name IS NULL GROUP BY 1, 2)) WHERE r = 1 AND n * 2 >= total),
t AS (SELECT s.*, regexp_extract(p.path, '[^/]*$') AS actual, concat(s.set_name, '.zip') AS expected FROM s LEFT JOIN p ON p.set_name = s.set_name),
l AS (SELECT path, arg_min(misnamed_for, row_ord) FILTER (WHERE misnamed_for IS NOT NULL) AS misnamed_for, arg_min({{'required_by': required_by, 'satisfied': satisfied, 'redundant': redundant}}, row_ord) FILTER (WHERE status = 'incorrect' AND required_by IS NOT NULL) AS w FROM x WHERE set_name IS NULL GROUP BY path)
SELECT concat(CASE WHEN is_disk THEN 'disk:' ELSE 'set:' END, set_name) AS node, CASE WHEN is_disk THEN CASE status WHEN 'missing' THEN 'Missing' WHEN 'incorrect' THEN 'Incorrect' WHEN 'badDump' THEN 'Bad' WHEN 'unverifiable' THEN 'Nodump (unverifiable)' ELSE 'Correct' END
  WHEN status = 'incorrect' THEN CASE WHEN actual <> expected THEN 'Bad file name' WHEN actual IS NULL AND places = 1 AND place <> expected THEN concat('Bad file name — rename ', place, ' to ', expected) WHEN own_problem OR w IS NULL THEN 'Rom need fix' ELSE {OWNED.format(what='file')} END
  WHEN status = 'missing' THEN 'Incomplete (rom missing)' WHEN status = 'badDump' THEN 'Bad (hash mismatch)' WHEN status = 'unverifiable' THEN 'Ok (contains a nodump rom)' ELSE 'Ok' END AS text FROM t
UNION ALL SELECT concat('path:', coalesce(path, '')), CASE WHEN misnamed_for IS NOT NULL THEN concat('Bad file name — rename to ', misnamed_for, '.zip') WHEN w IS NULL THEN 'Unknown game' ELSE {OWNED.format(what='archive')} END FROM l"""


def badges_text(badges):
    return F.array_join(F.transform(badges, lambda b: F.concat_ws("=", b["label"], b["tooltip"])), ";")


CPU = "list_filter({r}, lambda x: {no} list_contains([" + ", ".join(f"'{p}'" for p in browse.PROCESSORS) + "], lower(x)))"
REFS = "list_filter(list_transform(string_split(coalesce(device_refs, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
GUESSED, OTHER = CPU.format(r=REFS, no=""), CPU.format(r=REFS, no="NOT")


def organised(spark, d):
    x = left(spark, d)
    sets = view(spark, d, "fx_sets").where("is_bios OR set_ord % 9 = 2")
    return changes.organise(x[2], x[3], sets, "/bios", x[1]), sets


ORGANISED = f"""{CTES}, q AS (SELECT set_name, description FROM fx_sets WHERE is_bios OR set_ord % 9 = 2), mv AS (SELECT DISTINCT m.set_name, path FROM matches m JOIN q ON q.set_name = m.set_name WHERE match_status IN ('correct', 'misnamed', 'hashMismatch')),
og AS (SELECT 'move' AS op, set_name AS group_id, path AS source, {NULLS} AS source_entry, concat('/bios/', regexp_extract(path, '[^/]*$')) AS target, {NULLS} AS target_entry FROM mv
  UNION ALL SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'remove' ELSE 'remove_entry' END, owner, path, CASE WHEN regexp_extract(path, '[^/]*$') <> entry_name THEN entry_name END, NULL, NULL FROM flagged WHERE redundant AND owner IN (SELECT set_name FROM q))"""
#: What sets have matched, and what of it parents have.
MATCHED = "mc AS (SELECT m.uid, m.set_name, m.item_name, m.path, m.entry_name, c.size, c.md5, s.clone_of, coalesce(s.clone_of, s.set_name) AS family FROM matches m JOIN cat c ON c.uid = m.uid JOIN fx_sets s ON s.set_name = m.set_name WHERE match_status IN ('correct', 'misnamed')), ph AS (SELECT DISTINCT set_name AS clone_of, size, md5 FROM mc WHERE clone_of IS NULL AND md5 IS NOT NULL)"


def converted(f):
    return lambda s, d: (lambda x: plan_cols(f(x[2], x[0], view(s, d, "fx_sets"), x[3])))(left(s, d))


def as_missing(matches):
    return matches.withColumn("match_status", F.when(c("match_status") == "foundElsewhere", "missing").otherwise(c("match_status")))


def tagged(spark, d):
    """The catalog and the inventory under names with tags: a third of the containers by an alias, a third by a variant."""
    items, files = both(spark, d)
    n = F.regexp_extract("path", r"set([0-9]+)\.zip$", 1).try_cast("long") % 3
    tag = F.when(n == 0, " (U)").when(n == 1, " (USA) (En,Fr)").otherwise(" (USA)")
    return items.withColumn("set_name", F.concat("set_name", F.lit(" (USA)"))), files.withColumn("path", F.when(n.isNotNull(), F.concat(F.regexp_replace("path", r"\.zip$", ""), tag, F.lit(".zip"))).otherwise(c("path")))


TAG = "CASE CAST(regexp_extract(path, 'set([0-9]+)\\.zip$', 1) AS BIGINT) % 3 WHEN 0 THEN ' (U)' WHEN 1 THEN ' (USA) (En,Fr)' ELSE ' (USA)' END"
NAMED = "regexp_matches(path, 'set[0-9]+\\.zip$')"
KNOWN_SPELLING = f"CASE WHEN {NAMED} THEN concat(regexp_replace(path, '\\.zip$', ''), {TAG}, '.zip') ELSE path END"

QUERIES = {
    **{k: ((lambda s, d, name=name: browse.catalog_category(view(s, d, "fx_sets"), name).select("set_name")), f"SELECT set_name FROM fx_sets WHERE {test}") for k, (name, test) in CATEGORIES.items()},
    "F2_needs_base": (lambda s, d: (lambda x: browse.catalog_category(x, "gamesRequiringBIOS", families.base_ancestor(x)).select("set_name"))(view(s, d, "fx_sets")), SQL_BASES),
    **{f"F1c_{v}": (on_sets(lambda x, k=k: audit.category(x, k).select("set_name")), f"SELECT set_name FROM fx_sets WHERE {v}") for k, v in list(FLAGS.items())[:2]},
    "F1_all": (lambda s, d: audit.category(view(s, d, "fx_audit"), "allGames").select("system_id", "row_ord"), "SELECT system_id, row_ord FROM fx_audit"),
    "F1e_needs_base": (on_sets(lambda x: audit.category(x.withColumn("required_bios", F.when(c("set_ord") % 4 == 1, "set1")), "gamesRequiringBIOS").select("set_name")), "SELECT set_name FROM fx_sets WHERE set_ord % 4 = 1"),
    "F1e_components": (on_sets(lambda x: audit.category(x, "gamesWithDeviceRefs").select("set_name")), "SELECT set_name FROM fx_sets WHERE device_refs IS NOT NULL"),
    "F1g_component_sets": (on_sets(lambda x: audit.category(x, "deviceMachines").select("set_name")), "SELECT set_name FROM fx_sets WHERE is_device"),
    "F1g_name_checksums": (on_sets(lambda x: audit.category(x.withColumn("name_checksum_mismatch", c("set_ord") % 6 == 1), "filenameCRCMismatches").select("set_name")), "SELECT set_name FROM fx_sets WHERE set_ord % 6 = 1"),
    "F1g_container_checksums": (on_sets(lambda x: audit.category(x.withColumn("container_checksum_mismatch", c("set_ord") % 6 == 2), "zipCRCInconsistencies").select("set_name")), "SELECT set_name FROM fx_sets WHERE set_ord % 6 = 2"),
    "F1g_unused_bases": (on_sets(lambda x: audit.category(x.withColumn("orphaned_bios", c("is_bios")), "unusedBiosFiles").select("set_name")), "SELECT set_name FROM fx_sets WHERE is_bios"),
    "F13_available_updates": (lambda s, d: browse.available_updates(view(s, d, "fx_titles").select(c("file_name").alias("item_name"), F.when(c("size") % 3 == 0, "correct").otherwise("missing").alias("status"), (c("size") % 20).alias("expected_size"))), "SELECT count(*) AS n FROM fx_titles WHERE size % 3 <> 0 AND size % 20 = 0 AND regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1) LIKE '%800'"),
    "X16_explanations": (lambda s, d: browse.explanations(explained(s, d)), EXPLANATIONS),
    "X17_dependency_badges": (on_sets(lambda x: x.select("set_name", badges_text(browse.dependency_badges(c("rom_of"), c("disk_names"), c("device_refs"), c("cpu_chips"), c("audio_chips"), c("has_samples"))).alias("badges"))), f"""SELECT set_name, array_to_string(list_filter([CASE WHEN rom_of <> '' THEN concat('BIOS=', rom_of) END, CASE WHEN disk_names <> '' THEN concat('CHD=', CAST(len(string_split(disk_names, ',')) AS VARCHAR), CASE WHEN disk_names LIKE '%,%' THEN ' disks: ' ELSE ' disk: ' END, disk_names) END,
      CASE WHEN coalesce(device_refs, '') <> '' OR cpu_chips IS NOT NULL OR audio_chips IS NOT NULL THEN concat('Hardware=', concat_ws(chr(10), CASE WHEN cpu_chips IS NOT NULL THEN concat('CPU: ', cpu_chips) WHEN len({GUESSED}) > 0 THEN concat('CPU: ', array_to_string({GUESSED}, ', ')) END, CASE WHEN audio_chips IS NOT NULL THEN concat('Sound: ', audio_chips) END,
        CASE WHEN cpu_chips IS NOT NULL AND len({REFS}) > 0 THEN concat('Other: ', array_to_string({REFS}, ', ')) WHEN cpu_chips IS NULL AND len({OTHER}) > 0 THEN concat('Other: ', array_to_string({OTHER}, ', ')) END)) END, CASE WHEN has_samples THEN 'Samples=' END], lambda b: b IS NOT NULL), ';') AS badges FROM fx_sets"""),
    "X18_detail_badges": (on_sets(lambda x: x.select("set_name", badges_text(browse.detail_badges(c("driver_status"), c("display_type"), c("display_rotate"), c("players"), c("coins"))).alias("badges"))), """SELECT set_name, array_to_string(list_filter([CASE WHEN driver_status <> '' THEN concat('Emulation=MAME driver status: ', CASE WHEN driver_status = 'odd' THEN 'odd' ELSE concat(upper(driver_status[1]), substr(driver_status, 2)) END) END,
      CASE WHEN display_type IS NOT NULL OR display_rotate IN ('0', '90', '180', '270') THEN concat('Display=', concat_ws(chr(10), CASE WHEN display_rotate IN ('0', '180') THEN 'Orientation: Horizontal' WHEN display_rotate IN ('90', '270') THEN 'Orientation: Vertical' END, CASE WHEN display_type IS NOT NULL THEN concat('Type: ', upper(display_type[1]), substr(display_type, 2)) END)) END,
      CASE WHEN players IS NOT NULL OR coins IS NOT NULL THEN concat('Players=', concat_ws(chr(10), CASE WHEN players = '1' THEN '1 player' WHEN players IS NOT NULL THEN concat(players, ' players') END, CASE WHEN coins = '0' THEN 'Free Play (no coin mechanism)' WHEN coins = '1' THEN '1 coin slot' WHEN coins IS NOT NULL THEN concat(coins, ' coin slots') END)) END], lambda b: b IS NOT NULL), ';') AS badges FROM fx_sets"""),
    "X19_display_title": (on_sets(lambda x: x.select("set_name", browse.display_title(F.when(c("set_ord") % 5 == 0, "Game ID: WUP-P-X").when(c("set_ord") % 5 == 1, "").otherwise(c("description")), c("set_name")).alias("title"))), "SELECT set_name, CASE WHEN set_ord % 5 < 2 THEN set_name ELSE description END AS title FROM fx_sets"),
    "X22_attributes": (lambda s, d: browse.with_attributes(view(s, d, "fx_sets"), view(s, d, "fx_audit").withColumns({"year": F.when(c("row_ord") % 3 == 0, "").when(c("row_ord") % 3 == 1, c("row_ord").cast("string")), "manufacturer": F.lit(None).cast("string")}), ("year", "manufacturer")).select("set_name", "year", "manufacturer"),
      "SELECT s.set_name, coalesce(CAST((SELECT min(row_ord) FROM fx_audit a WHERE a.set_name = s.set_name AND row_ord % 3 = 1) AS VARCHAR), year) AS year, manufacturer FROM fx_sets s"),
    "A22_title_text": (lambda s, d: browse.title_texts(view(s, d, "fx_titles").select("file_name", (c("size") % 30 != 0).alias("present"))), """WITH t AS (SELECT size % 30 <> 0 AS present, regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1) AS tid, CAST(regexp_extract(file_name, '\\[v([0-9]+)\\]', 1) AS BIGINT) AS v FROM fx_titles),
      k AS (SELECT *, CASE WHEN right(tid, 3) IN ('000', '800') THEN concat(substr(tid, 1, 13), '000') ELSE lpad(upper(to_hex((CAST('0x' || tid AS BIGINT) - 4096) // 4096 * 4096)), 16, '0') END AS base_id FROM t),
      g AS (SELECT base_id, max(v) FILTER (WHERE tid LIKE '%800' AND present) AS have, max(v) FILTER (WHERE tid LIKE '%800' AND NOT present) AS lacks, count(*) FILTER (WHERE right(tid, 3) NOT IN ('000', '800') AND present) AS extras FROM k GROUP BY 1),
      n AS (SELECT *, CASE WHEN have > 0 THEN CAST(have // 65536 AS VARCHAR) ELSE 'v0' END AS h, CASE WHEN lacks > 0 THEN CAST(lacks // 65536 AS VARCHAR) ELSE 'v0' END AS m FROM g)
      SELECT base_id, nullif(concat_ws(' · ', CASE WHEN lacks IS NOT NULL THEN concat('Update ', m, ' available (', CASE WHEN have IS NULL THEN 'none installed' ELSE concat('have ', h) END, ')') WHEN have > 0 THEN concat('Update ', h) WHEN have = 0 THEN 'Update' END, CASE WHEN extras > 0 THEN concat(CAST(extras AS VARCHAR), ' DLC') END), '') AS text FROM n"""),
    "T1_first_nodes": (lambda s, d: browse.nodes_in_order(audit.nodes(view(s, d, "fx_audit"))).select("node").limit(100), """WITH n AS (SELECT DISTINCT concat(CASE WHEN is_disk THEN 'disk:' ELSE 'set:' END, set_name) AS node FROM (SELECT set_name, is_disk, bool_and(status = 'missing') AS gone FROM fx_audit WHERE set_name IS NOT NULL GROUP BY 1, 2) s WHERE is_disk OR NOT gone OR set_name NOT IN (SELECT set_name FROM fx_audit WHERE is_disk AND set_name IS NOT NULL)
      UNION SELECT DISTINCT concat('path:', coalesce(path, '')) FROM fx_audit WHERE set_name IS NULL) SELECT node FROM n ORDER BY lower(regexp_extract(regexp_replace(node, '^(set|disk|path):', ''), '[^/]*$')), node LIMIT 100"""),
    "T5_first_rows_of_a_plan": (lambda s, d: plan_cols(changes.in_order((lambda x: changes.rebuild_to_folder(x[2], "/out", x[1]))(report(s, d)))).select("source", "source_entry", "target").limit(100), sql("SELECT path AS source, entry_name AS source_entry, concat('/out/', set_name, '/', item_name) AS target FROM matches WHERE match_status IN ('correct', 'misnamed') ORDER BY set_name, path, entry_name, target LIMIT 100")),
    "U2_duplicate_rows": (lambda s, d: (lambda f: audit.counters(duplicates.with_duplicates(audited(s, d), duplicates.duplicate_sets(f, view(s, d, "fx_roots")))).select("correct", "missing", "duplicate"))(view(s, d, "fx_inventory")), sql("""SELECT count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'missing') AS missing, (SELECT count(*) FROM (SELECT set_lc, root, row_number() OVER (PARTITION BY set_lc ORDER BY root_ord) AS k FROM (SELECT DISTINCT stem_lc AS set_lc, root, root_ord FROM
      (SELECT f.stem_lc, f.path, arg_max(r.root, length(r.root)) AS root, arg_max(r.root_ord, length(r.root)) AS root_ord FROM f JOIN fx_roots r ON starts_with(f.path, concat(r.root, '/')) GROUP BY 1, 2))) WHERE k > 1 AND set_lc IN (SELECT set_lc FROM n)) AS duplicate FROM aud""")),
    "U9_any_shared_hash": (lambda s, d: view(s, d, "fx_catalog").join(view(s, d, "fx_inventory").select("path", "entry_name", c("md5").alias("f_md5")), c("item_name") == c("entry_name")).select(*KEY, "path", F.coalesce(duplicates.shares_hash(("md5",), "f_"), F.lit(False)).alias("shared")), "SELECT set_ord, item_ord, path, coalesce(c.md5 = f.md5, FALSE) AS shared FROM fx_catalog c JOIN fx_inventory f ON f.entry_name = c.item_name"),
    "I4_changed_rows": (lambda s, d: snapshots.changed_flag(view(s, d, "fx_prev"), view(s, d, "fx_next"), ["key"]), "SELECT n.key, n.status, NOT coalesce(p.status IS NOT DISTINCT FROM n.status AND p.key IS NOT NULL, FALSE) AS changed FROM fx_next n LEFT JOIN fx_prev p ON p.key = n.key"),
    "I5_recent_last": (lambda s, d: (lambda x: match.match_items(*x, recent=c("path").startswith("/r1/")).select(*KEY, "match_status", "path", "entry_name"))(both(s, d)), sql("SELECT set_ord, item_ord, match_status, path, entry_name FROM matches").replace("ORDER BY satisfied DESC, path)", "ORDER BY satisfied DESC, starts_with(path, '/r1/'), path)")),
    "J6_loose_mode": (lambda s, d: (lambda x: match.match_items(x[0], x[1].withColumn("path", F.concat(F.regexp_extract("path", "^(/r[0-9])", 1), F.lit("/loose/"), "entry_name")).dropDuplicates(["path"])).select(*KEY, "match_status", "path"))(both(s, d)), None),
    "J12_match_by_spellings": (lambda s, d: match.match_items(*tagged(s, d), spellings=True).select(*KEY, "match_status", "path", "entry_name"), sql(f"SELECT set_ord, item_ord, CASE WHEN match_status = 'correct' AND {NAMED} AND CAST(regexp_extract(path, 'set([0-9]+)\\.zip$', 1) AS BIGINT) % 3 = 1 THEN 'misnamed' ELSE match_status END AS match_status, {KNOWN_SPELLING} AS path, entry_name FROM matches")),
    "J10_match_by_names": (lambda s, d: (lambda x: match.match_items(*x, names_alone="name").where("match_status = 'correct'").select(*KEY))(both(s, d)), sql("SELECT DISTINCT set_ord, item_ord FROM pairs WHERE item_name = entry_name UNION SELECT set_ord, item_ord FROM matches WHERE match_status = 'correct'")),
    "J26_near_leftovers": (lambda s, d: (lambda x: match_near(s, d, x[3]))(left(s, d)), sql("SELECT path, regexp_replace(entry_name, '\\.txt$', '') AS set_name FROM flagged WHERE owner IS NULL AND NOT nodump_name AND regexp_extract(path, '[^/]*$') = entry_name")),
    "P1_rename_files": (lambda s, d: (lambda x: changes.rename_files(x[2], x[0], match.misnamed_containers(x[3], x[0], x[2]), x[1]).select("op", "source", "target"))(owned(s, d)), f"""WITH {CTES}, {SUGGESTED},
      t AS (SELECT path, regexp_replace(path, '[^/]*$', '') || suggested || '.zip' AS target FROM sg), q AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY path) AS r FROM t WHERE lower(target) NOT IN (SELECT lower(path) FROM fx_inventory)) SELECT 'rename' AS op, path AS source, target FROM q WHERE r = 1"""),
    "P8_cross_set_repair": (lambda s, d: (lambda x: plan_cols(changes.cross_set_repair(as_missing(x[2]), x[0], view(s, d, "fx_sets"), x[1])))(report(s, d)), f"""WITH {CTES}, {MATCHED}, {ANCHOR}, d AS (SELECT family, size, md5, arg_min({{'s': set_name, 'p': path, 'e': entry_name}}, uid) AS d FROM mc WHERE md5 IS NOT NULL GROUP BY 1, 2, 3) SELECT 'fill' AS op, m.set_name AS group_id, d.d.p AS source, d.d.e AS source_entry, an.anchor AS target, m.item_name AS target_entry
      FROM matches m JOIN cat c ON c.uid = m.uid JOIN fx_sets s ON s.set_name = m.set_name JOIN d ON d.family = coalesce(s.clone_of, s.set_name) AND d.size = c.size AND d.md5 = c.md5 JOIN an ON an.set_name = m.set_name WHERE m.match_status IN ('missing', 'foundElsewhere') AND d.d.s <> m.set_name"""),
    "P12_convert_to_split": (converted(lambda m, i, f, _: changes.convert_to_split(m, i, f)), f"WITH {CTES}, {MATCHED} SELECT 'remove_entry' AS op, set_name AS group_id, path AS source, entry_name AS source_entry, {NULLS} AS target, {NULLS} AS target_entry FROM mc WHERE clone_of IS NOT NULL AND path LIKE '%.zip' AND (clone_of, size, md5) IN (SELECT (clone_of, size, md5) FROM ph)"),
    "P13_convert_to_merged": (converted(changes.convert_to_merged), f"""WITH {CTES}, {MATCHED}, {ANCHOR}, e AS (SELECT s.set_name, s.clone_of, a.anchor, b.anchor AS into_ FROM fx_sets s JOIN an a ON a.set_name = s.set_name JOIN an b ON b.set_name = s.clone_of WHERE a.anchor LIKE '%.zip' AND b.anchor LIKE '%.zip' AND a.anchor <> b.anchor AND a.anchor NOT IN (SELECT path FROM rest) AND (s.set_name, a.anchor) NOT IN (SELECT (set_name, path) FROM matches WHERE match_status IN ('hashMismatch', 'nodump')))
      SELECT 'add_entry' AS op, m.set_name AS group_id, m.path AS source, m.entry_name AS source_entry, e.into_ AS target, m.item_name AS target_entry FROM mc m JOIN e ON e.set_name = m.set_name WHERE m.path = e.anchor AND (m.md5 IS NULL OR (m.clone_of, m.size, m.md5) NOT IN (SELECT (clone_of, size, md5) FROM ph)) UNION ALL SELECT 'remove_container', set_name, anchor, NULL, NULL, NULL FROM e"""),
    "P18_collect_samples": (lambda s, d: plan_cols(changes.collect_samples(alternates.sample_containers(view(s, d, "fx_sets").select("set_name", c("clone_of").alias("sample_of")), view(s, d, "fx_inventory")), "/samples", view(s, d, "fx_inventory"))), f"SELECT 'copy' AS op, n.s AS group_id, min(path) AS source, {NULLS} AS source_entry, concat('/samples/', n.s, '.zip') AS target, {NULLS} AS target_entry FROM (SELECT DISTINCT coalesce(clone_of, set_name) AS s FROM fx_sets) n JOIN fx_inventory i ON i.path LIKE '%.zip' AND lower(regexp_extract(i.path, '([^/]*)\\.zip$', 1)) = lower(n.s) GROUP BY n.s"),
    "P19_organise": (lambda s, d: plan_cols(organised(s, d)[0]), f"WITH {ORGANISED} SELECT * FROM og"),
    "A19_organise_preview": (lambda s, d: changes.organise_preview(*organised(s, d)), f"""WITH {ORGANISED}, g AS (SELECT group_id, count(*) FILTER (WHERE op = 'move') AS moved, count(*) FILTER (WHERE op <> 'move') AS copies FROM og GROUP BY 1) SELECT group_id AS set_name, concat(group_id, ' — ', description, ' (', concat_ws('; ', CASE WHEN moved = 1 THEN 'move' WHEN moved > 1 THEN concat('move ', CAST(moved AS VARCHAR), ' files') END,
      CASE WHEN copies = 1 THEN '1 duplicate copy removed' WHEN copies > 1 THEN concat(CAST(copies AS VARCHAR), ' duplicate copies removed') END), ')') AS text FROM g JOIN q ON q.set_name = g.group_id"""),
    "P20_protected": (lambda s, d: changes.protected_leftovers(left(s, d)[3].withColumn("path", F.when(c("size") % 4 == 0, F.concat(F.lit("/r/Images/x/"), "entry_name")).otherwise(c("path")))), sql("SELECT concat('/r/Images/x/', entry_name) AS path, entry_name FROM flagged WHERE owner IS NULL AND NOT nodump_name AND size % 4 = 0")),
}


def match_near(spark, d, rest):
    """Leftovers without an owner against sets named nearly like them and of nearly their size."""
    from .operators import suggest

    sets = rest.where("owner IS NULL AND NOT nodump_name").where(c("entry_name").startswith("b")).select(F.regexp_replace("entry_name", r"\.txt$", "").alias("set_name"), (c("size") + 100).alias("size"))
    return suggest.near_leftovers(rest, sets, 0.95).select("path", "set_name")


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
