"""Queries over the audit table and set families, each with its SQL."""

from __future__ import annotations

from .fixtures import view, with_views
from .functions import names
from .lineage import scratch
from .operators import audit, browse, families, paging

listed = lambda values: ", ".join(f"'{v}'" for v in values)
#: Groups in parentheses of a description, their tokens, and what they are, computed by SQL alone.
GROUPS = "list_filter(list_transform(regexp_extract_all(description, '\\(([^()]*)\\)', 1), lambda g: trim(g)), lambda g: g <> '')"
TOKENS = "list_filter(list_transform(string_split(g, ','), lambda t: trim(t)), lambda t: t <> '')"
ALL_IN = lambda allowed: f"len(list_filter({TOKENS}, lambda t: lower(t) NOT IN ({listed(allowed)}))) = 0"
REGIONS_OF = f"flatten(list_transform(list_filter({GROUPS}, lambda g: {ALL_IN((*names.REGIONS, 'unknown'))}), lambda g: {TOKENS}))"
OTHER_KINDS = f"NOT ({ALL_IN((*names.REGIONS, 'unknown'))}) AND NOT ({ALL_IN(names.LANGUAGE_NAMES)}) AND NOT regexp_matches(lower(g), '^(rev |v[0-9]|proto|beta|sample|demo|kiosk|promo|unl$|wii$)')"
RANK = f"list_min(list_transform(flatten(list_transform({GROUPS}, lambda g: {TOKENS})), lambda t: list_min(list_transform(list_filter(list_zip(range({len(names.REGION_ORDER)}), [{listed(r.lower() for r in names.REGION_ORDER)}]), lambda z: lower(t) = z[2] OR starts_with(lower(t), concat(z[2], ' '))), lambda z: z[1]))))"
A = "fx_audit"
LEVELS = "CASE status WHEN 'missing' THEN 4 WHEN 'badDump' THEN 3 WHEN 'incorrect' THEN 2 WHEN 'correct' THEN 1 END"
ROLL = """CASE WHEN bool_or({w} AND status = 'missing' AND NOT is_optional) THEN 'missing' WHEN bool_or({w} AND status = 'badDump') THEN 'badDump' WHEN bool_or({w} AND status = 'incorrect') THEN 'incorrect'
  WHEN bool_or({w} AND status = 'correct') THEN 'correct' WHEN bool_or({w} AND status = 'unverifiable') THEN 'unverifiable' WHEN bool_or({w}) THEN 'correct' END"""
ITEM_ROLL = f"coalesce({ROLL.format(w='NOT is_disk')}, {ROLL.format(w='TRUE')})"
SURPLUS = "'surplus', 'surplusInArchive', 'unknownFile'"
COUNTERS = f"""count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect, count(*) FILTER (WHERE status = 'badDump') AS bad_dump, count(*) FILTER (WHERE status = 'missing') AS missing,
  count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable, count(*) FILTER (WHERE status IN ({SURPLUS})) AS surplus, count(*) FILTER (WHERE status = 'duplicateSet') AS duplicate"""
COMPLETION = """SELECT set_name, CASE WHEN count(*) FILTER (WHERE need) = 0 THEN 'complete' WHEN count(*) FILTER (WHERE need AND status = 'missing') = count(*) FILTER (WHERE need) THEN 'empty'
  WHEN count(*) FILTER (WHERE need AND status IN ('missing', 'badDump')) > 0 THEN 'partial' WHEN count(*) FILTER (WHERE need AND status = 'incorrect') > 0 THEN 'fixable' ELSE 'complete' END AS completion
  FROM (SELECT *, is_disk <> bool_or(NOT is_disk) OVER (PARTITION BY set_name) AND NOT is_optional AS need FROM fx_audit WHERE set_name IS NOT NULL) GROUP BY set_name"""
UNDER = "(path = '/r0' OR starts_with(path, '/r0/') OR starts_with(path, '/r0::'))"
HERE = f"SELECT DISTINCT set_name FROM fx_audit WHERE set_name IS NOT NULL AND {UNDER}"
KEY = "system_id, row_ord"
PRESENT = "SELECT s.set_name, CASE WHEN s.set_ord % 5 = 0 THEN 'missing' ELSE 'correct' END AS status FROM fx_sets s WHERE s.set_ord % 7 <> 0"


def on_audit(f, *cols):
    return lambda spark, d: (lambda df: df.select(*cols) if cols else df)(f(view(spark, d, A)))


def on_sets(f):
    return lambda spark, d: f(view(spark, d, "fx_sets"))


def statuses(spark, d):
    return spark.sql("SELECT s.set_name, CASE WHEN s.set_ord % 5 = 0 THEN 'missing' ELSE 'correct' END AS status FROM {s} s WHERE s.set_ord % 7 <> 0", s=view(spark, d, "fx_sets"))


K = ("system_id", "row_ord")
NODES = f"""WITH s AS (SELECT set_name, is_disk, count(*) AS n, {ROLL.format(w='TRUE')} AS status, bool_and(status = 'missing') AS gone FROM fx_audit WHERE set_name IS NOT NULL GROUP BY 1, 2)
      SELECT concat(CASE WHEN is_disk THEN 'disk:' ELSE 'set:' END, set_name) AS node, FALSE AS is_bucket, status, n FROM s WHERE is_disk OR NOT gone OR set_name NOT IN (SELECT set_name FROM s WHERE is_disk)
      UNION ALL SELECT concat('path:', coalesce(path, '')), TRUE, 'unknownFile', count(*) FROM fx_audit WHERE set_name IS NULL GROUP BY path"""


def node_page(spark, d, read):
    """A page of the node list, which is stored in ranges of a thousand."""
    path = scratch(spark)
    paging.store_pages(audit.nodes(view(spark, d, "fx_audit")), path, "node", 1000)
    return read(path)


def keyset_page(spark, d):
    """The fourth page of fifty, behind the key that the third ends with."""
    def read(path):
        last = paging.page_at(spark, path, "node", 149, 1).first()["node"]
        return paging.page_after(spark, path, "node", last, 50)

    return node_page(spark, d, read)


QUERIES = {
    "A1_counters": (on_audit(audit.counters), f"SELECT {COUNTERS} FROM fx_audit"),
    "A2_worst_status": (on_audit(lambda a: audit.worst_status(a, "system_id")), f"SELECT system_id, CASE coalesce(max(CASE WHEN NOT is_disk THEN {LEVELS} END), max(CASE WHEN is_disk THEN {LEVELS} END)) WHEN 4 THEN 'missing' WHEN 3 THEN 'badDump' WHEN 2 THEN 'incorrect' WHEN 1 THEN 'correct' END AS worst FROM fx_audit GROUP BY system_id"),
    "A3_set_rollup": (on_audit(audit.set_rollup), f"SELECT set_name, {ROLL.format(w='TRUE')} AS status FROM fx_audit WHERE set_name IS NOT NULL GROUP BY set_name"),
    "A4_item_rollup": (on_audit(audit.item_rollup), f"SELECT set_name, {ITEM_ROLL} AS status FROM fx_audit WHERE set_name IS NOT NULL GROUP BY set_name"),
    "A5_completion": (on_audit(audit.completion), COMPLETION),
    "A8_status_counts": (on_audit(audit.status_counts), f"SELECT status, count(*) AS n FROM (SELECT set_name, {ITEM_ROLL} AS status FROM fx_audit WHERE set_name IS NOT NULL GROUP BY set_name) GROUP BY status UNION ALL SELECT 'unknownContainer', count(DISTINCT path) FROM fx_audit WHERE set_name IS NULL"),
    "A9_unknown_containers": (on_audit(lambda a: audit.status_counts(a).where("status = 'unknownContainer'")), "SELECT 'unknownContainer' AS status, count(DISTINCT path) AS n FROM fx_audit WHERE set_name IS NULL"),
    "A10_majority_path": (on_audit(audit.majority_path), "SELECT set_name, path FROM (SELECT *, sum(n) OVER (PARTITION BY set_name) AS total, row_number() OVER (PARTITION BY set_name ORDER BY n DESC, path) AS r FROM (SELECT set_name, path, count(*) AS n FROM fx_audit WHERE set_name IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2)) WHERE r = 1 AND n * 2 >= total"),
    "A12_nodes": (on_audit(audit.nodes), NODES),
    "A16_by_manufacturer": (on_sets(lambda s: browse.browse_groups(s, "manufacturer")), "SELECT manufacturer, count(DISTINCT set_name) AS n_sets FROM fx_sets GROUP BY 1"),
    "A16_by_year": (on_sets(lambda s: browse.browse_groups(s, "year")), "SELECT year, count(DISTINCT set_name) AS n_sets FROM fx_sets GROUP BY 1"),
    "F1a_verified": (on_audit(audit.verified, *K), f"SELECT {KEY} FROM fx_audit WHERE set_name IN (SELECT set_name FROM fx_audit WHERE set_name IS NOT NULL GROUP BY set_name HAVING bool_and(status = 'correct'))"),
    "F1b_originals": (on_sets(lambda s: audit.category(s, "originals").select("set_name")), "SELECT set_name FROM fx_sets WHERE clone_of IS NULL"),
    "F1b_clones": (on_sets(lambda s: audit.category(s, "clones").select("set_name")), "SELECT set_name FROM fx_sets WHERE clone_of IS NOT NULL"),
    "F1c_bios_files": (on_sets(lambda s: audit.category(s, "biosFiles").select("set_name")), "SELECT set_name FROM fx_sets WHERE is_bios"),
    "F1c_bad_dumps": (lambda sp, d: audit.category(view(sp, d, "fx_catalog"), "gamesWithBadDumps").select("set_ord", "item_ord"), "SELECT set_ord, item_ord FROM fx_catalog WHERE dump_status <> 'good'"),
    "F1c_nodump": (lambda sp, d: audit.category(view(sp, d, "fx_catalog"), "gamesWithNodump").select("set_ord", "item_ord"), "SELECT set_ord, item_ord FROM fx_catalog WHERE dump_status = 'nodump'"),
    "F1d_missing": (on_audit(lambda a: audit.category(a, "missingGames"), *K), f"SELECT {KEY} FROM fx_audit WHERE status = 'missing'"),
    "F1d_incorrect": (on_audit(lambda a: audit.category(a, "incorrectGames"), *K), f"SELECT {KEY} FROM fx_audit WHERE status = 'incorrect'"),
    **{f"F1f_{kind}": (on_audit(lambda a, kind=kind: audit.category(a, f"{kind}Games"), *K), f"SELECT {KEY} FROM fx_audit WHERE set_name IN (SELECT set_name FROM ({COMPLETION}) WHERE completion = '{kind}')") for kind in ("complete", "fixable", "partial", "empty")},
    "F3_scoped": (on_audit(lambda a: audit.scoped(a, "/r0"), *K), f"SELECT {KEY} FROM fx_audit WHERE coalesce({UNDER}, FALSE) OR (path IS NULL AND set_name IN ({HERE}))"),
    "F4_sets_in_root": (on_audit(lambda a: audit.sets_in_root(a, "/r0")), HERE),
    "F5_search_prefix": (lambda sp, d: audit.search(view(sp, d, "fx_sets"), "description", "title 1").select("set_name"), "SELECT set_name FROM fx_sets WHERE starts_with(lower(description), 'title 1')"),
    "F5_search_wildcard": (lambda sp, d: audit.search(view(sp, d, "fx_sets"), "description", "title 1? (usa*").select("set_name"), "SELECT set_name FROM fx_sets WHERE regexp_matches(description, '(?i)title 1. \\(usa.*')"),
    "F7_rescan_summary": (on_audit(lambda a: audit.rescan_summary(a, "/r0")), f"SELECT {COUNTERS} FROM fx_audit WHERE set_name IN ({HERE}) OR (set_name IS NULL AND (path IS NULL OR {UNDER}))"),
    "F12_toggles": (on_audit(lambda a: audit.by_toggles(a, ["missing", "badDump"], True), *K), f"SELECT {KEY} FROM fx_audit WHERE set_name IS NULL OR set_name IN (SELECT set_name FROM (SELECT set_name, {ITEM_ROLL} AS s FROM fx_audit WHERE set_name IS NOT NULL GROUP BY set_name) WHERE s IN ('missing', 'badDump'))"),
    "K5_collection_report": (on_audit(lambda a: audit.collection_report(a.select("system_id").distinct(), a)), f"SELECT system_id, count(status) AS rows, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status IN ({SURPLUS})) AS surplus, count(status) > 0 AS scanned FROM fx_audit GROUP BY ROLLUP (system_id)"),
    "T3_keyset_page": (keyset_page, f"SELECT * FROM ({NODES}) ORDER BY node LIMIT 50 OFFSET 150"),
    "T3_numbered_page": (lambda s, d: node_page(s, d, lambda p: paging.page_at(s, p, "node", 200, 80)), f"SELECT * FROM ({NODES}) ORDER BY node LIMIT 80 OFFSET 200"),
    "T3_page": (on_audit(lambda a: audit.page(a, ["row_ord"], 100, 50).select("system_id", "row_ord")), f"SELECT {KEY} FROM fx_audit ORDER BY row_ord LIMIT 50 OFFSET 100"),
    "A6_parent_summary": (lambda sp, d: families.parent_summary(view(sp, d, "fx_sets"), statuses(sp, d)), f"""WITH h AS (SELECT set_name FROM ({PRESENT}) WHERE status <> 'missing') SELECT clone_of AS parent, count(*) AS variants, count(h.set_name) AS present, CASE WHEN clone_of IN (SELECT set_name FROM h) THEN 0 ELSE count(h.set_name) END AS orphans
      FROM fx_sets s LEFT JOIN h ON h.set_name = s.set_name WHERE clone_of IS NOT NULL GROUP BY clone_of"""),
    "A7_one_per_family": (on_sets(families.one_per_family), f"""WITH r AS (SELECT set_name, coalesce(clone_of, set_name) AS family, {RANK} AS rank FROM fx_sets),
      w AS (SELECT *, count(*) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family ORDER BY rank NULLS LAST, set_name) AS k FROM r) SELECT set_name, family, rank IS NOT NULL AND k = 1 AS preferred, rank IS NOT NULL AND k > 1 AS hidden FROM w WHERE n > 1"""),
    "A20_catalog_facts": (on_sets(families.base_of_family), "SELECT bool_or(clone_of IS NOT NULL) AS has_clones, count(DISTINCT lower(set_name)) AS n_names FROM fx_sets"),
    "J20_base_ancestor": (on_sets(families.base_ancestor), f"""WITH RECURSIVE chain(set_name, ancestor, depth) AS (SELECT set_name, rom_of, 1 FROM fx_sets WHERE rom_of IS NOT NULL UNION ALL
      SELECT c.set_name, p.rom_of, c.depth + 1 FROM chain c JOIN fx_sets p ON p.set_name = c.ancestor WHERE p.rom_of IS NOT NULL AND c.depth < 32) SELECT c.set_name, arg_min(ancestor, depth) AS base FROM chain c JOIN fx_sets b ON b.set_name = c.ancestor WHERE b.is_bios GROUP BY c.set_name"""),
    "J21_dependency_chain": (on_sets(families.dependency_chain), """WITH RECURSIVE chain(set_name, ancestor, depth) AS (SELECT set_name, rom_of, 1 FROM fx_sets WHERE rom_of IS NOT NULL UNION ALL
      SELECT c.set_name, p.rom_of, c.depth + 1 FROM chain c JOIN fx_sets p ON p.set_name = c.ancestor WHERE p.rom_of IS NOT NULL AND c.depth < 32),
      a AS (SELECT set_name, string_agg(ancestor, '>' ORDER BY depth DESC) AS above, bool_and(ancestor IN (SELECT set_name FROM fx_sets)) AS known FROM chain GROUP BY set_name)
      SELECT s.set_name, CASE WHEN above IS NULL THEN s.set_name ELSE concat(above, '>', s.set_name) END AS chain, CASE WHEN NOT known THEN 'unknown' END AS error FROM fx_sets s LEFT JOIN a ON a.set_name = s.set_name"""),
    "J22_component_closure": (lambda sp, d: families.closure(view(sp, d, "fx_components")), "WITH RECURSIVE r(src, dst) AS (SELECT src, dst FROM fx_components UNION SELECT r.src, c.dst FROM r JOIN fx_components c ON c.src = r.dst) SELECT src, dst FROM r"),
    "X1_region_tags": (on_sets(lambda s: s.select("set_name", names.region(names.F.col("description")).alias("region"), names.F.array_join(names.languages(names.F.col("description")), "|").alias("languages"))), f"SELECT set_name, list_filter({GROUPS}, lambda g: lower(g) IN ({listed(names.REGIONS)}))[1] AS region, coalesce(array_to_string(list_transform(list_filter({GROUPS}, lambda g: {ALL_IN(names.LANGUAGES)}), lambda g: {TOKENS})[1], '|'), '') AS languages FROM fx_sets"),
    "X2_name_details": (on_sets(lambda s: s.select("set_name", names.details(names.F.col("description")).alias("x")).select("set_name", names.F.array_join("x.regions", "|").alias("regions"), names.F.col("x.stage").alias("stage"), names.F.col("x.revision").alias("revision"), names.F.col("x.version").alias("version"), names.F.array_join("x.distribution", "|").alias("distribution"), names.F.array_join("x.other", "|").alias("other"))),
      f"""SELECT set_name, coalesce(array_to_string({REGIONS_OF}, '|'), '') AS regions, CASE WHEN description LIKE '%(Beta 2)%' THEN concat('Beta', substr(regexp_extract(description, '\\((Beta[^)]*)', 1), 5)) WHEN description LIKE '%(Demo)%' THEN 'Demo' WHEN description LIKE '%(Sample)%' THEN 'Sample' WHEN description LIKE '%(Proto%' THEN concat('Prototype ', substr(regexp_extract(description, '\\((Proto[^)]*)', 1), 6)) END AS stage,
      nullif(regexp_extract(description, '\\(Rev ([^)]*)\\)', 1), '') AS revision, nullif(regexp_extract(description, '\\(v([0-9][^)]*)\\)', 1), '') AS version, CASE WHEN description LIKE '%(Wii)%' THEN 'Wii' ELSE '' END AS distribution, coalesce(array_to_string(list_filter({GROUPS}, lambda g: {OTHER_KINDS}), '|'), '') AS other FROM fx_sets"""),
    "X3_video_standard": (on_sets(lambda s: s.select("set_name", names.video_standard(names.all_regions(names.F.col("description"))).alias("video"))), f"""WITH r AS (SELECT set_name, list_transform({REGIONS_OF}, lambda t: lower(t)) AS r FROM fx_sets), k AS (SELECT *, list_has_any(r, [{listed(names.NTSC)}]) AS ntsc, list_has_any(r, [{listed(names.PAL)}]) AS pal FROM r)
      SELECT set_name, CASE WHEN ntsc AND pal THEN 'NTSC / PAL (60 Hz / 50 Hz)' WHEN ntsc THEN 'NTSC (60 Hz)' WHEN pal THEN 'PAL (50 Hz)' WHEN list_contains(r, 'world') THEN 'NTSC / PAL' END AS video FROM k"""),
    "X4_norm_key": (lambda sp, d: view(sp, d, "fx_name_local").select("local_name", names.norm_key(names.F.col("local_name")).alias("norm_key")), "SELECT local_name, regexp_replace(lower(local_name), '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS norm_key FROM fx_name_local"),
    "X6_base_title": (on_sets(lambda s: s.select("set_name", names.base_title(names.F.col("description")).alias("title"))), "SELECT set_name, trim(split_part(description, '(', 1)) AS title FROM fx_sets"),
    "X10_region_rank": (on_sets(lambda s: s.select("set_name", names.region_rank(names.F.col("description")).alias("rank"))), f"SELECT set_name, CAST({RANK} AS INTEGER) AS rank FROM fx_sets"),
    "X11_title_id": (lambda sp, d: view(sp, d, "fx_titles").select("file_name", names.title_id(names.F.col("file_name")).alias("tid")).withColumn("base_id", names.base_title_id(names.F.col("tid"))), "SELECT file_name, tid, CASE WHEN tid LIKE '%000' OR tid LIKE '%800' THEN concat(substr(tid, 1, 13), '000') ELSE lpad(upper(to_hex((CAST('0x' || tid AS BIGINT) - 4096) // 4096 * 4096)), 16, '0') END AS base_id FROM (SELECT file_name, upper(regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1)) AS tid FROM fx_titles)"),
    "X12_title_kind": (lambda sp, d: view(sp, d, "fx_titles").withColumn("k", names.title_kind(names.title_id(names.F.col("file_name")))).withColumn("version", names.title_version(names.F.col("file_name"))).select("file_name", names.F.col("k").alias("kind"), "version", names.title_label(names.F.col("k"), names.F.col("version")).alias("label")),
      """SELECT file_name, kind, version, CASE kind WHEN 'base' THEN 'Base' WHEN 'dlc' THEN 'DLC' ELSE CASE WHEN version <= 0 THEN 'Update' ELSE concat('Update ', CAST(version // 65536 AS VARCHAR)) END END AS label FROM (SELECT file_name, CASE right(tid, 3) WHEN '000' THEN 'base' WHEN '800' THEN 'update' ELSE 'dlc' END AS kind, version FROM
      (SELECT file_name, regexp_extract(file_name, '\\[(0100[0-9A-F]{12})\\]', 1) AS tid, CAST(regexp_extract(file_name, '\\[v([0-9]+)\\]', 1) AS BIGINT) AS version FROM fx_titles))"""),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(sql) for k, (_, sql) in QUERIES.items() if sql}
