"""Queries of plans whose rows want each other's places, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view, with_views
from .operators import match
from .operators.report import full_audit
from .plans import changes, reservation
from .queries_match import CTES, left
from .queries_more import NULLS, SUGGESTED, plan_cols

c = F.col


def placed(spark, d):
    """Matches of sets in containers and of loose sets that share folders, and the files that they lie in."""
    rows = view(spark, d, "fx_placed")
    return rows, rows.select("path", "entry_name").where("path IS NOT NULL").distinct()


def donors(matches):
    number = c("set_ord") * 4 + c("item_ord")
    return matches.where("match_status = 'missing'").select("set_ord", "item_ord", F.concat(F.lit("/d/"), number.cast("string")).alias("donor_path"), F.lit("x").alias("donor_entry"))


#: A set's anchor: the folder of its first matched item if that is loose, else its zip container; items of other containers are no anchors.
ANCHORS = """a AS (SELECT set_name, arg_min({'f': regexp_extract(path, '[^/]*$') = entry_name, 'p': path}, set_ord * 16 + item_ord) AS a FROM fx_placed WHERE match_status IN ('correct', 'misnamed') AND (regexp_extract(path, '[^/]*$') = entry_name OR path LIKE '%.zip') GROUP BY 1),
an AS (SELECT set_name, a.f AS loose, CASE WHEN a.f THEN regexp_replace(a.p, '/[^/]*$', '') ELSE a.p END AS anchor FROM a),
oc AS (SELECT lower(path) AS k FROM fx_placed WHERE path IS NOT NULL UNION SELECT lower(concat(path, '::', entry_name)) FROM fx_placed WHERE path IS NOT NULL)"""


def filled(op, source, entry, rows):
    """Operations into anchors, of those that want one place the first, where the place is free."""
    return f"""WITH {ANCHORS}, w AS (SELECT m.set_name, {source} AS source, {entry} AS source_entry, CASE WHEN loose THEN concat(anchor, '/', item_name) ELSE anchor END AS target, CASE WHEN NOT loose THEN item_name END AS target_entry FROM fx_placed m JOIN an ON an.set_name = m.set_name WHERE {rows}),
k AS (SELECT *, lower(CASE WHEN target_entry IS NULL THEN target ELSE concat(target, '::', target_entry) END) AS k FROM w), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, source_entry, set_name, target, target_entry) AS r FROM k)
SELECT '{op}' AS op, set_name AS group_id, source, source_entry, target, target_entry FROM q WHERE r = 1 AND k NOT IN (SELECT k FROM oc)"""


def organised(spark, d):
    matches, files = placed(spark, d)
    copies = matches.where("match_status = 'foundElsewhere'").select("path", "entry_name", c("set_name").alias("owner"), F.lit(True).alias("redundant"))
    return changes.organise(matches.where("match_status <> 'foundElsewhere'"), copies, matches.where("set_ord % 3 <> 2").select("set_name").distinct(), "/all", files)


def renamed(spark, d):
    """Containers in tens, each of which gets the next one's name: in a circle, in a chain with a free end, or up to one that stays."""
    k = c("set_ord")
    tens, last = F.floor(k / 10) % 3, k % 10 == 9
    rows = view(spark, d, "fx_sets").select("set_ord", F.concat(F.lit("/r/S"), k.cast("string"), F.lit(".zip")).alias("path"))
    to = F.when(last & (tens == 0), (k - 9).cast("string")).when(last & (tens == 1), F.concat(F.lit("free"), k.cast("string"))).when(~last, (k + 1).cast("string"))
    plan = changes.plan(rows.withColumn("to", to).where("to IS NOT NULL"), "rename", c("path"), c("path"), F.concat(F.lit("/r/s"), "to", F.lit(".zip")))
    return reservation.reserve(plan, reservation.places(rows.select("path", c("path").alias("entry_name")))).select("source", "target", "turn", "refused")


def all_plans(spark, d):
    """Three plans at once: what each place may be used for, and why not for more."""
    matches, files = placed(spark, d)
    where = F.concat(F.lit("/out/"), "item_name")
    rows = matches.where("match_status = 'correct'")
    copies = changes.plan(rows, "copy", c("set_name"), c("path"), where, c("entry_name"))
    moves = changes.plan(rows.where("set_ord % 3 = 0 AND item_ord = 1"), "move", c("set_name"), c("path"), F.concat(F.lit("/out/"), "item_name"))
    return reservation.reserve(copies.unionByName(moves), reservation.places(files)).groupBy("op", "refused").agg(F.count("*").alias("n"))


def shown(spark, d):
    """The audit with all that a browser shows."""
    items, files, matches, rest = left(spark, d)
    found = full_audit(matches, rest, items, files, view(spark, d, "fx_sets"), match.misnamed_containers(rest, items, matches))
    return found.select(*SHOWN)


SETS = ("description", "clone_of", "is_bios", "is_device", "has_disk", "has_samples", "year", "manufacturer", "disk_names", "device_refs", "cpu_chips", "audio_chips", "driver_status", "display_type", "display_rotate", "players", "coins")
SHOWN = ("set_name", "item_name", "status", "dump_status", "is_optional", "is_bad_dump", "via_header", "found_elsewhere", "path", "entry_name", "expected_size", "expected_md5", "actual_size", "actual_md5", *SETS, "required_bios", "required_by", "owner_description", "redundant", "suggested", "case_mismatch")
SHOWN_SQL = f"""WITH {CTES},\n{SUGGESTED},
r AS (SELECT m.set_name, m.item_name, CASE match_status WHEN 'nodump' THEN 'unverifiable' WHEN 'misnamed' THEN 'incorrect' WHEN 'foundElsewhere' THEN 'incorrect' WHEN 'hashMismatch' THEN 'badDump' ELSE match_status END AS status, c.dump_status, coalesce(c.optional, FALSE) AS is_optional, c.dump_status = 'baddump' AS is_bad_dump, m.via_strip AS via_header,
  CASE WHEN match_status = 'foundElsewhere' THEN regexp_extract(m.path, '[^/]*$') END AS found_elsewhere, m.path, m.entry_name, c.size AS expected_size, c.md5 AS expected_md5, NULL AS required_by, NULL AS owner_description, FALSE AS redundant, NULL AS suggested FROM matches m JOIN cat c ON c.uid = m.uid
  UNION ALL SELECT NULL, g.entry_name, CASE WHEN owner IS NOT NULL THEN 'incorrect' WHEN nodump_name THEN 'unverifiable' WHEN known_container THEN 'surplusInArchive' ELSE 'unknownFile' END, NULL, FALSE, FALSE, FALSE, NULL, g.path, g.entry_name, NULL, NULL, owner, o.description, redundant, sg.suggested FROM flagged g LEFT JOIN fx_sets o ON o.set_name = g.owner LEFT JOIN sg ON sg.path = g.path)
SELECT r.*, a.size AS actual_size, a.md5 AS actual_md5, {', '.join('s.' + x for x in SETS)}, CASE WHEN s.set_ord >= 2 THEN CASE WHEN s.set_ord < 4 THEN 'set1' ELSE concat('set', CASE WHEN substr(bin(s.set_ord), 2, 1) = '0' THEN '2' ELSE '1' END) END END AS required_bios, FALSE AS case_mismatch FROM r LEFT JOIN fx_sets s ON s.set_name = r.set_name LEFT JOIN f a ON a.path = r.path AND a.entry_name = r.entry_name"""
SWAP = "concat('/r/.swap-', substr(sha1(concat('/r/S', CAST(set_ord AS VARCHAR), '.zip')), 1, 16))"
QUERIES = {
    "P9_repair_loose_sets": (lambda s, d: (lambda m: plan_cols(changes.repair(m[0], donors(m[0]), "fill", ("missing",), m[1])))(placed(s, d)), filled("fill", "concat('/d/', CAST(set_ord * 4 + item_ord AS VARCHAR))", "'x'", "match_status = 'missing'")),
    "P11_consolidate_loose_sets": (lambda s, d: plan_cols(changes.consolidate(*placed(s, d))), filled("copy_entry", "path", "entry_name", "match_status = 'foundElsewhere'")),
    "P19_organise_clashes": (lambda s, d: plan_cols(organised(s, d)), f"""WITH mv AS (SELECT DISTINCT set_name, path, concat('/all/', regexp_extract(path, '[^/]*$')) AS target FROM fx_placed WHERE set_ord % 3 <> 2 AND match_status IN ('correct', 'misnamed')),
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY path, set_name) AS r FROM mv) WHERE r = 1), won AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY path, set_name) AS k FROM one)
      SELECT 'move' AS op, set_name AS group_id, path AS source, {NULLS} AS source_entry, target, {NULLS} AS target_entry FROM won WHERE k = 1
      UNION ALL SELECT CASE WHEN regexp_extract(path, '[^/]*$') = entry_name THEN 'remove' ELSE 'remove_entry' END, set_name, path, CASE WHEN regexp_extract(path, '[^/]*$') <> entry_name THEN entry_name END, NULL, NULL FROM fx_placed WHERE match_status = 'foundElsewhere' AND set_ord % 3 <> 2 AND (path LIKE '%.zip' OR regexp_extract(path, '[^/]*$') = entry_name)"""),
    "P1_chains_and_circles": (renamed, f"""WITH r AS (SELECT set_ord, set_ord % 10 AS i, set_ord // 10 % 3 AS kind, concat('/r/S', CAST(set_ord AS VARCHAR), '.zip') AS source FROM fx_sets),
      t AS (SELECT *, concat('/r/s', CASE WHEN i < 9 THEN CAST(set_ord + 1 AS VARCHAR) WHEN kind = 0 THEN CAST(set_ord - 9 AS VARCHAR) ELSE concat('free', CAST(set_ord AS VARCHAR)) END, '.zip') AS target FROM r WHERE i < 9 OR kind < 2)
      SELECT source, target, CASE kind WHEN 0 THEN 10 - i WHEN 1 THEN 9 - i ELSE 8 - i END AS turn, CASE WHEN kind = 2 THEN 'occupied' END AS refused FROM t WHERE kind > 0 OR i > 0
      UNION ALL SELECT source, {SWAP}, 0, NULL FROM t WHERE kind = 0 AND i = 0 UNION ALL SELECT {SWAP}, target, 10, NULL FROM t WHERE kind = 0 AND i = 0"""),
    "X21_full_audit": (shown, SHOWN_SQL),
    "P22_all_plans": (all_plans, """WITH m AS (SELECT DISTINCT 'copy' AS op, set_name, path AS source, entry_name AS source_entry, concat('/out/', item_name) AS target FROM fx_placed WHERE match_status = 'correct'
      UNION ALL SELECT DISTINCT 'move', set_name, path, NULL, concat('/out/', item_name) FROM fx_placed WHERE match_status = 'correct' AND set_ord % 3 = 0 AND item_ord = 1),
      s AS (SELECT *, op = 'move' AND row_number() OVER (PARTITION BY op, lower(source) ORDER BY source, set_name, target) > 1 AS twice FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY lower(target), twice ORDER BY op, source, source_entry, set_name, target) AS k FROM s)
      SELECT op, CASE WHEN twice THEN 'source' WHEN k > 1 THEN 'claimed' END AS refused, count(*) AS n FROM k GROUP BY 1, 2"""),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items()}
