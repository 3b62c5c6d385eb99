"""Queries of the matcher, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import contents, view, view_of_hashes, with_views
from .lineage import cut
from .operators import audit, browse, match

KEY = ("set_ord", "item_ord")
STEM = "lower(regexp_replace(regexp_extract({p}, '[^/]*$'), '\\.[^.]*$', ''))"
RAW, BEHIND = "(c.size = f.size AND (c.md5 IS NULL OR f.md5 IS NULL OR c.md5 = f.md5))", "coalesce(c.size = f.s_size AND (c.md5 IS NULL OR f.s_md5 IS NULL OR c.md5 = f.s_md5), FALSE)"
#: The whole match as common table expressions. Where no set holds two items of one content, a claim is the best pair of both sides.
CTES = f"""cat AS (SELECT *, set_ord * 16 + item_ord AS uid FROM fx_catalog),
n AS (SELECT lower(set_name) AS set_lc, count(*) AS n_items FROM cat GROUP BY 1),
f AS (SELECT *, {STEM.format(p='path')} AS stem_lc, regexp_extract(path, '[^/]*$') <> entry_name AS in_container FROM fx_inventory),
pairs AS (SELECT c.uid, c.set_name, c.set_ord, c.item_ord, c.item_name, c.size, c.md5, c.dump_status, lower(c.set_name) AS set_lc, f.path, f.entry_name, f.in_container, {RAW} OR {BEHIND} AS fits, NOT {RAW} AS via_strip FROM cat c JOIN n ON n.set_lc = lower(c.set_name) JOIN f ON f.stem_lc = lower(c.set_name) AND (f.in_container OR n.n_items = 1)),
elected AS (SELECT set_lc, path, satisfied FROM (SELECT *, row_number() OVER (PARTITION BY set_lc ORDER BY satisfied DESC, path) AS r FROM (SELECT set_lc, path, count(DISTINCT CASE WHEN fits THEN uid END) AS satisfied FROM pairs GROUP BY 1, 2)) WHERE r = 1),
own AS (SELECT p.* FROM pairs p JOIN elected e ON e.set_lc = p.set_lc WHERE e.path = p.path OR NOT in_container),
hc AS (SELECT uid, path, entry_name, via_strip, CASE WHEN item_name = entry_name THEN 'correct' ELSE 'misnamed' END AS match_status FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY item_name <> entry_name, path, entry_name) AS r, row_number() OVER (PARTITION BY path, entry_name ORDER BY uid) AS k FROM own WHERE fits AND dump_status <> 'nodump') WHERE r = 1 AND k = 1),
nc AS (SELECT uid, path, entry_name, via_strip, CASE WHEN item_name = entry_name THEN 'correct' ELSE 'misnamed' END AS match_status FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY item_name <> entry_name, path, entry_name) AS r FROM own WHERE fits AND dump_status = 'nodump' AND (path, entry_name) NOT IN (SELECT (path, entry_name) FROM hc)) WHERE r = 1),
claims AS (SELECT * FROM hc UNION ALL SELECT * FROM nc),
wrong AS (SELECT uid, min(path) AS path, min(entry_name) AS entry_name FROM own WHERE item_name = entry_name AND NOT fits AND md5 IS NOT NULL AND (path, entry_name) NOT IN (SELECT (path, entry_name) FROM claims) GROUP BY 1),
far AS (SELECT c.uid, f.path, f.entry_name, row_number() OVER (PARTITION BY c.uid ORDER BY f.path, f.entry_name) AS r FROM cat c JOIN (SELECT path, entry_name, stem_lc, size, md5 FROM f UNION ALL SELECT path, entry_name, stem_lc, s_size, s_md5 FROM f WHERE s_md5 IS NOT NULL) f ON f.md5 = c.md5 AND f.size = c.size
  WHERE f.stem_lc NOT IN (SELECT set_lc FROM n) OR lower(c.set_name) IN (SELECT lower(x.set_name) FROM claims k JOIN cat x ON x.uid = k.uid)),
named AS (SELECT uid, min(path) AS path, min(entry_name) AS entry_name FROM own WHERE item_name = entry_name AND md5 IS NULL AND (path, entry_name) NOT IN (SELECT (path, entry_name) FROM claims) GROUP BY 1),
best AS (SELECT uid, match_status, path, entry_name, via_strip, 0 AS p FROM claims UNION ALL SELECT uid, 'hashMismatch', path, entry_name, FALSE, 1 FROM wrong UNION ALL SELECT uid, 'foundElsewhere', path, entry_name, FALSE, 2 FROM far WHERE r = 1 UNION ALL SELECT uid, 'nodump', path, entry_name, FALSE, 3 FROM named),
matches AS (SELECT c.uid, c.set_name, c.set_ord, c.item_ord, c.item_name, coalesce(b.match_status, 'missing') AS match_status, b.path, b.entry_name, coalesce(b.via_strip, FALSE) AS via_strip FROM cat c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p) AS r FROM best) b ON b.uid = c.uid AND b.r = 1 WHERE b.uid IS NOT NULL OR c.md5 IS NOT NULL),
used AS (SELECT path, entry_name FROM matches WHERE match_status IN ('correct', 'misnamed', 'hashMismatch', 'nodump')),
rest AS (SELECT * FROM f WHERE (path, entry_name) NOT IN (SELECT (path, entry_name) FROM used)),
want AS (SELECT md5, arg_min(set_name, uid) AS owner FROM cat WHERE md5 IS NOT NULL GROUP BY 1),
owned AS (SELECT r.root, r.path, r.entry_name, r.size, r.md5, r.s_md5, r.stem_lc, coalesce(h.owner, b.owner, m.owner, s.owner) AS owner FROM rest r
  LEFT JOIN want h ON h.md5 = r.md5 LEFT JOIN want b ON b.md5 = r.s_md5
  LEFT JOIN (SELECT lower(item_name) AS name_lc, arg_min(set_name, uid) AS owner FROM cat GROUP BY 1) m ON m.name_lc = lower(r.entry_name)
  LEFT JOIN (SELECT lower(set_name) AS stem_lc, min(set_name) AS owner FROM cat GROUP BY 1 HAVING count(*) = 1) s ON s.stem_lc = r.stem_lc),
sat AS (SELECT DISTINCT c.set_name AS owner, c.md5 FROM matches m JOIN cat c ON c.uid = m.uid WHERE m.match_status IN ('correct', 'misnamed') AND c.md5 IS NOT NULL),
flagged AS (SELECT o.*, (o.owner, o.md5) IN (SELECT (owner, md5) FROM sat) OR coalesce((o.owner, o.s_md5) IN (SELECT (owner, md5) FROM sat), FALSE) AS redundant, CASE WHEN e.first < o.path THEN e.first END AS copy_of, lower(o.entry_name) IN (SELECT lower(item_name) FROM cat WHERE dump_status = 'nodump') AS nodump_name, o.stem_lc IN (SELECT set_lc FROM n) AS known_container
  FROM owned o LEFT JOIN (SELECT md5, min(path) AS first FROM rest GROUP BY 1) e ON e.md5 = o.md5),
aud AS (SELECT m.set_name, m.item_name, CASE match_status WHEN 'nodump' THEN 'unverifiable' WHEN 'misnamed' THEN 'incorrect' WHEN 'foundElsewhere' THEN 'incorrect' WHEN 'hashMismatch' THEN 'badDump' ELSE match_status END AS status, m.path FROM matches m
  UNION ALL SELECT NULL, entry_name, CASE WHEN owner IS NOT NULL THEN 'incorrect' WHEN nodump_name THEN 'unverifiable' WHEN known_container THEN 'surplusInArchive' ELSE 'unknownFile' END, path FROM flagged)"""


def inventory(spark, d):
    """The files, with what is behind a header as their second identity."""
    return with_stripped(view(spark, d, "fx_inventory"))


def with_stripped(rows):
    return rows.withColumn("stripped", F.when(F.col("s_size").isNotNull(), F.struct(F.col("s_size").alias("size"), F.col("s_md5").alias("md5")))).drop("s_size", "s_md5")


def both(spark, d):
    """Items and files, each made once: a match reads them several times, and their hashes are of whole texts."""
    content = cut(contents(spark, d))
    return cut(view_of_hashes(spark, d, "fx_catalog", content)), cut(with_stripped(view_of_hashes(spark, d, "fx_inventory", content)))


def once(spark, d):
    """Items and files for queries that read each but a few times."""
    return view(spark, d, "fx_catalog"), inventory(spark, d)


def report(spark, d):
    items, files = both(spark, d)
    return items, files, match.match_items(items, files)


def owned(spark, d):
    """As ``left``, without the leftovers' flags."""
    items, files, matches = report(spark, d)
    return items, files, matches, match.owners(match.leftovers(matches, files), items)


def left(spark, d):
    items, files, matches, rest = owned(spark, d)
    return items, files, matches, match.leftover_flags(rest, matches, items)


def audited(spark, d):
    items, _, matches, rest = left(spark, d)
    return match.to_audit(matches, rest, items)


def of_status(status):
    return lambda s, d: report(s, d)[2].where(F.col("match_status") == status).select(*KEY, "path", "entry_name")


def sql(select):
    return f"WITH {CTES}\n{select}"


QUERIES = {
    "J1_content_candidates": (lambda s, d: match.candidates(*once(s, d), by_size=True).select(*KEY, "path", "entry_name", F.col("prio").cast("int").alias("prio")), """WITH i AS (SELECT path, entry_name, size, md5 FROM fx_inventory UNION ALL SELECT path, entry_name, s_size, s_md5 FROM fx_inventory WHERE s_size IS NOT NULL), h AS (SELECT c.set_ord, c.item_ord, i.path, i.entry_name FROM fx_catalog c JOIN i ON i.md5 = c.md5)
      SELECT *, 1 AS prio FROM h UNION ALL SELECT c.set_ord, c.item_ord, i.path, i.entry_name, 4 FROM fx_catalog c JOIN i ON i.size = c.size WHERE (c.set_ord, c.item_ord) NOT IN (SELECT (set_ord, item_ord) FROM h)"""),
    "J2_verified_pairs": (lambda s, d: match.verified_pairs(*once(s, d)).select(*KEY, "path", "entry_name"), "SELECT c.set_ord, c.item_ord, f.path, f.entry_name FROM fx_catalog c JOIN fx_inventory f ON f.md5 = c.md5 AND f.size = c.size UNION ALL SELECT c.set_ord, c.item_ord, f.path, f.entry_name FROM fx_catalog c JOIN fx_inventory f ON f.s_md5 = c.md5 AND f.s_size = c.size"),
    "J3_behind_headers": (lambda s, d: report(s, d)[2].where("via_strip").select(*KEY, "path", "entry_name", "match_status"), sql("SELECT set_ord, item_ord, path, entry_name, match_status FROM matches WHERE via_strip")),
    "J4_container_scope": (lambda s, d: match.scoped_pairs(*once(s, d)).select(*KEY, "path", "entry_name", "fits"), sql("SELECT set_ord, item_ord, path, entry_name, fits FROM pairs")),
    "J5_container_election": (lambda s, d: match.elect_containers(*both(s, d)), sql("SELECT set_lc, path, satisfied FROM elected")),
    "J6_match": (lambda s, d: report(s, d)[2], sql("SELECT * EXCLUDE (uid) FROM matches")),
    "J7_wrong_content": (of_status("hashMismatch"), sql("SELECT set_ord, item_ord, path, entry_name FROM matches WHERE match_status = 'hashMismatch'")),
    "J8_found_elsewhere": (of_status("foundElsewhere"), sql("SELECT set_ord, item_ord, path, entry_name FROM matches WHERE match_status = 'foundElsewhere'")),
    "J9_nodump_slots": (of_status("nodump"), sql("SELECT set_ord, item_ord, path, entry_name FROM matches WHERE match_status = 'nodump'")),
    "J13_leftovers": (lambda s, d: (lambda x: match.leftovers(x[2], x[1]))(report(s, d)).select("path", "entry_name"), sql("SELECT path, entry_name FROM rest")),
    "J14_owners": (lambda s, d: left(s, d)[3].select("path", "entry_name", "owner"), sql("SELECT path, entry_name, owner FROM owned")),
    "J15_leftover_flags": (lambda s, d: left(s, d)[3].select("path", "entry_name", "redundant", "copy_of", "nodump_name", "known_container"), sql("SELECT path, entry_name, redundant, copy_of, nodump_name, known_container FROM flagged")),
    "A13_declared_size": (lambda s, d: browse.declared_sizes(view(s, d, "fx_catalog")), "SELECT lower(set_name) AS set_lc, sum(size) AS declared FROM fx_catalog GROUP BY 1"),
    "A14_redundant_containers": (lambda s, d: (lambda x: match.redundant_containers(x[3], x[1]))(left(s, d)), sql("SELECT f.path, count(*) AS n FROM f LEFT JOIN flagged g ON g.path = f.path AND g.entry_name = f.entry_name GROUP BY 1 HAVING bool_and(coalesce(g.redundant, FALSE))")),
    "A15_emptied_containers": (lambda s, d: (lambda x: match.emptied_containers(x[3], x[1]))(left(s, d)), sql("SELECT f.path FROM f LEFT JOIN flagged g ON g.path = f.path AND g.entry_name = f.entry_name WHERE f.in_container GROUP BY 1 HAVING bool_and(g.path IS NOT NULL AND g.owner IS NULL AND NOT g.nodump_name)")),
    "X21_audit": (lambda s, d: audited(s, d).select("set_name", "item_name", "status", "path"), sql("SELECT * FROM aud")),
    "A1_match_counters": (lambda s, d: audit.counters(audited(s, d)).select("correct", "incorrect", "bad_dump", "missing", "unverifiable", "surplus"), sql("""SELECT count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect, count(*) FILTER (WHERE status = 'badDump') AS bad_dump, count(*) FILTER (WHERE status = 'missing') AS missing,
      count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable, count(*) FILTER (WHERE status IN ('surplus', 'surplusInArchive', 'unknownFile')) AS surplus FROM aud""")),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
