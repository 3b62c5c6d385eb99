"""Queries of packs, aliases, variants, names alone and samples, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixtures import view, with_views
from .operators import alternates, audit, browse, companions, snapshots
from .queries_audit import COUNTERS
from .queries_match import CTES, both

PACKS = """SELECT DISTINCT concat('/p', CAST(CAST(floor(doc_id / {m}) AS BIGINT) AS STRING), '/g', CAST(doc_id % 3 AS STRING), CASE doc_id % 4 WHEN 0 THEN '.sfc' WHEN 1 THEN concat('-', CAST(doc_id % 5 AS STRING), '.pcm') WHEN 2 THEN '.msu' ELSE '.txt' END) AS path FROM {docs}"""


def packs(spark, d, m):
    return spark.sql(PACKS.replace("{m}", str(m)), docs=spark.read.parquet(f"{d}/documents.parquet"))


def packs_sql(m):
    return PACKS.replace("{m}", str(m)).replace("{docs}", "documents")


def local(spark, d, *tails):
    """Names of the catalog with another tag, by a row's size: the first is known to mean the catalog's."""
    tail = F.get(F.array(*[F.lit(t) for t in tails]), (F.col("size") % len(tails)).cast("int"))
    return view(spark, d, "fx_name_catalog").select(F.concat(F.regexp_replace("set_name", r" \(USA\)$", ""), tail).alias("local_name"))


QUERIES = {
    "A11_bucket_keys": (lambda s, d: companions.bucket_keys(packs(s, d, 10)), f"""WITH p AS ({packs_sql(10)}), x AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '/(g[0-9])', 1) AS base, regexp_extract(path, '\\.([a-z]*)$', 1) AS ext FROM p),
      k AS (SELECT folder, count(DISTINCT CASE WHEN ext = 'sfc' THEN base END) AS n FROM x GROUP BY 1 HAVING bool_or(ext IN ('msu', 'pcm')))
      SELECT path, CASE WHEN k.folder IS NULL OR ext = 'txt' THEN path WHEN n <= 1 THEN concat('pack-folder|', x.folder) ELSE concat('pack-item|', x.folder, '|', base) END AS bucket FROM x LEFT JOIN k ON k.folder = x.folder"""),
    "A18_track_counts": (lambda s, d: companions.track_counts(packs(s, d, 7)), f"""WITH p AS ({packs_sql(7)}), x AS (SELECT path, regexp_extract(path, '^(.*/g[0-9])', 1) AS base, path LIKE '%.pcm' AS track FROM p)
      SELECT i.path, (SELECT count(*) FROM x t WHERE t.track AND t.base = i.base) AS tracks FROM x i WHERE i.path LIKE '%.sfc'"""),
    "F11_companions_discounted": (lambda s, d: companions.unexplained(packs(s, d, 7).withColumn("owner", F.when(F.col("path").like("/p1/%"), F.lit("o")))).select("path"), f"SELECT path FROM ({packs_sql(7)}) WHERE NOT (path LIKE '%.msu' OR path LIKE '%.pcm') OR path LIKE '/p1/%'"),
    "J10_names_alone": (lambda s, d: alternates.match_names(*both(s, d), with_size=True).select("set_ord", "item_ord", "path", "entry_name"), f"""WITH {CTES}, a AS (SELECT p.uid, p.path, p.entry_name, (p.size = i.size AND (p.md5 IS NULL OR p.md5 = i.md5)) AS raw FROM pairs p JOIN fx_inventory i USING (path, entry_name) WHERE p.item_name = p.entry_name AND i.size - p.size IN (0, 16, 64, 128, 512)), b AS (SELECT *, bool_or(raw) OVER (PARTITION BY uid) AS any_fit FROM a)
      SELECT c.set_ord, c.item_ord, path, entry_name FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY path, entry_name) AS r FROM b WHERE raw OR NOT any_fit) x JOIN cat c ON c.uid = x.uid WHERE r = 1"""),
    "J11_aliases": (lambda s, d: alternates.match_aliases(local(s, d, " (U)", " (E)", " (Q)"), view(s, d, "fx_name_catalog")), "SELECT replace(set_name, '(USA)', '(U)') AS local_name, set_name FROM fx_name_catalog WHERE size % 3 = 0"),
    "J12_variants": (lambda s, d: alternates.match_variants(local(s, d, " (Rev A)", " (Rev B)"), view(s, d, "fx_name_catalog").select(F.regexp_replace("set_name", r" \(USA\)$", " (En,Ja) (Rev 1)").alias("set_name"))), "SELECT replace(set_name, '(USA)', '(Rev A)') AS local_name, replace(set_name, '(USA)', '(En,Ja) (Rev 1)') AS set_name FROM fx_name_catalog WHERE size % 2 = 0"),
    "J35_sample_containers": (lambda s, d: alternates.sample_containers(view(s, d, "fx_sets").select("set_name", F.col("clone_of").alias("sample_of")), view(s, d, "fx_inventory")), "SELECT n.s AS sample_set, min(path) AS path FROM (SELECT DISTINCT coalesce(clone_of, set_name) AS s FROM fx_sets) n JOIN fx_inventory i ON i.path LIKE '%.zip' AND lower(regexp_extract(i.path, '([^/]*)\\.zip$', 1)) = lower(n.s) GROUP BY 1"),
    "A21_state_tally": (lambda s, d: browse.state_tally(view(s, d, "fx_inventory").withColumn("state", F.expr("CASE size % 5 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'decryptedFlagMissing' WHEN 2 THEN 'decrypted' END"))), "SELECT count(*) FILTER (WHERE size % 5 = 0) AS encrypted, count(*) FILTER (WHERE size % 5 = 1) AS unflagged, count(*) FILTER (WHERE size % 5 < 3) AS total FROM fx_inventory"),
    "I6_drop_root": (lambda s, d: audit.counters(snapshots.remove(view(s, d, "fx_audit"), prefix="/r2")), f"SELECT {COUNTERS} FROM fx_audit WHERE path IS NULL OR NOT starts_with(path, '/r2/')"),
}


def queries():
    return {k: f for k, (f, _) in QUERIES.items()}


def oracles():
    return {k: with_views(text) for k, (_, text) in QUERIES.items() if text}
