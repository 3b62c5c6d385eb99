"""Example views over the sample tables, in SQL that Spark and DuckDB both accept; queries and their SQL start from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")

VIEWS = {
    "fx_content": """
SELECT d.doc_id, coalesce(o.n_chars, d.n_chars) AS size, coalesce(o.text, d.text) AS text
FROM documents d LEFT JOIN documents o ON d.doc_id % 4 = 3 AND d.doc_id % 5 < 2 AND o.doc_id = CAST(floor(d.doc_id / 16) AS BIGINT) * 16 + 3""",
    "fx_catalog": """
SELECT concat('set', CAST(CAST(floor(doc_id/4) AS BIGINT) AS STRING)) AS set_name,
       CAST(floor(doc_id/4) AS BIGINT) AS set_ord, doc_id % 4 AS item_ord,
       concat(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE 'd' END, CAST(doc_id AS STRING), '.txt') AS item_name,
       size, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE md5(text) END AS md5,
       CASE WHEN doc_id % 17 = 0 THEN 'nodump' WHEN doc_id % 29 = 0 THEN 'baddump' ELSE 'good' END AS dump_status,
       doc_id % 19 = 0 AS optional
FROM fx_content""",
    "fx_sets": """
SELECT set_ord, concat('set', CAST(set_ord AS STRING)) AS set_name,
       concat('Title ', CAST(CAST(floor(set_ord/4) AS BIGINT) AS STRING), CASE set_ord % 12 WHEN 0 THEN ' (World)' WHEN 1 THEN ' (USA, Europe)' WHEN 2 THEN ' (Japan 940302)' WHEN 3 THEN ' (Prototype)' WHEN 4 THEN ' (USA) (En,Fr,De)' WHEN 5 THEN ' (Europe) (Rev B) (Beta 2)'
         WHEN 6 THEN ' (Japan) (Ja)' WHEN 7 THEN ' (Korea, USA) (Unl)' WHEN 8 THEN ' (Brazil) (Demo)' WHEN 9 THEN ' (Unknown) (v1.2)' WHEN 10 THEN ' (Australia) (Wii) (Other)' ELSE ' (Germany, France) (De,Fr) (Sample)' END) AS description,
       CASE WHEN set_ord % 4 = 0 THEN NULL ELSE concat('set', CAST(set_ord - set_ord % 4 AS STRING)) END AS clone_of,
       CASE WHEN set_ord = 0 THEN NULL ELSE concat('set', CAST(CAST(floor(set_ord/2) AS BIGINT) AS STRING)) END AS rom_of,
       set_ord IN (1, 2) AS is_bios, set_ord % 31 = 5 AS is_device, set_ord % 10 = 4 AS has_disk, set_ord % 12 = 1 AS has_samples,
       CASE WHEN set_ord % 7 <> 0 THEN CAST(1980 + set_ord % 20 AS STRING) END AS year, CASE WHEN set_ord % 11 <> 0 THEN concat('Maker ', CAST(set_ord % 13 AS STRING)) END AS manufacturer,
       CASE set_ord % 5 WHEN 0 THEN 'z80, ay8910' WHEN 1 THEN 'm68000,ym2151 , m6502' WHEN 2 THEN 'screen' ELSE '' END AS device_refs,
       CASE WHEN set_ord % 6 = 2 THEN 'Zilog Z80, Other' END AS cpu_chips, CASE WHEN set_ord % 6 IN (2, 3) THEN 'Some Sound' END AS audio_chips,
       CASE WHEN set_ord % 10 = 4 THEN concat('disk', CAST(set_ord AS STRING), CASE WHEN set_ord % 20 = 4 THEN ', more' ELSE '' END) END AS disk_names,
       CASE set_ord % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'imperfect' WHEN 2 THEN 'preliminary' WHEN 3 THEN 'odd' END AS driver_status,
       CASE WHEN set_ord % 3 = 0 THEN 'raster' WHEN set_ord % 3 = 1 THEN 'vector' END AS display_type, CASE set_ord % 8 WHEN 0 THEN '0' WHEN 1 THEN '90' WHEN 2 THEN '180' WHEN 3 THEN '270' WHEN 4 THEN '45' END AS display_rotate,
       CASE WHEN set_ord % 4 < 3 THEN CAST(set_ord % 4 + 1 AS STRING) END AS players, CASE WHEN set_ord % 6 < 4 THEN CAST(set_ord % 6 AS STRING) END AS coins
FROM (SELECT DISTINCT CAST(floor(doc_id/4) AS BIGINT) AS set_ord FROM documents) s""",
    "fx_inventory": """
WITH base AS (
  SELECT doc_id, CAST(floor(doc_id/4) AS BIGINT) AS set_ord, size, text, doc_id % 6 = 1 AND doc_id % 13 <> 0 AS headed FROM fx_content WHERE doc_id % 11 <> 0),
placed AS (
  SELECT *, 0 AS copy FROM base
  UNION ALL SELECT *, 1 AS copy FROM base WHERE set_ord % 5 = 0)
SELECT concat('/r', CAST((set_ord + copy) % 3 AS STRING)) AS root,
       concat('/r', CAST((set_ord + copy) % 3 AS STRING), CASE WHEN set_ord % 7 = 0 THEN '/sub/' ELSE '/' END, CASE WHEN set_ord % 23 = 0 THEN 'w' ELSE 'set' END, CAST(set_ord AS STRING), '.zip') AS path,
       concat('d', CAST(doc_id AS STRING), '.txt') AS entry_name,
       CASE WHEN doc_id % 13 = 0 THEN size + 1 WHEN headed THEN size + 4 ELSE size END AS size,
       CASE WHEN doc_id % 13 = 0 THEN md5(concat(text, '!')) WHEN headed THEN md5(concat('head', text)) ELSE md5(text) END AS md5,
       CASE WHEN headed THEN size END AS s_size, CASE WHEN headed THEN md5(text) END AS s_md5
FROM placed
UNION ALL
SELECT '/r0' AS root, concat('/r0/b', CAST(item_id AS STRING), '.txt') AS path, concat('b', CAST(item_id AS STRING), '.txt') AS entry_name,
       CAST(length(text) AS BIGINT) AS size, md5(text) AS md5, CAST(NULL AS BIGINT) AS s_size, CAST(NULL AS STRING) AS s_md5 FROM benchmark
UNION ALL
SELECT '/r2' AS root, concat('/r2/zz', CAST(item_id AS STRING), '.zip') AS path, 'z.bin' AS entry_name,
       CAST(length(text) AS BIGINT) + 2 AS size, md5(concat('zz', text)) AS md5, CAST(NULL AS BIGINT) AS s_size, CAST(NULL AS STRING) AS s_md5 FROM benchmark""",
    "fx_audit": """
SELECT user_id AS system_id, event_id AS row_ord,
       CASE WHEN event_type = 'click' THEN NULL ELSE concat('set', CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING)) END AS set_name,
       CASE WHEN event_type = 'click' THEN 'unknownFile' WHEN floor(event_id / 8) % 6 = 0 THEN 'correct' WHEN floor(event_id / 8) % 6 = 1 THEN CASE WHEN event_id % 8 < 4 THEN 'incorrect' ELSE 'correct' END WHEN floor(event_id / 8) % 6 = 2 THEN 'missing'
         WHEN event_type = 'signup' THEN 'correct' WHEN event_type = 'view' THEN 'incorrect' WHEN event_type = 'error' THEN 'badDump' WHEN event_type = 'purchase' THEN 'missing' ELSE 'unverifiable' END AS status,
       event_id % 9 = 0 AS is_disk, event_id % 12 = 0 AS is_optional,
       CASE WHEN event_type = 'purchase' THEN NULL ELSE concat('/r', CAST(event_id % 3 AS STRING), '/set', CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING), '.zip') END AS path, ts AS scanned_at
FROM events""",
    "fx_prev": """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 1 THEN 'missing' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 10 <> 0""",
    "fx_next": """
SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 2""",
    "fx_name_catalog": """
SELECT concat(p_name, ' ', CAST(p_partkey AS STRING), ' (USA)') AS set_name, CAST((p_partkey * 7919) % 1000003 AS BIGINT) AS size FROM part""",
    "fx_name_local": """
SELECT concat(substring(p_name, 1, 3), substring(p_name, 5, 100), ' ', CAST(p_partkey AS STRING), ' (USA).zip') AS local_name, CAST((p_partkey * 7919) % 1000003 + CASE WHEN p_partkey % 3 = 0 THEN 600 ELSE 16 END AS BIGINT) AS size FROM part""",
    "fx_components": """
SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part
UNION SELECT p_partkey AS src, CAST(floor(p_partkey / 5) AS BIGINT) AS dst FROM part""",
    "fx_disks": """
SELECT s_suppkey AS ord, concat('set', CAST(s_suppkey AS STRING)) AS set_name, concat('disk', CAST(s_suppkey % 60 AS STRING)) AS disk_name,
       CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE sha1(concat('c', CAST(s_suppkey % 60 AS STRING))) END AS sha1 FROM supplier""",
    "fx_disk_files": """
SELECT concat('/r', CAST(s_suppkey % 2 AS STRING), CASE WHEN s_suppkey % 6 < 2 THEN concat('/DISK', CAST(s_suppkey % 75 AS STRING)) WHEN s_suppkey % 6 = 2 THEN '/other' ELSE '' END, '/disk', CAST(s_suppkey % 75 AS STRING), '.chd') AS path, concat('disk', CAST(s_suppkey % 75 AS STRING)) AS stem,
       sha1(concat('c', CAST(CASE WHEN s_suppkey % 7 = 0 THEN 900 + s_suppkey ELSE s_suppkey % 75 END AS STRING))) AS sha1 FROM supplier WHERE s_suppkey % 5 <> 0""",
    "fx_titles": """
SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN 'Game ' ELSE 'GAME ' END, CAST(p_partkey % 150 AS STRING), ' [0100', lpad(hex(CAST(p_partkey * 8192 + CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 2048 ELSE 4097 END AS BIGINT)), 12, '0'), '][v', CAST((p_size % 4) * 65536 AS STRING), '].nsp') AS file_name,
       CAST(p_partkey * 10 AS BIGINT) AS size FROM part""",
    "fx_machines": """
SELECT i AS set_ord, concat('m', CAST(i AS STRING)) AS set_name, CASE WHEN i % 3 <> 0 THEN concat('m', CAST(i - i % 3 AS STRING)) END AS clone_of,
       CASE WHEN i % 97 = 5 THEN 'nowhere' WHEN i % 30 = 0 THEN NULL WHEN i % 3 <> 0 THEN concat('m', CAST(i - i % 3 AS STRING)) ELSE concat('m', CAST(i - i % 30 AS STRING)) END AS rom_of,
       i % 30 = 0 AS is_bios, i % 30 >= 28 AS is_device,
       CASE WHEN i % 6 = 3 OR i % 10 = 1 THEN concat('m', CAST(i - i % 30 + 29 AS STRING)) WHEN i % 30 IN (12, 29) THEN concat('m', CAST(i - i % 30 + 28 AS STRING)) END AS ref,
       CASE WHEN i % 12 = 3 THEN concat('m', CAST(i - i % 30 + 28 AS STRING)) WHEN i % 30 = 14 THEN concat('m', CAST(i - i % 30 + 27 AS STRING)) END AS ref2
FROM (SELECT DISTINCT CAST(floor(p_partkey / 4) AS BIGINT) AS i FROM part) s""",
    "fx_parts": """
SELECT concat('m', CAST(s AS STRING)) AS set_name, item_ord, CASE item_ord WHEN 0 THEN concat('own', CAST(s AS STRING)) WHEN 1 THEN concat('rom', CAST(s AS STRING)) WHEN 2 THEN 'common' ELSE 'same' END AS item_name,
       CASE item_ord WHEN 2 THEN 10 + s % 2 WHEN 3 THEN 7 ELSE n END AS size, CASE item_ord WHEN 2 THEN concat('c', CAST(s % 2 AS STRING)) WHEN 3 THEN concat('f', CAST(CAST(floor(s / 3) AS BIGINT) AS STRING)) ELSE substring(md5(concat('p', CAST(k AS STRING))), 1, 8) END AS crc32,
       CASE WHEN item_ord = 1 AND s % 3 <> 0 THEN concat(CASE WHEN s % 5 = 0 THEN 'gone' ELSE 'rom' END, CAST(s - s % 3 AS STRING)) WHEN item_ord = 1 AND s % 9 = 0 AND s % 30 <> 0 THEN concat('rom', CAST(s - s % 30 AS STRING)) END AS merge_name
FROM (SELECT p_partkey AS k, p_partkey % 4 AS item_ord, CAST(floor(p_partkey / 4) AS BIGINT) AS s, CAST(p_size AS BIGINT) AS n FROM part) x""",
    "fx_placed": """
SELECT set_name, set_ord, item_ord, concat('n', CAST(item_ord % 3 AS STRING), CASE WHEN set_ord % 2 = 0 THEN '.txt' ELSE '.TXT' END) AS item_name,
       CASE (set_ord * 4 + item_ord) % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'foundElsewhere' WHEN 2 THEN 'misnamed' ELSE 'correct' END AS match_status,
       CASE WHEN (set_ord * 4 + item_ord) % 7 = 0 THEN NULL WHEN set_ord % 3 = 0 THEN concat('/l/d', CAST(set_ord % 40 AS STRING), '/', CASE WHEN set_ord % 5 = 0 AND item_ord = 1 THEN 'n0.txt' ELSE concat('f', CAST(set_ord * 4 + item_ord AS STRING)) END)
         WHEN set_ord % 11 = 0 THEN concat('/z', CAST(set_ord % 2 AS STRING), '/box', CAST(set_ord AS STRING), '.7z') ELSE concat('/z', CAST(set_ord % 2 AS STRING), '/box', CAST(CAST(floor(set_ord / 2) AS BIGINT) AS STRING), '.zip') END AS path,
       CASE WHEN (set_ord * 4 + item_ord) % 7 = 0 THEN NULL WHEN set_ord % 3 = 0 THEN CASE WHEN set_ord % 5 = 0 AND item_ord = 1 THEN 'n0.txt' ELSE concat('f', CAST(set_ord * 4 + item_ord AS STRING)) END ELSE concat(CASE WHEN item_ord = 2 AND set_ord % 4 = 1 THEN 'N2.txt' ELSE 'e' END, CASE WHEN item_ord = 2 AND set_ord % 4 = 1 THEN '' ELSE CAST(set_ord * 4 + item_ord AS STRING) END) END AS entry_name
FROM fx_catalog""",
    "fx_scan": """
SELECT concat('/c', CAST(o_custkey AS STRING), '.zip') AS path, concat('e', CAST(o_orderkey AS STRING)) AS entry_path, o_orderkey AS size, o_orderdate AS mtime FROM orders""",
    "fx_known": """
SELECT concat('/c', CAST(o_custkey AS STRING), '.zip') AS path, concat('e', CAST(o_orderkey AS STRING)) AS entry_path, o_orderkey AS size, CASE WHEN o_custkey % 13 = 0 AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS mtime,
       CASE WHEN o_custkey % 17 <> 0 THEN md5(CAST(o_orderkey AS STRING)) END AS md5 FROM orders WHERE o_custkey % 10 <> 0""",
    "fx_roots": """
SELECT * FROM (VALUES ('/r0', 0), ('/r1', 1), ('/r2', 2), ('/r0/sub', 3)) AS t(root, root_ord)""",
}


def needed(sql: str) -> list[str]:
    """The views that a statement reads, those that views read included, in the order of VIEWS."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\bfx_\w+", todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """A statement with the views it reads as common table expressions."""
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed(sql))
    if not ctes:
        return sql
    body = sql.strip()
    if re.match("(?i)with recursive", body):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    return f"WITH {ctes},\n{body[4:]}" if re.match("(?i)with\\b", body) else f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view ``name`` over the tables in ``sf_dir``."""
    sql = with_views(f"SELECT * FROM {name}")
    args = {}
    for t in TABLES:
        if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
            args[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **args)


#: What views ask of a text, and the column that has it where texts are hashed once.
OF_TEXT = {"md5(concat(text, '!'))": "md5_longer", "md5(concat('head', text))": "md5_headed", "md5(text)": "md5_text"}


def hashed(df: DataFrame) -> DataFrame:
    """``df`` with the hashes of its texts."""
    return df.withColumns({name: F.expr(of) for of, name in OF_TEXT.items()})


#: The rows whose hashes views read, where that isn't all.
READ = {"md5_longer": "doc_id % 13 = 0", "md5_headed": "doc_id % 6 = 1"}


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view fx_content with hashes in the texts' place: texts are read and hashed once, and no join moves them."""
    docs = hashed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # Only such rows stand for others, which may be read by any hash.
    original = "pmod(doc_id, 16) = 3"
    docs = cut(docs.select("doc_id", "n_chars", *[F.when(F.expr(f"{READ.get(name, 'TRUE')} OR {original}"), F.col(name)).alias(name) for name in OF_TEXT.values()]))
    other = docs.where(original)
    columns = ", ".join(f"coalesce(o.{c}, d.{c}) AS {c}" for c in OF_TEXT.values())
    return spark.sql(VIEWS["fx_content"].replace("coalesce(o.text, d.text) AS text", columns).replace("documents d", "{docs} d").replace("documents o", "{other} o"), docs=docs, other=other)


def view_of_hashes(spark: SparkSession, sf_dir: str, name: str, content: DataFrame) -> DataFrame:
    """The view fx_catalog or fx_inventory over ``contents``."""
    sql = VIEWS[name].replace("size, text,", f"size, {', '.join(OF_TEXT.values())},")
    for of, column in OF_TEXT.items():
        sql = sql.replace(of, column)
    args = {"fx_content": content, "benchmark": hashed(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))}
    used = {t: df for t, df in args.items() if re.search(rf"\bFROM {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **used)
