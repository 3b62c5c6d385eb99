"""Merkle manifest of a dataset: one tree for each source over its rows, and one tree over the sources.

A row's digest is a leaf. Of a tree only every ``LEVELS``-th level is stored, as blocks: the nodes of one aligned subtree. A level
between two stored ones is made again when a proof needs it: a block's nodes are hashed up to the next stored level, the siblings of
each of its nodes are emitted, and what was hashed is forgotten. So storage is the leaves and about one in ``3 ** LEVELS`` of them, and building and proving
are one shuffle for each stored level. All of it is DataFrame functions.

Trees go by counts alone: every run of three consecutive nodes becomes the digest of their digests, the last run has what is left, and
a tree of one leaf is that leaf. Rows of a source ascend by id, rows of an id by leaf (equal rows are alike). A null id sorts
first, a null source is a source of its own and sorts first. An empty table has no rows, no proofs and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, join_hot, stored, table, tasks

ARITY = 3
#: A stored level and the next are so many levels apart.
LEVELS = 5
BLOCK = ARITY**LEVELS
#: Fixed values of the query: what a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length, so that no two rows of other values read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with idx (from 0 in the order within ``key``) and m (rows of the key).

    Rows are dealt by ranges of (key, order), so a frequent key spans many tasks; each task numbers its own, and a table of one row for each key and task adds what comes before.
    """
    spark = rows.sparkSession
    place = F.monotonically_increasing_id()
    dealt = stored(rows.repartitionByRange(tasks(spark), key, *order).sortWithinPartitions(key, *order).withColumns({"row_at": place, "task": F.spark_partition_id()}))
    each = dealt.groupBy(key, "task").agg(F.count("*").alias("n"), F.min("row_at").alias("first"))
    before = Window.partitionBy(key).orderBy("task")  # a row for each task at most
    each = each.select(key, "task", "n", F.col("first"), (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("m"))
    met = join_hot(dealt, each.select(key, "task", "n", "first", "before", "m"), [key, "task"], F.xxhash64(key, "row_at"))
    return met.withColumn("idx", F.col("row_at") - F.col("first") + F.col("before")).select(*rows.columns, "idx", "m")


def blocks(nodes: DataFrame) -> DataFrame:
    """(key, block, m, nodes): the nodes (key, idx, m, h, ...) of each aligned subtree in order, ``BLOCK`` at most."""
    rest = [c for c in nodes.columns if c not in ("key", "m")]
    node = F.struct("idx", *[c for c in rest if c != "idx"])
    return nodes.groupBy("key", F.expr(f"idx DIV {BLOCK}").alias("block")).agg(F.first("m").alias("m"), F.array_sort(F.collect_list(node), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("nodes"))


def height() -> Column:
    """Levels above a block's nodes up to the next stored one, or to the tree's top, in a level of m nodes."""
    return reduce(lambda a, b: a + b, [(F.col("m") > ARITY**k).cast("int") for k in range(LEVELS)])


def next_level(hashes: Column) -> Column:
    runs = F.sequence(F.lit(0), (F.ceil(F.size(hashes) / ARITY) - 1).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(hashes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def levels() -> Column:
    """The levels of a block that aren't stored, from its nodes on; each an array of digests."""
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height())
    return F.aggregate(steps, F.array(F.transform("nodes", lambda n: n["h"])), lambda found, _: F.concat(found, F.array(next_level(F.element_at(found, -1)))))


def others(run: Column, place: Column) -> Column:
    return F.filter(run, lambda _, i: i != place)


def siblings(at: Column) -> Column:
    """For each of a block's levels, the place of node ``at`` in its run and the run's other digests, left to right."""
    steps = []
    for k in range(LEVELS):
        place = F.pmod(F.floor(at / ARITY**k), F.lit(ARITY)).cast("int")
        run = F.slice(F.get("levels", F.lit(k)), (F.floor(at / ARITY ** (k + 1)) * ARITY + 1).cast("int"), F.lit(ARITY))
        steps.append(F.struct(place.alias("place"), others(run, place).alias("siblings")))
    return F.slice(F.array(*steps), F.lit(1), height())


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def up(h: Column, step: Column) -> Column:
        left, right = F.slice(step["siblings"], F.lit(1), step["place"]), F.slice(step["siblings"], step["place"] + 1, F.lit(ARITY))
        return digest(F.array_join(left, ""), h, F.array_join(right, ""))

    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)


@dataclass
class Forest:
    """Trees by key: ``kept`` are the stored levels, leaves first; ``tops`` (key, h) are the roots."""

    kept: list[DataFrame]
    tops: DataFrame

    @staticmethod
    def grow(nodes: DataFrame) -> Forest:
        kept = []
        while True:
            kept.append(stored(blocks(nodes)))
            tops = kept[-1].select("key", F.col("block").alias("idx"), F.ceil(F.col("m") / BLOCK).alias("m"), F.element_at(F.element_at(levels(), -1), 1).alias("h"))
            if (kept[-1].agg(F.max("m")).first()[0] or 0) <= BLOCK:
                return Forest(kept, tops.select("key", "h"))
            nodes = tops

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves' fields with key, idx and proof (place and siblings of each step, from the leaf up); ``above`` (key, proof, ...) is how each tree's top goes on, its other columns come along."""
        rest = [c for c in above.columns if c not in ("key", "proof")]
        above = above.withColumn("block", F.lit(0).cast("long"))
        for level in reversed(self.kept):
            # Blocks meet what leads on from their top; a block's rows are made in one task, of ``BLOCK`` nodes.
            met = level.join(above, ["key", "block"]).withColumn("levels", levels())
            node = F.explode(F.transform("nodes", lambda n: F.struct(n.alias("node"), F.concat(siblings(n["idx"] % BLOCK), F.col("proof")).alias("proof"))))
            found = met.select("key", *rest, node.alias("n")).select("key", *rest, "n.node.*", "n.proof")
            above = found.select("key", *rest, F.col("idx").alias("block"), "proof")
        return found


def manifest(docs: DataFrame, id_col: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, leaf, other_leaf, subroot, root, proof), one row for each row of ``docs``; other columns are ignored.

    ``changed`` gives columns of ``docs`` other values; other_leaf is the leaf that they would make, so ``fold(other_leaf, proof)``
    shows whether the change would be noticed. Without it other_leaf is the leaf. Any column may be null.
    """
    col = lambda c: F.col(f"`{c}`")
    other = leaf([(changed or {}).get(c, col(c)) for c in fields])
    key = F.when(col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), col(source).cast("string")))  # null first, then by bytes
    rows = docs.select(col(id_col).alias("id"), key.alias("key"), leaf([col(c) for c in fields]).alias("h"), other.alias("other"))
    trees = Forest.grow(numbered(rows, "key", ["id", "h"]))
    subroots = numbered(trees.tops.select(F.lit("").alias("key"), F.col("key").alias("source"), "h"), "key", ["source"])
    top = Forest.grow(subroots)
    empty = F.array().cast("array<struct<place:int,siblings:array<string>>>")
    lead = top.proofs(top.tops.select("key", empty.alias("proof"), F.col("h").alias("root")))
    lead = stored(lead.select(F.col("source").alias("key"), "proof", F.col("h").alias("subroot"), "root"))
    out = trees.proofs(lead)
    return out.select("id", F.when(F.col("key") != "0", F.substring("key", 2, 1 << 30)).alias("source"), F.col("h").alias("leaf"), F.col("other").alias("other_leaf"), "subroot", "root", "proof")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, changed={"text": text}).withColumn("folded_root", fold(F.col("other_leaf"), F.col("proof")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL spells out: trees of 3 ** 13 rows.
SQL_LEVELS = 13


def oracle() -> str:
    """The same by joins of whole levels, each spelt out."""
    text = f"CASE WHEN {crc32_sql('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    part = lambda v: f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    row = lambda text: " || ".join(part(v) for v in (*FIELDS[:-1], text))
    ctes = [
        f"r AS (SELECT doc_id, coalesce('1' || source, '0') AS key, sha256({row('text')}) AS h, sha256({row(f'({text})')}) AS other FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM r)",
    ]

    def tree(name: str, leaves: str) -> None:
        """CTEs of a tree's levels, each node's siblings and the tops."""
        ctes.append(f"{name}0 AS (SELECT key, idx, h, count(*) OVER (PARTITION BY key) AS m FROM {leaves})")
        for k in range(SQL_LEVELS):
            up = f"SELECT key, idx // 3 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, (any_value(m) + 2) // 3 AS m FROM {name}{k} WHERE m > 1 GROUP BY key, idx // 3"
            ctes.append(f"{name}{k + 1} AS ({up})")
            others = f"SELECT a.key, a.idx, string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx) AS l, string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx) AS r"
            ctes.append(f"{name}s{k} AS ({others} FROM {name}{k} a JOIN {name}{k} b ON a.key = b.key AND a.idx // 3 = b.idx // 3 WHERE a.m > 1 GROUP BY a.key, a.idx)")
        ctes.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT key, h FROM {name}{k} WHERE m = 1' for k in range(SQL_LEVELS + 1))})")

    def climb(name: str, start: str, ids: str) -> str:
        """CTEs from ``start`` (ids, key, idx, other, proof) to what its rows fold to."""
        for k in range(SQL_LEVELS):
            step = f"SELECT {ids}, s.key, s.idx, coalesce(proof || coalesce(l, '') || coalesce(r, ''), proof) AS proof, CASE WHEN o.key IS NULL THEN other ELSE sha256(coalesce(l, '') || other || coalesce(r, '')) END AS other"
            ctes.append(f"{name}c{k} AS ({step} FROM {start} s LEFT JOIN {name}s{k} o ON s.key = o.key AND s.idx // {3**k} = o.idx)")
            start = f"{name}c{k}"
        return start

    tree("t", "l")
    ctes.append("sub AS (SELECT '' AS key, key AS source, h, row_number() OVER (ORDER BY key) - 1 AS idx FROM ttop)")
    tree("u", "sub")
    ctes.append("p AS (SELECT doc_id, h AS leaf, key, idx, '' AS proof, other FROM l)")
    low = climb("t", "p", "doc_id, leaf")
    ctes.append(f"q AS (SELECT doc_id, leaf, s.h AS subroot, '' AS key, s.idx, proof, other FROM {low} c JOIN sub s ON c.key = s.source)")
    high = climb("u", "q", "doc_id, leaf, subroot")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, other AS folded_root, other = root AS verified FROM {high}, (SELECT h AS root FROM utop)"
