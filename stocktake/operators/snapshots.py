"""Snapshots of inventories and reports: what changed, what can be reused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import under
from ..lineage import cut


def diff(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, action, old and new values): insert, update, delete or same for every key; null values compare as values."""
    rest = [c for c in after.columns if c not in key]
    a = before.select(*key, F.struct(*rest).alias("old"))
    b = after.select(*key, F.struct(*rest).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("update")
    return a.join(b, list(key), "full_outer").withColumn("action", action)


def save_diff(changes: DataFrame, path: str, partition: str) -> None:
    """The new rows of the partitions that changed, as a new version of the stored table (``sources.versions``); other partitions stay where they are, one that lost all its rows goes."""
    from ..sources.versions import commit

    touched = cut(changes.where("action <> 'same'").select(partition).distinct())
    keys = [c for c in changes.columns if c not in ("old", "new", "action")]
    held = touched.withColumnRenamed(partition, "__touched")
    rows = changes.where("action <> 'delete'").join(held, F.col(partition).eqNullSafe(F.col("__touched")), "left_semi")
    commit(rows.select(*keys, "new.*"), path, partition, touched)


def changed_flag(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """``after`` with changed: false where ``before`` has a row of the same key and the same values."""
    rest = [c for c in after.columns if c not in key]
    tag = "__was"
    same = [F.col(k).eqNullSafe(F.col(f"{tag}_{k}")) for k in key]
    was = before.select(*[F.col(k).alias(f"{tag}_{k}") for k in key], F.struct(*rest).alias(tag)).dropDuplicates([f"{tag}_{k}" for k in key])
    out = after.join(was, same, "left")
    return out.select(*after.columns, (~F.coalesce(F.col(tag).eqNullSafe(F.struct(*rest)) & F.col(tag).isNotNull(), F.lit(False))).alias("changed"))


def newest(snapshot: DataFrame) -> DataFrame:
    """The newest row for each (path, entry_path): a snapshot that grows by appending keeps what a later run has superseded. Of equal times the largest row."""
    if "mtime" not in snapshot.columns:
        return snapshot
    rest = [c for c in snapshot.columns if c not in ("path", "mtime")]
    row = F.max(F.struct("mtime", *rest)).alias("r")
    return snapshot.groupBy("path", F.coalesce("entry_path", F.lit("")).alias("__e")).agg(row).select("path", "r.*").select(*snapshot.columns)


def remove(df: DataFrame, system: Column | None = None, paths: DataFrame | None = None, prefix: str | None = None) -> DataFrame:
    """Rows outside a system, outside exact paths, and outside a prefix (which ends at a path component)."""
    if system is not None:
        df = df.where(~F.coalesce(system, F.lit(False)))
    if paths is not None:
        df = df.join(paths.select("path").distinct(), "path", "left_anti")
    if prefix is not None:
        df = df.where(~F.coalesce(under(F.col("path"), F.lit(prefix.rstrip("/"))), F.lit(False)))
    return df


def same_time(a: Column, b: Column) -> Column:
    """Less than a millisecond apart; times with and without a zone alike."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) < 1000


def reuse(now: DataFrame, before: DataFrame, hashes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(known, to_hash): rows of ``now`` (path, entry_path, size, mtime) whose fingerprint ``before`` has, and the others.

    A row is known if size and time agree and all ``hashes`` are there; files whose layout must be normalised also need
    byte_order_checked. One entry of another time makes a whole container unknown. Of several rows of one file in ``before`` the newest counts.
    """
    old = newest(before).select("path", F.coalesce("entry_path", F.lit("")).alias("e"), F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), *[F.col(h).alias(f"o_{h}") for h in hashes], *(["byte_order_checked"] if "byte_order_checked" in before.columns else []))
    met = now.withColumn("e", F.coalesce("entry_path", F.lit(""))).join(old, ["path", "e"], "left")
    good = (F.col("size") == F.col("o_size")) & same_time(F.col("mtime"), F.col("o_mtime"))
    for h in hashes:
        good &= F.col(f"o_{h}").isNotNull()
    if "byte_order_checked" in old.columns:
        good &= ~F.lower("path").rlike(r"\.(n64|v64)$") | F.coalesce("byte_order_checked", F.lit(False))
    met = met.withColumn("good", F.coalesce(good, F.lit(False)))
    fresh = met.groupBy("path").agg(F.bool_and("good").alias("whole"))
    met = met.join(fresh, "path")
    known = met.where("whole").select(*now.columns, *[F.col(f"o_{h}").alias(h) for h in hashes])
    return known, met.where("NOT whole").select(*now.columns)


def carry_over(fresh: DataFrame, before: DataFrame, roots: Sequence[str]) -> DataFrame:
    """``fresh`` and the rows of ``before`` outside the rescanned roots; of equal (path, entry_name), the fresh one."""
    outside = before
    for root in roots:
        outside = outside.where(~under(F.col("path"), F.lit(root)))
    return fresh.unionByName(outside.join(fresh.select("path", "entry_name"), ["path", "entry_name"], "left_anti"))
