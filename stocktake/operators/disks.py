"""Disk items: matched by header hash, then by file stem."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_disks(disks: DataFrame) -> DataFrame:
    """One row for each disk name: one with a declared hash before one without, then the first."""
    w = Window.partitionBy("disk_name").orderBy(F.col("sha1").isNull(), "ord")
    return disks.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def match_disks(disks: DataFrame, files: DataFrame, prefer_subfolder: bool = False) -> DataFrame:
    """(disk_name, set_name, status, path): by hash correct, else by stem incorrect (unverifiable if no hash is declared), else missing.

    Of several files of one hash the first counts that lies outside a folder named like the disk, or with ``prefer_subfolder`` inside one; where there is none, the first of all.
    """
    wanted = distinct_disks(disks)
    inside = F.lower(F.element_at(F.split("path", "/"), -2))
    # Contents meet contents: of each hash and folder name the first file, so copies of one hash make no pairs.
    held = files.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min("path").alias("first"))
    by_folder = files.where("sha1 IS NOT NULL").groupBy("sha1", F.coalesce(inside, F.lit("")).alias("folder_lc")).agg(F.min("path").alias("path"))
    rank = F.row_number().over(Window.partitionBy("sha1").orderBy("path"))
    two = by_folder.withColumn("rank", rank).where("rank <= 2").groupBy("sha1").agg(F.min_by("folder_lc", "rank").alias("folder_1"), F.min("path").alias("path_1"), F.max_by("path", "rank").alias("path_2"))
    here = by_folder.withColumnsRenamed({"folder_lc": "disk_lc", "path": "inside_path"})
    met = wanted.withColumn("disk_lc", F.lower("disk_name")).join(held, "sha1", "left").join(here, ["sha1", "disk_lc"], "left").join(two, "sha1", "left")
    # Outside the disk's folder: the first file, or if that is in it, the first of the next folder.
    outside = F.when(F.col("folder_1") != F.col("disk_lc"), F.col("path_1")).when(F.col("path_2") != F.col("path_1"), F.col("path_2"))
    by_hash = F.coalesce(F.col("inside_path") if prefer_subfolder else outside, F.col("first"))
    by_stem = files.groupBy(F.col("stem").alias("disk_name")).agg(F.min("path").alias("stem_path"))
    out = met.withColumn("hash_path", by_hash).join(by_stem, "disk_name", "left")
    status = F.when(F.col("hash_path").isNotNull(), "correct").when(F.col("stem_path").isNotNull() & F.col("sha1").isNull(), "unverifiable").when(F.col("stem_path").isNotNull(), "incorrect").otherwise("missing")
    return out.select("disk_name", "set_name", status.alias("status"), F.coalesce("hash_path", "stem_path").alias("path"))


def leftover_disks(disks: DataFrame, files: DataFrame, prefer_subfolder: bool = False) -> DataFrame:
    """(path, owner, redundant): disk files that no disk took; owned by the first disk that declares their hash, which then has another file."""
    taken = match_disks(disks, files, prefer_subfolder).where("path IS NOT NULL").select("path")
    want = disks.where("sha1 IS NOT NULL").groupBy("sha1").agg(F.min_by("set_name", "ord").alias("owner"))
    return files.join(taken, "path", "left_anti").join(want, "sha1", "left").select("path", "owner", F.col("owner").isNotNull().alias("redundant"))


def with_disks(audit: DataFrame, matched: DataFrame) -> DataFrame:
    """``audit`` with a row for each matched disk; its counters then count them."""
    return audit.unionByName(matched.select("set_name", F.col("disk_name").alias("item_name"), "status", "path", F.lit(True).alias("is_disk"), F.lit(False).alias("is_optional")), allowMissingColumns=True)
