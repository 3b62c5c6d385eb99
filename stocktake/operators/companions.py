"""Companion packs: item files with audio tracks beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import COMPANIONS, extension, file_name, folder, stem

PACK_ITEMS = ("sfc", "smc", "swc", "fig")


def pack_base(path: Column) -> Column:
    """The name that a pack's files share: lower case, underscores as spaces, a track without its number."""
    base = F.lower(stem(path))
    return F.regexp_replace(F.when(extension(path) == "pcm", F.regexp_replace(base, "-[0-9]*$", "")).otherwise(base), "_", " ")


def bucket_keys(files: DataFrame) -> DataFrame:
    """``files`` with bucket: the path, or in a folder that holds a pack its folder, or folder and base where several items share it."""
    ext, up = extension(F.col("path")), folder(F.col("path"))
    own = files.withColumns({"__folder": up, "__base": pack_base(F.col("path")), "__ext": ext})
    packs = own.groupBy("__folder").agg(F.bool_or(F.col("__ext").isin("msu", "pcm")).alias("__pack"), F.count_distinct(F.when(F.col("__ext").isin(*PACK_ITEMS), F.col("__base"))).alias("__items")).where("__pack")
    out = own.join(packs, "__folder", "left")
    member = F.coalesce("__pack", F.lit(False)) & F.col("__ext").isin(*PACK_ITEMS, *COMPANIONS)
    key = F.when(~member, F.col("path")).when(F.col("__items") <= 1, F.concat(F.lit("pack-folder|"), "__folder")).otherwise(F.concat_ws("|", F.lit("pack-item"), "__folder", "__base"))
    return out.withColumn("bucket", key).select(*files.columns, "bucket")


def track_counts(files: DataFrame) -> DataFrame:
    """(path, tracks) of item files: the tracks of their base in their folder."""
    ext = extension(F.col("path"))
    own = files.select("path", folder(F.col("path")).alias("folder"), pack_base(F.col("path")).alias("base"), ext.alias("ext"))
    tracks = own.where("ext = 'pcm'").groupBy("folder", "base").agg(F.count("*").alias("tracks"))
    return own.where(F.col("ext").isin(*PACK_ITEMS)).join(tracks, ["folder", "base"], "left").select("path", F.coalesce("tracks", F.lit(0)).alias("tracks"))


def bucket_name(bucket: Column) -> Column:
    return F.when(bucket.startswith("pack-folder|"), file_name(bucket)).when(bucket.startswith("pack-item|"), F.element_at(F.split(bucket, r"\|"), -1)).otherwise(file_name(bucket))


def unexplained(left: DataFrame) -> DataFrame:
    """Leftovers that count: unknown companion files don't."""
    return left.where(~(extension(F.col("path")).isin(*COMPANIONS) & F.col("owner").isNull()))
