"""Titles: files grouped by the base id in their name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def title_files(files: DataFrame) -> DataFrame:
    """(file_name, tid, base_id, kind, version) of files that name a title id."""
    own = files.withColumn("tid", names.title_id(F.col("file_name")))
    return own.select("file_name", "tid", names.base_title_id(F.col("tid")).alias("base_id"), names.title_kind(F.col("tid")).alias("kind"), names.title_version(F.col("file_name")).alias("version"))


def title_sets(files: DataFrame, names_db: DataFrame | None = None) -> DataFrame:
    """(base_id, set_name, members): one set for each base id, named by the title table or the base's file, members base first, then updates, then extras. Of sets of one name in any case all but the first show their id."""
    rank = F.when(F.col("kind") == "base", 0).when(F.col("kind") == "update", 1).otherwise(2)
    own = title_files(files).where("tid IS NOT NULL")
    grouped = own.groupBy("base_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "file_name"))).alias("m"), F.min_by("file_name", F.struct(rank, "file_name")).alias("lead"))
    named = grouped.withColumn("from_file", names.clean_name(F.regexp_replace("lead", r"\s*[\[(].*$", "")))
    if names_db is not None:
        named = named.join(names_db.select(F.upper("id").alias("base_id"), names.clean_name(F.col("name")).alias("db_name")), "base_id", "left").withColumn("from_file", F.coalesce("db_name", "from_file")).drop("db_name")
    named = named.withColumn("from_file", F.when(F.col("from_file") == "", F.col("base_id")).otherwise(F.col("from_file")))
    twice = F.row_number().over(Window.partitionBy(F.lower("from_file")).orderBy("base_id")) > 1
    name = F.when(twice, F.concat("from_file", F.lit(" ["), "base_id", F.lit("]"))).otherwise(F.col("from_file"))
    return named.select("base_id", name.alias("set_name"), F.array_join(F.transform("m", lambda x: x["file_name"]), "|").alias("members"))


def unidentified(files: DataFrame) -> DataFrame:
    """(file_name) of files without a title id."""
    return files.where(names.title_id(F.col("file_name")).isNull()).select("file_name")


def title_items(files: DataFrame, versions: DataFrame, names_db: DataFrame | None = None) -> DataFrame:
    """(base_id, set_name, item_name, size, expected): the items of each title set, files (file_name, size) as they are, and where the title ``versions`` (id, version) know a newer update than all that a set has, that one, expected."""
    sets = title_sets(files, names_db).select("base_id", "set_name")
    own = title_files(files).where("tid IS NOT NULL").join(files.select("file_name", "size").distinct(), "file_name").select("base_id", "file_name", "size")
    update = F.col("id").endswith("800") & (F.col("version") > 0)
    newest = versions.withColumn("id", F.upper("id")).where(update).groupBy("id").agg(F.max("version").alias("newest"))
    newest = newest.withColumn("base_id", names.base_title_id(F.col("id")))
    have = title_files(files).where("kind = 'update'").groupBy("base_id").agg(F.max(F.coalesce("version", F.lit(0))).alias("held"))
    due = sets.join(newest, "base_id").join(have, "base_id", "left").where(F.col("newest") > F.coalesce("held", F.lit(-1)))
    expected = due.select("base_id", "set_name", F.concat("set_name", F.lit(" ["), "id", F.lit("][v"), F.col("newest").cast("string"), F.lit("].nsp")).alias("item_name"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("expected"))
    return sets.join(own, "base_id").select("base_id", "set_name", F.col("file_name").alias("item_name"), "size", F.lit(False).alias("expected")).unionByName(expected)


def title_summary(files: DataFrame) -> DataFrame:
    """(base_id, has_base, newest_update, extras) of each base id."""
    own = title_files(files).where("tid IS NOT NULL")
    return own.groupBy("base_id").agg(F.bool_or(F.col("kind") == "base").alias("has_base"), F.max(F.when(F.col("kind") == "update", F.col("version"))).alias("newest_update"), F.count_if(F.col("kind") == "dlc").alias("extras"))


def missing_updates(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Ids (id, version) of the newest known update of an owned base that no file has."""
    have = title_summary(files)
    newest = versions.groupBy(names.base_title_id(F.upper("id")).alias("base_id")).agg(F.max("version").alias("newest"))
    return newest.join(have, "base_id").where("newest > coalesce(newest_update, 0)").select("base_id", "newest")
