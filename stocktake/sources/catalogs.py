"""Catalog readers: three XML dialects to one schema, and small tables beside them.

The XML source splits a file on its row tag; sets and items keep their place in the file as set_ord and item_ord, by file
offset, so ties resolve as the file has them. Attributes have an underscore before their name. Types are given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROM = "struct<_name:string,_size:string,_crc:string,_md5:string,_sha1:string,_sha256:string,_status:string,_merge:string,_serial:string,_header:string,_optional:string>"
DISK = "struct<_name:string,_sha1:string,_optional:string>"
SET = f"""_name string, _id string, _cloneof string, _cloneofid string, _romof string, _sampleof string, _isbios string, _isdevice string, description string, year string, manufacturer string, category string,
rom array<{ROM}>, disk array<{DISK}>, biosset array<struct<_name:string>>, device_ref array<struct<_name:string>>, chip array<struct<_type:string,_name:string>>, sample array<struct<_name:string>>,
driver struct<_status:string>, display array<struct<_type:string,_rotate:string>>, input struct<_players:string,_coins:string>"""
AREA = f"array<struct<rom:array<{ROM}>>>"
SOFTWARE = f"_name string, _cloneof string, description string, year string, publisher string, part array<struct<_name:string,dataarea:{AREA},diskarea:array<struct<disk:array<{DISK}>>>>>"
DIALECTS = {"datafile": ("game", "machine"), "mame": ("machine",), "softwarelist": ("software",)}


def dialect(spark: SparkSession, path: str) -> str:
    """The dialect by the root element, read from the head of the file, however long its document type is; one error says what none of the three accepts."""
    import re

    head, lines, name, seen = "", 0, None, 1
    for row in spark.read.text(path).toLocalIterator():  # stops at the root
        head, lines = f"{head}{row[0]}\n", lines + 1
        if lines < seen:
            continue
        seen *= 2  # looked at again when it has doubled
        bare = re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", "", head, flags=re.S)
        if "<!" not in bare and (root := re.search(r"<([A-Za-z_][\w.-]*)", bare)):
            name = root[1]
            break
    else:
        root = re.search(r"<([A-Za-z_][\w.-]*)", re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(\[.*?\]\s*)?>", "", head, flags=re.S))
        name = root[1] if root else None
    if name not in DIALECTS:
        raise ValueError(f"{path}: the root is {name!r}; a data file begins with <datafile>, a machine list with <mame>, a software list with <softwarelist>")
    return name


def read_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.withColumn("place", F.monotonically_increasing_id())


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("yes", "1", "true"), F.lit(False))


def ordered(rows: DataFrame) -> DataFrame:
    """set_ord from the place in the file: places grow with the split and the row in it."""
    return rows.withColumnRenamed("place", "set_ord")


def read_sets(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """One row for each set of a catalog of any dialect: attributes, and its items and disks as arrays."""
    kind = kind or dialect(spark, path)
    if kind == "softwarelist":
        rows = ordered(read_rows(spark, path, "software", SOFTWARE))
        items = F.flatten(F.flatten(F.transform("part", lambda p: F.transform(F.coalesce(p["dataarea"], F.array().cast(AREA)), lambda a: F.coalesce(a["rom"], F.array().cast(f"array<{ROM}>"))))))
        disks = F.flatten(F.flatten(F.transform("part", lambda p: F.transform(F.coalesce(p["diskarea"], F.array().cast(f"array<struct<disk:array<{DISK}>>>")), lambda a: F.coalesce(a["disk"], F.array().cast(f"array<{DISK}>"))))))
        return rows.select(F.col("_name").alias("set_name"), "set_ord", "description", F.col("_cloneof").alias("clone_of"), F.lit(None).cast("string").alias("rom_of"), F.lit(False).alias("is_bios"), F.lit(False).alias("is_device"), "year", F.col("publisher").alias("manufacturer"), F.lit(None).cast("string").alias("category"), F.array().cast("array<string>").alias("refs"), F.lit(False).alias("has_samples"), items.alias("items"), disks.alias("disks"))
    rows, tags = None, DIALECTS[kind]
    for i, tag in enumerate(tags):
        # Each tag is a read of its own that counts its own places; interleaved, they stay apart.
        part = read_rows(spark, path, tag, SET).withColumn("place", F.col("place") * len(tags) + i)
        rows = part if rows is None else rows.unionByName(part)
    rows = ordered(rows)
    ids = rows.where("_id IS NOT NULL").select(F.col("_id").alias("parent_id"), F.col("_name").alias("parent_name"))
    rows = rows.join(ids, (F.col("_cloneofid") == F.col("parent_id")) & (F.col("parent_name") != F.col("_name")), "left")
    clone = F.coalesce("_cloneof", "parent_name")
    return rows.select(
        F.col("_name").alias("set_name"), "set_ord", "description", F.when(clone != F.col("_name"), clone).alias("clone_of"), F.when(F.col("_romof") != F.col("_name"), F.col("_romof")).alias("rom_of"), yes(F.col("_isbios")).alias("is_bios"), yes(F.col("_isdevice")).alias("is_device"), "year", "manufacturer", "category",
        F.coalesce(F.col("device_ref._name"), F.array().cast("array<string>")).alias("refs"), (F.coalesce(F.size("sample"), F.lit(0)) > 0).alias("has_samples"), F.coalesce("rom", F.array().cast(f"array<{ROM}>")).alias("items"), F.coalesce("disk", F.array().cast(f"array<{DISK}>")).alias("disks"),
    )


def catalog_items(sets: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each item: hashes lower-cased, an empty size 0, an unknown status good. Items without a name or a size are left out, or an error where ``strict``."""
    rows = sets.select("set_name", "set_ord", F.posexplode_outer("items").alias("item_ord", "r")).where("r IS NOT NULL")
    whole = F.col("r._name").isNotNull() & F.col("r._size").isNotNull()
    if strict:
        whole = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("an item without a name or a size in the set "), "set_name")).cast("boolean"))
    rows = rows.where(whole)
    low = lambda n: F.when(F.trim(f"r._{n}") != "", F.lower(F.trim(f"r._{n}"))).alias({"crc": "crc32"}.get(n, n))
    size = F.when(F.trim("r._size") == "", F.lit(0)).otherwise(F.trim("r._size").try_cast("long"))
    status = F.when(F.lower("r._status").isin("baddump", "nodump"), F.lower("r._status")).otherwise("good")
    return rows.select("set_name", "set_ord", F.col("item_ord").cast("long").alias("item_ord"), F.col("r._name").alias("item_name"), size.alias("size"), *[low(n) for n in ("crc", "md5", "sha1", "sha256")], status.alias("dump_status"), F.col("r._merge").alias("merge_name"), F.col("r._serial").alias("serial"), F.col("r._header").alias("header_hex"), yes(F.col("r._optional")).alias("optional")).where("size IS NOT NULL")


def catalog_disks(sets: DataFrame) -> DataFrame:
    rows = sets.select("set_name", "set_ord", F.posexplode_outer("disks").alias("ord", "r")).where("r._name IS NOT NULL")
    return rows.select("set_name", "set_ord", "ord", F.col("r._name").alias("disk_name"), F.lower("r._sha1").alias("sha1"), yes(F.col("r._optional")).alias("optional"))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, version, author, date) of a data file; no row without a header."""
    return spark.read.format("xml").option("rowTag", "header").schema("name string, description string, version string, author string, date string").load(path)


def catalog_names(sets: DataFrame) -> DataFrame:
    """(name_lc): all names that sets have, lower-cased."""
    return sets.select(F.lower("set_name").alias("name_lc")).where("name_lc IS NOT NULL").distinct()


def title_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of JSON objects of ids to names: one that fills a file, or one in each line."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\s*\z", "").alias("value"))
    many = F.when(F.from_json("value", "map<string,string>").isNull() | F.col("value").rlike(r"\}\s*\n\s*\{"), F.split("value", r"\n")).otherwise(F.array("value"))
    return rows.select(F.explode(many).alias("value")).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "name")).select(F.upper("id").alias("id"), "name")


def title_versions(spark: SparkSession, path: str) -> DataFrame:
    """(id, version) of lines ``id|rights|version``; other lines are left out."""
    parts = F.split("value", r"\|")
    return spark.read.text(path).where(F.size(parts) == 3).select(F.upper(F.trim(parts[0])).alias("id"), F.trim(parts[2]).try_cast("long").alias("version")).where("version IS NOT NULL")


def note_overrides(spark: SparkSession, path: str, platforms: list[str], most: int = 2000, longest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(valid notes, issues) of a JSON array of notes; rows after the first ``most`` and texts over ``longest`` characters are issues."""
    schema = "family string, platform string, alternate_titles array<string>, recommended_region string, reason string, disabled boolean"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{schema.replace(' string', ':string').replace(' array', ':array').replace(' boolean', ':boolean')}>>")).alias("row", "n")).select("row", "n.*")
    none = F.coalesce(F.trim("family"), F.lit("")) == ""
    issue = F.when(F.col("row") >= most, "too many rows").when(none, "no family").when(F.col("platform").isNotNull() & ~F.col("platform").isin(*platforms), "unknown platform").when(F.length("reason") > longest, "text too long")
    return rows.where(issue.isNull()).withColumn("disabled", F.coalesce("disabled", F.lit(False))), rows.withColumn("issue", issue).where("issue IS NOT NULL")


def fix_catalog(audit: DataFrame, items: DataFrame, path: str) -> None:
    """Missing and incorrect items as a catalog in XML, sets in catalog order; the writer escapes."""
    want = audit.where("status IN ('missing', 'incorrect') AND set_name IS NOT NULL").select("set_name", "item_name").distinct()
    rows = items.join(want, ["set_name", "item_name"])
    tags = {"item_name": "_name", "size": "_size", "crc32": "_crc", "md5": "_md5", "sha1": "_sha1", "dump_status": "_status"}
    tags = {c: t for c, t in tags.items() if c in rows.columns}
    value = lambda c: F.when(F.col(c) != "good", F.col(c)) if c == "dump_status" else F.col(c)
    rom = F.struct("item_ord", *[value(c).alias(t) for c, t in tags.items()])
    sets = rows.groupBy("set_ord", F.col("set_name").alias("_name")).agg(F.transform(F.array_sort(F.collect_list(rom)), lambda r: F.struct(*[r[t].alias(t) for t in tags.values()])).alias("rom"))
    sets.orderBy("set_ord").select("_name", "rom").write.format("xml").option("rowTag", "game").option("rootTag", "datafile").mode("overwrite").save(path)
