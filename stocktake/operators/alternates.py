"""Other ways for a name to meet a catalog: names alone, aliases, variants, serials, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.paths import extension, stem
from .match import FILE, ITEM, compatible, f_prefixed, shared_hashes, with_scope

#: Bytes that a header may add.
HEADER_SIZES = (0, 16, 64, 128, 512)


def match_names(items: DataFrame, files: DataFrame, with_size: bool = False) -> DataFrame:
    """(set_ord, item_ord, path, entry_name) of items whose name their set's container has, whatever the content; a verified entry wins.

    A set of one item trusts the only entry of its container. ``with_size`` asks for the size, give or take a header.
    """
    hashes = shared_hashes(items, files)
    wanted = [F.lower("set_name").alias("set_lc"), *ITEM, "item_name", "size", *hashes]
    scope = with_scope(files).where("NOT junk").select(*FILE, "stem_lc", "in_container", *f_prefixed(hashes))
    # A set of one item also takes loose files, and an entry that is alone: only such sets and their containers are counted.
    n = items.groupBy(F.lower("set_name").alias("set_lc")).agg(F.count("*").alias("n")).where("n = 1")
    one = items.select(*wanted).join(n.select("set_lc"), "set_lc", "left_semi")
    near = one.join(scope, F.col("set_lc") == F.col("stem_lc"))
    alone = near.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct(*[c for c in near.columns if c != "path"])).alias("f")).where("n = 1")
    single = alone.select("path", "f.*").where("item_name <> entry_name").unionByName(near.where("NOT in_container AND item_name = entry_name"))
    rows = items.select(*wanted).join(scope.where("in_container"), (F.col("set_lc") == F.col("stem_lc")) & (F.col("item_name") == F.col("entry_name"))).unionByName(single)
    if with_size:
        rows = rows.where((F.col("f_size") - F.col("size")).isin(*HEADER_SIZES))
    rows = rows.withColumn("fits", F.coalesce(compatible(hashes), F.lit(False)))
    # One file for each item at most; of those that fit, and else of all, the first.
    best = rows.groupBy(*ITEM).agg(F.min(F.when(F.col("fits"), F.struct(*FILE))).alias("fit"), F.min(F.struct(*FILE)).alias("any"))
    return best.select(*ITEM, F.coalesce("fit", "any").alias("f")).select(*ITEM, "f.*")


def match_aliases(local: DataFrame, catalog: DataFrame) -> DataFrame:
    """(local_name, set_name): short region tags spelled out, compared without punctuation; the catalog's first name of a key wins."""
    keys = catalog.groupBy(names.norm_key(F.col("set_name")).alias("key")).agg(F.min("set_name").alias("set_name"))
    asked = local.select("local_name", F.posexplode(names.aliases(F.col("local_name"))).alias("rank", "alias")).withColumn("key", names.norm_key(F.col("alias")))
    return asked.join(keys, "key").groupBy("local_name").agg(F.min_by("set_name", "rank").alias("set_name"))


def match_variants(local: DataFrame, catalog: DataFrame) -> DataFrame:
    """(local_name, set_name): equal without language groups, or with the revision's letter as a number, where the catalog has exactly one such name."""
    bare = lambda c: names.without_languages(F.coalesce(names.numeric_revision(F.col(c)), F.col(c)))
    one = catalog.groupBy(bare("set_name").alias("key")).agg(F.count("*").alias("n"), F.min("set_name").alias("set_name")).where("n = 1")
    return local.select("local_name", bare("local_name").alias("key")).join(one, "key").where("local_name <> set_name").select("local_name", "set_name")


def match_serials(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, entry_name, set_name): a leftover's serial, narrowed by image size, then to plain releases; only where one set is left."""
    # A serial that many sets share makes no pairs: its sets are counted by kind, and of each kind the first name is kept.
    plain = ~F.col("set_name").rlike(r"(?i)\((beta|proto|demo|kiosk|sample)")
    kinds = sets.where("serial IS NOT NULL").groupBy("serial", F.col("image_size").alias("s_size"), plain.alias("plain")).agg(F.count("*").alias("n"), F.min("set_name").alias("one"))
    told = lambda test, name: [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias(f"n_{name}"), F.min(F.when(test, F.col("one"))).alias(f"one_{name}")]
    both = lambda name: [*told(F.lit(True), name), *told(F.col("plain"), f"plain_{name}")]
    every = kinds.groupBy("serial").agg(*both("any"))
    sized = kinds.where("s_size IS NOT NULL").groupBy("serial", F.col("s_size").alias("image_size")).agg(*both("sized"))
    met = left.where("serial IS NOT NULL").select("path", "entry_name", "serial", "image_size").join(every, "serial").join(sized, ["serial", "image_size"], "left")
    steps = ("plain_sized", "sized", "plain_any", "any")
    met = met.groupBy("path", "entry_name").agg(*[x for k in steps for x in (F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}"), F.min(f"one_{k}").alias(f"one_{k}"))])
    pick = F.coalesce(*[F.when(F.col(f"n_{k}") > 0, F.struct(F.col(f"n_{k}").alias("n"), F.col(f"one_{k}").alias("one"))) for k in steps])
    return met.withColumn("p", pick).where("p.n = 1").select("path", "entry_name", F.col("p.one").alias("set_name"))


def sample_containers(sets: DataFrame, files: DataFrame) -> DataFrame:
    """(sample_set, path): for each distinct sample set that sets need, the first zip of that name."""
    need = sets.select(F.coalesce("sample_of", "set_name").alias("sample_set")).distinct()
    zips = files.where(extension(F.col("path")) == "zip").groupBy(F.lower(stem(F.col("path"))).alias("lc")).agg(F.min("path").alias("path"))
    return need.join(zips, F.lower("sample_set") == F.col("lc")).select("sample_set", "path")
