"""The same set in several roots, and donors of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import under

ITEM = ("set_ord", "item_ord")
#: So many roots are tried one after the other within an expression; more are met by their names.
FEW_ROOTS = 200


def root_of(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``df`` with root and root_ord: the configured root that its path lies under, the most specific one; null under none. One row for each row."""
    roots, keep = roots.select("root", "root_ord").dropDuplicates(["root"]), [c for c in df.columns if c not in ("root", "root_ord")]
    few = roots.limit(FEW_ROOTS + 1).collect()
    if len(few) <= FEW_ROOTS:
        pick = None
        for r in sorted(few, key=lambda r: -len(r["root"])):
            here = under(F.col("path"), F.lit(r["root"]))
            value = F.struct(F.lit(r["root"]).alias("root"), F.lit(r["root_ord"]).cast(roots.schema["root_ord"].dataType).alias("root_ord"))
            pick = F.when(here, value) if pick is None else pick.when(here, value)
        none = F.lit(None).cast(f"struct<root:string,root_ord:{roots.schema['root_ord'].dataType.simpleString()}>")
        return df.select(*keep).withColumn("__r", pick if pick is not None else none).select(*keep, "__r.root", "__r.root_ord")
    paths = df.select("path").distinct()
    parts = F.split(F.regexp_replace("path", "::", "/"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = paths.withColumn("root", F.explode(above)).join(roots, "root").groupBy("path").agg(F.max_by(F.struct("root", "root_ord"), F.length("root")).alias("__r"))
    return df.select(*keep).join(met, "path", "left").select(*keep, "__r.root", "__r.root_ord")


def duplicate_sets(files: DataFrame, roots: DataFrame, recent: tuple[str, ...] = ()) -> DataFrame:
    """(set_lc, root, path, primary_root): one row for each further root that has a container of a set's name; the first root not just rescanned is primary."""
    from ..functions.paths import stem

    placed = root_of(files.select("path").distinct(), roots).where("root IS NOT NULL").withColumn("set_lc", F.lower(stem(F.col("path"))))
    one = placed.groupBy("set_lc", "root", "root_ord").agg(F.min("path").alias("path"))
    late = F.col("root").isin(*recent) if recent else F.lit(False)
    w = Window.partitionBy("set_lc").orderBy(late, "root_ord")
    ranked = one.withColumns({"rank": F.row_number().over(w), "primary_root": F.first("root").over(w)})
    return ranked.where("rank > 1").select("set_lc", "root", "path", "primary_root")


def system_copies(left: DataFrame, audit: DataFrame) -> DataFrame:
    """(path, owner): leftovers that a present set owns and that no audit row names, one row for each path."""
    present = audit.where("set_name IS NOT NULL AND status <> 'missing'").select(F.lower("set_name").alias("lc")).distinct()
    listed = audit.where("path IS NOT NULL AND set_name IS NOT NULL").select("path").distinct()
    own = left.where("owner IS NOT NULL").withColumn("lc", F.lower("owner")).join(present, "lc", "left_semi").join(listed, "path", "left_anti")
    return own.groupBy("path").agg(F.min("owner").alias("owner"))


def with_duplicates(audit: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``audit`` with a row of status duplicateSet for each further place of a set; its counters then count them."""
    names = audit.select("set_name").where("set_name IS NOT NULL").groupBy(F.lower("set_name").alias("set_lc")).agg(F.min("set_name").alias("set_name"))
    rows = duplicates.join(names, "set_lc").select("set_name", "path", F.lit("duplicateSet").alias("status"))
    return audit.unionByName(rows, allowMissingColumns=True)


def shares_hash(hashes: tuple[str, ...], prefix: str) -> Column:
    """Whether two rows have any hash in common; kinds don't mix and absent hashes match nothing."""
    tagged = lambda before: F.array_compact(F.array(*[F.when(F.col(before + h).isNotNull(), F.concat(F.lit(f"{h}:"), F.lower(before + h))) for h in hashes]))
    return F.arrays_overlap(tagged(""), tagged(prefix))


def donors(wanted: DataFrame, pool: DataFrame) -> DataFrame:
    """(set_ord, item_ord, donor_path, donor_entry): a file of equal size whose first hash that both sides have is equal; no shared hash is no donor."""
    from .match import shared_hashes

    hashes = shared_hashes(wanted, pool)
    kinds = [F.col("size"), *[F.col(h) for h in hashes]]
    # Contents meet contents: of files of one content the first is the donor.
    right = pool.groupBy(*kinds).agg(F.min(F.struct("path", "entry_name")).alias("d")).select("d", F.col("size").alias("d_size"), *[F.col(h).alias(f"d_{h}") for h in hashes])
    same = F.coalesce(*[F.when(F.col(h).isNotNull() & F.col(f"d_{h}").isNotNull(), F.col(h) == F.col(f"d_{h}")) for h in hashes], F.lit(False))
    met = None
    for h in hashes:
        part = wanted.join(right, (F.col("size") == F.col("d_size")) & (F.col(h) == F.col(f"d_{h}"))).where(same)
        met = part if met is None else met.unionByName(part)
    return met.groupBy(*ITEM).agg(F.min("d").alias("d")).select(*ITEM, F.col("d.path").alias("donor_path"), F.col("d.entry_name").alias("donor_entry"))


def with_donor_flag(audit: DataFrame, donor_items: DataFrame) -> DataFrame:
    """``audit`` (with set_ord, item_ord and set_name) with donor_available, only in sets that have an anchor: a matched row."""
    anchor = audit.where("status = 'correct'").select("set_name").distinct().withColumn("anchor", F.lit(True))
    have = donor_items.select(*ITEM).distinct().withColumn("donor", F.lit(True))
    out = audit.join(anchor, "set_name", "left").join(have, list(ITEM), "left")
    return out.withColumn("donor_available", F.coalesce(F.col("anchor") & F.col("donor") & (F.col("status") != "correct"), F.lit(False))).drop("anchor", "donor")


def sibling_donors(items: DataFrame, families: DataFrame) -> DataFrame:
    """(set_ord, item_ord, sibling_set, sibling_item): the first item of equal content in another set of the family.

    Of a family's content the first item and the first one of another set are enough for all its items, so a content that many sets share makes no pairs.
    """
    fam = families.select("set_name", F.coalesce("clone_of", "set_name").alias("family"))
    own = items.where("md5 IS NOT NULL").join(fam, "set_name").select("family", "set_name", *ITEM, "size", "md5")
    per_set = own.groupBy("family", "size", "md5", "set_name").agg(F.min(F.struct(*ITEM)).alias("at"))
    w = Window.partitionBy("family", "size", "md5").orderBy("at")
    two = per_set.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("family", "size", "md5").pivot("r", [1, 2]).agg(F.first(F.struct("set_name", "at")))
    met = own.join(two.where(F.col("2").isNotNull()), ["family", "size", "md5"])
    other = F.when(F.col("1.set_name") != F.col("set_name"), F.col("1.at")).otherwise(F.col("2.at"))
    return met.select(*ITEM, other.alias("o")).select(*ITEM, F.col("o.set_ord").alias("sibling_set"), F.col("o.item_ord").alias("sibling_item"))


def parent_has(items: DataFrame, families: DataFrame) -> DataFrame:
    """(set_ord, item_ord) of items of variants whose content the parent declares too."""
    parent = families.where("clone_of IS NOT NULL").select("set_name", "clone_of")
    content = items.where("md5 IS NOT NULL").select(F.col("set_name").alias("clone_of"), "size", "md5")
    return items.join(parent, "set_name").join(content, ["clone_of", "size", "md5"], "left_semi").select(*ITEM)
