"""Set layouts: which items a set's container holds.

sets: set_name, clone_of, rom_of, is_bios, is_device, refs (array of component names), and set_ord where the catalog's order is not that of names.
items: set_name, item_ord, item_name, size, crc32, merge_name. A set whose chain of parents has an unknown name or a cycle has no layout that needs the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .families import walks

MODES = ("split", "non-merged", "merged")
OUT = ("set_name", "item_name", "size", "crc32", "item_ord")


def first_of(df: DataFrame, key: list[str], *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank = 1").drop("rank")


def split(items: DataFrame) -> DataFrame:
    """Own items that merge with none, distinct by name, checksum and size."""
    return first_of(items.where("merge_name IS NULL"), ["set_name", "item_name", "crc32", "size"], "item_ord").select(*OUT)


def chains(sets: DataFrame) -> DataFrame:
    """(set_name, machine, depth, is_bios): each set and all above it along rom_of, depth 0 being the set; only sets whose chain ends in a root."""
    up = walks(sets).where("end = 'root'")
    each = up.select("set_name", F.posexplode(F.array_insert("above", 1, F.col("set_name"))).alias("depth", "machine"))
    return cut(each.join(sets.select(F.col("set_name").alias("machine"), F.coalesce("is_bios", F.lit(False)).alias("is_bios")), "machine").select("set_name", "machine", "depth", "is_bios"))


def component_order(sets: DataFrame, chain: DataFrame) -> DataFrame:
    """(set_name, component, path): the components that the sets of a chain refer to, directly or through others, each once; paths order them as a walk in depth meets them first.

    A path holds the place in the chain, from the root on, and then the number of each reference. The least path to a component counts; a round follows the references of those whose path
    got less, so rounds grow with the depth of references, and rows with the pairs that a layout asks for. (Where references form a circle, a walk may
    come to a component on another path; its items are the same, only which of two circular components' items of one name is the last may differ.)
    """
    refs = cut(sets.select(F.col("set_name").alias("machine"), F.posexplode("refs").alias("k", "component")))
    least = lambda df: df.groupBy("set_name", "component").agg(F.min("path").alias("path"))
    start = chain.where("NOT is_bios OR depth = 0").join(refs, "machine")
    state = fresh = cut(least(start.select("set_name", "component", F.array(-F.col("depth"), "k").alias("path"))))
    onward = refs.select(F.col("machine").alias("component"), F.col("component").alias("next"), "k")
    while not fresh.isEmpty():
        reached = least(fresh.join(onward, "component").select("set_name", F.col("next").alias("component"), F.array_append("path", F.col("k")).alias("path")))
        known = state.withColumnRenamed("path", "known")
        fresh = cut(reached.join(known, ["set_name", "component"], "left").where(F.col("known").isNull() | (F.col("path") < F.col("known"))).drop("known"))
        state = cut(state.join(fresh.select("set_name", "component"), ["set_name", "component"], "left_anti").unionByName(fresh))
    return state


def non_merged(sets: DataFrame, items: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """All that a set needs but its base sets' items.

    Own items that merge with none; those that do as the nearest ancestor (no base set) spells them that has an unmerged item of that name, none if there is no such ancestor; and
    the items of all components of the set and its chain. Of one name the last in this order counts: a component's beats an own one, a later component's an earlier one's.
    """
    chain = chains(sets) if chain is None else chain
    known = chain.where("depth = 0").select("set_name")
    held = items.where("merge_name IS NULL").groupBy(F.col("set_name").alias("machine"), F.col("item_name").alias("merge_name")).agg(F.max_by(F.struct("size", "crc32"), "item_ord").alias("i"))
    above = chain.where("depth > 0 AND NOT is_bios").select("set_name", "machine", "depth")
    tagged = items.where("merge_name IS NOT NULL").select("set_name", "item_ord", "merge_name").join(above, "set_name").join(held, ["machine", "merge_name"])
    tagged = tagged.groupBy("set_name", "item_ord", "merge_name").agg(F.min_by("i", "depth").alias("i"))
    none = F.array().cast("array<int>")
    own = items.where("merge_name IS NULL").join(known, "set_name", "left_semi").select(*OUT, none.alias("path"))
    rows = own.unionByName(tagged.select("set_name", F.col("merge_name").alias("item_name"), "i.size", "i.crc32", "item_ord", none.alias("path")))
    parts = component_order(sets, chain).join(items.withColumnRenamed("set_name", "component"), "component").select(*OUT, "path")
    last = rows.unionByName(parts).groupBy("set_name", "item_name").agg(F.max_by(F.struct("size", "crc32", "item_ord"), F.struct("path", "item_ord")).alias("i"))
    return last.select("set_name", "item_name", "i.size", "i.crc32", "i.item_ord")


def merged(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Each parent with its direct variants' unmerged items: what equals the first owner's item of that name once, other contents of a name as ``variant/name``; an item that a parent repeats in a row counts once."""
    order = "set_ord" if "set_ord" in sets.columns else "set_name"
    parents = sets.where("clone_of IS NULL").select(F.col("set_name").alias("parent"))
    fam = sets.select("set_name", F.coalesce("clone_of", "set_name").alias("parent"), F.col("clone_of").isNotNull().alias("variant"), F.col(order).alias("ord")).join(parents, "parent")
    rows = items.where("merge_name IS NULL").join(fam, "set_name").withColumn("same", F.struct("size", "crc32"))
    own = rows.where("NOT variant").withColumn("before", F.lag("same").over(Window.partitionBy("parent", "item_name").orderBy("item_ord")))
    own = own.where("before IS NULL OR NOT (before <=> same)").drop("before")
    far = rows.where("variant")
    first = own.groupBy("parent", "item_name").agg(F.max_by("same", "item_ord").alias("held"))
    begins = far.groupBy("parent", "item_name").agg(F.min(F.struct("ord", "set_name", "item_ord")).alias("b"), F.min_by("same", F.struct("ord", "set_name", "item_ord")).alias("lead"))
    met = far.join(begins, ["parent", "item_name"]).join(first, ["parent", "item_name"], "left")
    leads = F.col("held").isNull() & (F.struct("ord", "set_name", "item_ord") == F.col("b"))
    met = met.where(leads | ~F.coalesce("held", "lead").eqNullSafe(F.col("same"))).withColumn("shown", F.when(leads, F.col("item_name")).otherwise(F.concat("set_name", F.lit("/"), "item_name")))
    both = own.withColumn("shown", F.col("item_name")).select("parent", "shown", "size", "crc32", "item_ord").unionByName(met.select("parent", "shown", "size", "crc32", "item_ord"))
    return both.select(F.col("parent").alias("set_name"), F.col("shown").alias("item_name"), "size", "crc32", "item_ord")


def fold_bases(layout: DataFrame, sets: DataFrame, items: DataFrame, mode: str, chain: DataFrame | None = None) -> DataFrame:
    """``layout`` of ``sets`` with the items of all base sets of their chains: for no set (split), every set (non-merged) or parents only (merged); names that are there win, then the base nearest to the root."""
    if mode == "split":
        return layout
    chain = chains(sets) if chain is None else chain
    asked = sets.select("set_name") if mode == "non-merged" else sets.where("clone_of IS NULL").select("set_name")
    lost = asked.join(chain.where("depth = 0").select("set_name"), "set_name", "left_anti")
    layout = layout.join(lost, "set_name", "left_anti")
    extra = chain.where("is_bios").join(asked, "set_name", "left_semi").join(items.withColumnRenamed("set_name", "machine"), "machine")
    extra = first_of(extra, ["set_name", "item_name"], F.desc("depth"), "item_ord").join(layout.select("set_name", "item_name"), ["set_name", "item_name"], "left_anti")
    return layout.unionByName(extra.select(*OUT))


def build_layout(sets: DataFrame, items: DataFrame, mode: str, base_mode: str = "split") -> DataFrame:
    """Every set's items in one of the modes split, non-merged, merged; in the last one variants are no sets of their own."""
    if mode not in MODES or base_mode not in MODES:
        raise ValueError(f"{mode!r} and {base_mode!r} must be of {', '.join(MODES)}")
    chain = chains(sets) if mode == "non-merged" or base_mode != "split" else None
    rows = {"split": lambda: split(items), "non-merged": lambda: non_merged(sets, items, chain), "merged": lambda: merged(sets, items)}[mode]()
    targets = sets.where("clone_of IS NULL") if mode == "merged" else sets
    if base_mode == "split":
        return rows
    # Chains reach sets that are no targets; only those of targets are asked for.
    return fold_bases(rows, targets, items, base_mode, chain)


def merged_disks(sets: DataFrame, disks: DataFrame) -> DataFrame:
    """Disks of a merged set: those of the parent and its variants, distinct by name and hash."""
    fam = sets.select("set_name", F.coalesce("clone_of", "set_name").alias("parent"))
    return disks.join(fam, "set_name").select(F.col("parent").alias("set_name"), "disk_name", "sha1").distinct()
