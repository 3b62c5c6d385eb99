"""Parents and variants, base sets, component references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import REGION_ORDER, region_rank
from ..lineage import cut


def family(prefix: str = ""):
    return F.coalesce(F.col(f"{prefix}clone_of"), F.col(f"{prefix}set_name"))


def one_per_family(sets: DataFrame, order: Sequence[str] = REGION_ORDER) -> DataFrame:
    """(set_name, family, preferred, hidden) for families of several members: the best region wins, then the name; sets without a known region stay."""
    w = Window.partitionBy("family")
    ranked = sets.select("set_name", family().alias("family"), region_rank(F.col("description"), order).alias("rank"))
    ranked = ranked.withColumns({"members": F.count("*").over(w), "best": F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "set_name"))).over(w)}).where("members > 1")
    best = F.coalesce(F.col("best.set_name") == F.col("set_name"), F.lit(False))
    return ranked.select("set_name", "family", best.alias("preferred"), (F.col("rank").isNotNull() & ~best).alias("hidden"))


def parent_summary(sets: DataFrame, status: DataFrame) -> DataFrame:
    """(parent, variants, present, orphans): variants of each parent, those present, and, if the parent is absent, how many of these lack it.

    A set is absent when its status is missing or it has no row.
    """
    here = status.where("status <> 'missing'").select(F.col("set_name").alias("here")).distinct()
    variants = sets.where("clone_of IS NOT NULL").join(here, F.col("set_name") == F.col("here"), "left").select(F.col("clone_of").alias("parent"), F.col("here").isNotNull().alias("present"))
    parents = here.select(F.col("here").alias("parent"), F.lit(True).alias("has_parent"))
    out = variants.groupBy("parent").agg(F.count("*").alias("variants"), F.count_if("present").alias("present")).join(parents, "parent", "left")
    return out.select("parent", "variants", "present", F.when(F.col("has_parent"), 0).otherwise(F.col("present")).cast("long").alias("orphans"))


def walks(sets: DataFrame) -> DataFrame:
    """(set_name, above, end): the distinct names along rom_of, nearest first, and how the walk ends: root, unknown (its last name isn't in the catalog) or cycle.

    Pointer doubling: each round joins a walk with the walk of its last name, so rounds grow with the logarithm of the depth.
    A walk that meets a name again is a cycle; the distinct names in walking order are all that it reaches.
    """
    at = F.col("rom_of").cast("string")
    end = F.when(at.isNull(), "root").when(at == F.col("set_name"), "cycle")
    state = cut(sets.select("set_name", at.alias("up"), F.when(at.isNull(), F.array().cast("array<string>")).otherwise(F.array(at)).alias("above"), end.alias("end")))
    while not state.where("end IS NULL").isEmpty():
        onward = state.select(F.col("set_name").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"), F.coalesce("end", F.lit("open")).alias("after"))
        open_ = state.where("end IS NULL").drop("end").join(onward, "up", "left").withColumn("far", F.concat("above", F.coalesce("more", F.array().cast("array<string>"))))
        open_ = open_.withColumn("once", F.array_distinct("far")).withColumn("again", (F.size("once") < F.size("far")) | F.array_contains("far", F.col("set_name")))
        end = F.when(F.col("after").isNull(), "unknown").when(F.col("again"), "cycle").when(F.col("after") != "open", F.col("after"))
        moved = open_.select("set_name", F.coalesce("next", "up").alias("up"), F.col("once").alias("above"), end.alias("end"))
        state = cut(state.where("end IS NOT NULL").unionByName(moved))
    return state.select("set_name", "above", "end")


def ancestor_chain(sets: DataFrame) -> DataFrame:
    """(set_name, ancestor, depth) along rom_of, each ancestor once; a parent that isn't in the catalog ends the chain."""
    return walks(sets).select("set_name", F.posexplode("above").alias("depth", "ancestor")).select("set_name", "ancestor", (F.col("depth") + 1).alias("depth"))


def base_ancestor(sets: DataFrame) -> DataFrame:
    """(set_name, base): the nearest ancestor that is a base set. Pointer doubling, without the ancestors between."""
    bases = sets.where("is_bios").select(F.col("set_name").alias("up"), F.col("set_name").alias("base")).distinct()
    state = cut(sets.where("rom_of IS NOT NULL").select("set_name", F.col("rom_of").alias("up")).join(bases, "up", "left"))
    reach, n = 1, state.count()
    # A walk of more steps than there are sets with a parent goes round in a cycle without a base set.
    while reach <= n and not state.where("base IS NULL AND up IS NOT NULL").isEmpty():
        onward = state.select(F.col("set_name").alias("up"), F.col("up").alias("next"), F.col("base").alias("later"))
        moved = state.where("base IS NULL AND up IS NOT NULL").select("set_name", "up").join(onward, "up", "left").select("set_name", F.col("next").alias("up"), F.col("later").alias("base"))
        state, reach = cut(state.where("base IS NOT NULL OR up IS NULL").select("set_name", "up", "base").unionByName(moved)), reach * 2
    return state.where("base IS NOT NULL").select("set_name", "base")


def dependency_chain(sets: DataFrame) -> DataFrame:
    """(set_name, chain, error): names from the root to the set; an unknown name or a cycle is an error. A cycle's chain has each name once."""
    above = F.reverse(F.array_remove("above", F.col("set_name")))
    return walks(sets).select("set_name", F.array_join(F.array_append(above, F.col("set_name")), ">").alias("chain"), F.when(F.col("end") != "root", F.col("end")).alias("error"))


#: Components that lie so many references deep are followed one by one, deeper ones by doubling.
LEVELS = 32
#: After so many levels a pair that was reached before is left out: references that go round end there.
LOOKS_BACK = (8, 24)


def together(levels: Sequence[DataFrame]) -> DataFrame:
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): everything that component references reach, each once.

    What is reached by one more reference comes from what was reached last, so each pair is made from its references, not from all pairs with a node between. Where new pairs are
    left after ``LEVELS`` they are followed by rounds that double the reach.
    """
    edges = cut(edges.select("src", "dst").distinct())
    before = edges.where("src <> dst").select(F.col("src").alias("first"), F.col("dst").alias("src"))
    level, levels = edges, [edges]
    while len(levels) < LEVELS:
        level = cut(before.join(level, "src").select(F.col("first").alias("src"), "dst").distinct())
        if len(levels) in LOOKS_BACK:
            level = cut(level.join(together(levels), ["src", "dst"], "left_anti"))
        if level.isEmpty():
            return together(levels).distinct()
        levels.append(level)
    reach = cut(together(levels).distinct())
    n = reach.count()
    while True:
        hop = reach.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
        wider = cut(reach.unionByName(reach.join(hop, F.col("dst") == F.col("mid")).select("src", F.col("far").alias("dst"))).distinct())
        now = wider.count()
        if now == n:
            return wider
        reach, n = wider, now


def notes_for(sets: DataFrame, notes: DataFrame, platform: str | None = None) -> DataFrame:
    """Each set's region note: the base title equals the note's family or an alternate title; overrides come first, disabled ones hide."""
    from ..functions.names import base_title

    titles = notes.withColumn("title", F.explode(F.array_union(F.array("family"), F.coalesce("alternate_titles", F.array().cast("array<string>"))))).where(F.col("platform").isNull() | (F.lit(platform).isNotNull() & (F.col("platform") == platform)))
    met = sets.select("set_name", base_title(F.col("set_name")).alias("title")).join(titles, "title")
    w = Window.partitionBy("set_name").orderBy(F.desc("is_override"), F.col("platform").isNull(), "family")
    return met.withColumn("rank", F.row_number().over(w)).where("rank = 1 AND NOT disabled").drop("rank", "title")


def base_of_family(sets: DataFrame) -> DataFrame:
    """Catalog facts: whether any set is a variant, and the distinct lower-cased names."""
    return sets.agg(F.bool_or(F.col("clone_of").isNotNull()).alias("has_clones"), F.count_distinct(F.lower("set_name")).alias("n_names"))
