"""Reservation of targets: of all rows of a plan, or of several plans together, that want one place, one gets it, and only if the place is free by then.

Rows are those of ``changes``. A row that moves a file frees the file's place, so rows form chains (a to b, b to c) and circles (a to b, b to a). A chain is
granted from its free end on, and not at all if its end is occupied by a file that stays; a circle is granted by way of a temporary name. Places
are compared without regard to case, and a name that differs from the file's own by case alone is its own place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folder
from ..lineage import cut

COLUMNS = ("op", "group_id", "step", "source", "source_entry", "target", "target_entry")
MOVES = ("rename", "move")
REMOVALS = ("remove", "remove_container", "remove_disk")
#: An operation that writes over what it finds.
OVERWRITES = ("replace",)


def place(path: Column, entry: Column | None = None) -> Column:
    return F.lower(path) if entry is None else F.lower(F.concat(path, F.lit("::"), entry))


def places(files: DataFrame) -> DataFrame:
    """(place): all that ``files`` (path, entry_name) occupy, files and entries."""
    both = F.array(place(F.col("path")), place(F.col("path"), F.col("entry_name")))
    return files.select(F.explode(both).alias("place")).where("place IS NOT NULL").distinct()


def followed(links: DataFrame) -> DataFrame:
    """(node, ptr, ok, steps, least): where ``links`` (node, next, ok) lead; ok and the number of steps are those of the end, ptr is null but on a circle.

    A node has one next node at most and is next to one at most. Rounds double the reach; links longer than their number go round.
    """
    steps = F.col("next").isNotNull().cast("int")
    state = cut(links.select("node", F.col("next").alias("ptr"), "ok", steps.alias("steps"), F.col("node").alias("least")))
    reach, n = 1, state.where("ptr IS NOT NULL").count()
    while reach <= 2 * n and not state.where("ptr IS NOT NULL").isEmpty():
        onward = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("after"), F.col("ok").alias("ends"), F.col("steps").alias("more"), F.col("least").alias("low"))
        moved = state.where("ptr IS NOT NULL").join(onward, "ptr").select("node", F.col("after").alias("ptr"), F.col("ends").alias("ok"), (F.col("steps") + F.col("more")).alias("steps"), F.least("least", "low").alias("least"))
        state, reach = cut(state.where("ptr IS NULL").unionByName(moved)), reach * 2
    return state


def first_for(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the first row for each key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("n", F.struct("step", "op", "source", "source_entry", "group_id", "target", "target_entry")).alias("n"))


def with_circles_broken(links: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ok, turn) of all nodes, and (node, last) of those that go by a temporary name: at turn 0, and on to their target at ``last``."""
    straight = state.where("ptr IS NULL").select("node", "ok", F.col("steps").alias("turn"))
    round_ = state.where("ptr IS NOT NULL").select("node", "least")
    if round_.isEmpty():
        return straight, round_.select("node", F.lit(0).alias("last")).limit(0)
    ring = round_.join(links.select("node", "next"), "node")
    opened = ring.where("node <> least").select("node", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), F.when(F.col("next") == F.col("least"), True).alias("ok"))
    rest = followed(opened).select("node", F.lit(True).alias("ok"), (F.col("steps") + 1).alias("turn"))
    heads = ring.groupBy(F.col("least").alias("node")).agg(F.count("*").cast("int").alias("last"))
    return straight.unionByName(rest).unionByName(heads.select("node", F.lit(True).alias("ok"), F.lit(0).alias("turn"))), heads


def reserve(rows: DataFrame, occupied: DataFrame) -> DataFrame:
    """``rows`` (each once) with turn, the order in which they can be carried out, refused: null, or why a row may not be, and temporary: the target is a name for the time of a circle.

    ``occupied`` (place) is what there is before. Refused are rows whose source another row moves or removes (``source``), whose target an earlier row wants
    (``claimed``), or a file that stays has (``occupied``), and rows of a later step whose group had a row refused (``group``): what was not copied is not removed.
    Of rows with one target the first by step, operation and source counts.
    """
    free = F.when((F.col("step") == 0) & F.col("op").isin(*MOVES, *REMOVALS), place(F.col("source")))
    want = F.when((F.col("step") == 0) & F.col("target").isNotNull(), F.coalesce(place(F.col("target"), F.col("target_entry")), place(F.col("target"))))
    rows = cut(rows.select(*COLUMNS).distinct().withColumns({"frees": free, "want": want, "n": F.monotonically_increasing_id()}))
    moved = first_for(rows, "frees").select("n", F.lit(True).alias("first"))
    state = rows.join(moved, "n", "left").withColumn("refused", F.when(F.col("frees").isNotNull() & F.col("first").isNull(), "source")).drop("first")
    won = first_for(state.where("refused IS NULL"), "want").select("n", F.lit(True).alias("first"))
    state = cut(state.join(won, "n", "left").withColumn("refused", F.coalesce("refused", F.when(F.col("want").isNotNull() & F.col("first").isNull(), "claimed"))).drop("first"))
    live = state.where("refused IS NULL")
    # Of all places the few that are wanted count; they are looked up once.
    wanted = live.select(F.col("want").alias("place")).where("place IS NOT NULL").distinct()
    there = cut(occupied.select("place").join(wanted, "place", "left_semi").distinct().select(F.col("place").alias("want"), F.lit(True).alias("there")))
    movers = live.where(F.col("frees").isNotNull())
    nodes = movers.select(F.col("frees").alias("want"), F.col("frees").alias("next"))
    own = F.col("want") == F.col("frees")
    links = movers.join(nodes, "want", "left").join(there, "want", "left")
    links = links.select(F.col("frees").alias("node"), F.when(~own, F.col("next")).alias("next"), F.when(F.col("want").isNull() | own | (F.col("next").isNull() & F.col("there").isNull()), True).when(F.col("next").isNull(), False).alias("ok"))
    links = cut(links)
    turns, heads = with_circles_broken(links, followed(links))
    turns = cut(turns)
    moving = live.where(F.col("frees").isNotNull()).join(turns.withColumnRenamed("node", "frees"), "frees").select("n", "ok", "turn")
    still = live.where(F.col("frees").isNull()).join(turns.select(F.col("node").alias("want"), F.col("ok").alias("freed"), F.col("turn").alias("after")), "want", "left").join(there, "want", "left")
    open_ = F.col("want").isNull() | F.col("op").isin(*OVERWRITES) | F.coalesce("freed", F.col("there").isNull())
    still = still.select("n", open_.alias("ok"), F.coalesce(F.col("after") + 1, F.lit(0)).alias("turn"))
    out = state.join(moving.unionByName(still), "n", "left").withColumn("refused", F.coalesce("refused", F.when(~F.col("ok"), "occupied")))
    out = cut(out.select(*COLUMNS, "frees", "refused", F.coalesce("turn", F.lit(0)).alias("turn")))
    groups = out.where("step = 0").groupBy("group_id").agg(F.count_if(F.col("refused").isNotNull()).alias("lost"), F.max("turn").alias("last"))
    bound = out.where("step > 0").drop("turn").join(groups, "group_id", "left").select(*COLUMNS, F.when(F.col("lost") > 0, "group").alias("refused"), F.coalesce("last", F.lit(0)).alias("turn"), F.lit(False).alias("temporary"))
    rest = out.where("step = 0").join(heads.select(F.col("node").alias("frees"), F.col("last").alias("after_all")), "frees", "left")
    by_way = F.concat(folder(F.col("source")), F.lit("/.swap-"), F.substring(F.sha1("source"), 1, 16))
    legs = F.when(
        F.col("after_all").isNotNull() & F.col("refused").isNull(),
        F.array(F.struct("source", by_way.alias("target"), "turn", F.lit(True).alias("temporary")), F.struct(by_way.alias("source"), "target", F.col("after_all").alias("turn"), F.lit(False).alias("temporary"))),
    ).otherwise(F.array(F.struct("source", "target", "turn", F.lit(False).alias("temporary"))))
    rest = rest.withColumn("leg", F.explode(legs)).select("op", "group_id", "step", "leg.source", "source_entry", "leg.target", "target_entry", "refused", "leg.turn", "leg.temporary")
    return rest.unionByName(bound)


def granted(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows that ``reserve`` grants over the places of ``files`` (path, entry_name); step counts their turns as well."""
    return reserve(rows, places(files)).where("refused IS NULL").withColumn("step", F.col("turn") * 2 + F.col("step")).select(*COLUMNS)
