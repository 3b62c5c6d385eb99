"""Benchmark decontamination by winnowing (DataFrame functions only on the main path).

A window of 10 words holds six 5-grams; the least of their hashes is its fingerprint. Windows in a row mostly share it, so
only the first of such a run keeps it. A shared window has the same 5-grams on both sides, hence the same fingerprint at
the same place: no shared span of 10 words or more can be missed. Documents' fingerprints are joined with the
benchmark's, and from each meeting the common words are extended to both sides, as far as a window that holds the
fingerprint can reach; where 10 words or more come together, they are a hit. An item of fewer than 10 words is one
window, whose fingerprint is its own hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut, join_hot, table

WINDOW, GRAM = 10, 5
#: 5-grams in a window, and words that a window can have beside one of its 5-grams on one side.
SPAN, BESIDE = WINDOW - GRAM + 1, WINDOW - GRAM
#: An index of at most so many benchmark rows is broadcast; beyond it, fingerprints meet by a shuffle.
BROADCAST_ROWS = 200_000
#: Meetings of a fingerprint in one part of that shuffle.
PART = 100_000
#: Between words: what is neither an ASCII digit or letter nor a character beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their given case; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), BETWEEN)
    head = F.when(F.get(parts, F.lit(0)) == "", 2).otherwise(1)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, head, F.greatest(F.size(parts) - head + 1 - tail, F.lit(0)))


def upto(n: Column) -> Column:
    """1..n as an array, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def grams(words: Column, n: int, *seed: Column) -> Column:
    return F.transform(upto(F.size(words) - n + 1), lambda i: F.xxhash64(*seed, F.slice(words, i, n)))


def with_least(df: DataFrame) -> DataFrame:
    """``df`` (with ``words``) with grams, and least: the least gram of each window. A minimum of six is one of two, of two, of two."""
    low = lambda a, by: F.zip_with(a, F.slice(a, F.lit(by + 1), F.size(a)), lambda x, y: F.least(x, y))
    # least() skips nulls, so places near the end of an array have the minimum of what is there; they are cut off.
    df = df.withColumn("grams", grams(F.col("words"), GRAM)).withColumn("__two", low("grams", 1)).withColumn("__four", low("__two", 2))
    six = F.zip_with("__four", F.slice("__two", F.lit(5), F.size("__two")), lambda x, y: F.least(x, y))
    return df.withColumn("least", F.slice(six, F.lit(1), F.greatest(F.size("grams") - SPAN + 1, F.lit(0)))).drop("__two", "__four")


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """``df`` (with ``words``) with ``prints``: a place for each window, those of WINDOW words first, then those of each length in ``short``; null where a run goes on.

    A run is renewed after SPAN windows, so that in a text that repeats itself each window's fingerprint lies within 2 * SPAN - 1 places of
    the one that was kept. Explode it with ``posexplode_outer``: for a plain explode the optimizer adds a filter on the array's size
    and pushes that below the projections that build it, where the whole chain would run once for each element.
    """
    df = with_least(df)
    prints = F.transform("least", lambda x, i: F.when((i % SPAN == 0) | (F.get("least", i - 1) != x), x))
    if short:
        prints = F.concat(prints, *[grams(F.col("words"), n, F.lit(n)) for n in short])
    return df.withColumn("prints", prints).drop("grams", "least")


def first_word(pos: Column, n_words: Column, length: Column, short: list[int]) -> Column:
    """Where, from 1, the window at place ``pos`` of ``prints`` begins, if it has ``length`` words."""
    at, before = pos + 1, F.greatest(n_words - WINDOW + 1, F.lit(0))
    for n in short:
        at = F.when(length == n, pos + 1 - before).otherwise(at)
        before = before + F.greatest(n_words - n + 1, F.lit(0))
    return at


def spelled(words: Column) -> Column:
    return F.array_join(words, " ")


def benchmark_index(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, len, print, core, before, after): what an item has at a fingerprint — the words of the 5-gram (of the whole of a short item), those before it, nearest first, and those behind."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), words_of(ascii_lower(F.col(f"`{text}`"))).alias("words"))
    each = with_least(items).select("item", "words", "grams", F.posexplode_outer("least").alias("pos", "print"))
    at = F.filter(F.sequence(F.col("pos") + 1, F.col("pos") + SPAN), lambda q: F.get("grams", q - 1) == F.col("print"))
    each = each.withColumn("q", F.explode_outer(at)).where("q IS NOT NULL")
    long = each.select("item", F.lit(WINDOW).alias("len"), "print", spelled(F.slice("words", F.col("q"), GRAM)).alias("core"), F.reverse(F.slice("words", F.greatest(F.col("q") - BESIDE, F.lit(1)), F.least(F.col("q") - 1, F.lit(BESIDE)))).alias("before"), F.slice("words", F.col("q") + GRAM, BESIDE).alias("after"))
    n, none = F.size("words"), F.array().cast("array<string>")
    short = items.where((n > 0) & (n < WINDOW)).select("item", n.alias("len"), F.xxhash64(n, "words").alias("print"), spelled(F.col("words")).alias("core"), none.alias("before"), none.alias("after"))
    return long.unionByName(short).distinct()


def covered(spans: Column) -> Column:
    """Words inside the union of (at, end) spans, ends exclusive."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["at"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def agreeing(here: Column, there: Column) -> Column:
    """How many words of the two arrays agree from their begin, BESIDE at most."""
    n = F.lit(BESIDE)
    for k in reversed(range(BESIDE)):
        n = F.when(F.coalesce(F.get(here, F.lit(k)) == F.get(there, F.lit(k)), F.lit(False)), n).otherwise(k)
    return n


def extended(met: DataFrame) -> DataFrame:
    """Meetings (id, text_hash, at, around, offset, item, len, core, before, after) -> (id, text_hash, span, item).

    ``around`` are the document's words near the window, ``offset`` of them before word 1 of the window, which is word ``at`` of the document.
    """
    places = F.when(F.col("len") == WINDOW, F.sequence(F.lit(0), F.lit(2 * SPAN - 2))).otherwise(F.array(F.lit(0)))
    size = F.when(F.col("len") == WINDOW, GRAM).otherwise(F.col("len"))
    tried = met.withColumn("size", size).withColumn("p", F.explode_outer(places)).withColumn("q", F.col("offset") + F.col("p") + 1)
    tried = tried.where((F.col("q") >= 1) & (spelled(F.slice("around", F.greatest("q", F.lit(1)), F.col("size"))) == F.col("core")))
    left = agreeing(F.reverse(F.slice("around", F.greatest(F.col("q") - BESIDE, F.lit(1)), F.least(F.col("q") - 1, F.lit(BESIDE)))), F.col("before"))
    right = agreeing(F.slice("around", F.col("q") + F.col("size"), BESIDE), F.col("after"))
    found = tried.withColumn("left", left).withColumn("right", right).where(F.col("left") + F.col("size") + F.col("right") >= F.col("len"))
    begin = F.col("at") + F.col("p")
    return found.select("id", "text_hash", F.struct((begin - F.col("left")).alias("at"), (begin + F.col("size") + F.col("right")).alias("end")).alias("span"), "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per distinct (id, text) that holds a window of an item: id, text_hash, spans (at, end in words from 1, end exclusive), items."""
    index = cut(benchmark_index(benchmark, item, item_text))
    per_len = {r["len"]: r["n"] for r in index.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    short = sorted(n for n in per_len if n < WINDOW)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text}`").alias("text_hash"), words_of(ascii_lower(F.col(f"`{text}`"))).alias("words"))
    prints = fingerprints(own, short).select("id", "text_hash", "words", F.posexplode_outer("prints").alias("pos", "print")).where("print IS NOT NULL")
    # The words near a window are taken from a meeting only, so that a document's words aren't copied for each of its windows.
    near = F.slice("words", F.greatest(F.col("at") - BESIDE, F.lit(1)), 2 * SPAN + GRAM + 2 * BESIDE)
    offset = F.least(F.col("at") - 1, F.lit(BESIDE))
    columns = ["id", "text_hash", "at", near.alias("around"), offset.alias("offset")]
    if sum(per_len.values()) <= broadcast_rows:
        met = prints.join(F.broadcast(index), "print").withColumn("at", first_word(F.col("pos"), F.size("words"), F.col("len"), short))
        met = met.select(*columns, "item", "len", "core", "before", "after")
    else:
        lens = index.select("print", "len").distinct()
        n = cut(prints.groupBy("print").agg(F.count("*").alias("n")).join(lens, "print"))
        asks = join_hot(prints, n.groupBy("print").agg(F.first("n").alias("n"), F.collect_set("len").alias("lens")), ["print"], F.xxhash64("id", "text_hash", "pos"))
        asks = asks.where("n IS NOT NULL").withColumn("len", F.explode("lens")).withColumn("at", first_word(F.col("pos"), F.size("words"), F.col("len"), short))
        asks = asks.select(*columns, "print", "len", F.pmod(F.xxhash64("id", "text_hash", "at"), F.ceil(F.col("n") / PART)).alias("part"))
        dealt = index.join(n, ["print", "len"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PART) - 1))).drop("n")
        met = asks.join(dealt, ["print", "len", "part"])
    return extended(met).groupBy("id", "text_hash").agg(F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with leak_spans and leak_items; both null for a clean row.

    Null and wordless texts, and items without words, match nothing. An item without an id marks spans and is in no list of items. Repeated rows
    get the same answer; rows that share an id but not a text get their own. Very long texts are judged whole. Input columns of
    the added names are replaced. An empty frame gives an empty one, an empty benchmark marks nothing.
    """
    own = docs.drop("leak_spans", "leak_items")
    leaks = find_leaks(own, benchmark, id_col, text, item, item_text, broadcast_rows).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("leak_spans"), F.col("items").alias("leak_items"))
    return own.join(leaks, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(f"`{text}`") == F.col("__hash")), "left").drop("__id", "__hash")


def leak_counts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``; item ids of any type count by their text."""
    docs, bench = docs.select("doc_id", "text"), benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    leaks = find_leaks(docs, bench).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "spans", "items")
    sized = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    names = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return sized.join(leaks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left").select(
        "doc_id", "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    words = lambda t: f"list_filter(string_split_regex(translate(coalesce({t}, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH b AS (SELECT item_id, {words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw ON dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
