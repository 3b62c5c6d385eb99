"""Chat formatting by quotation linking (DataFrame functions only on the main path).

A line's quote level is the number of ``>`` at its start. Lines of one level in a row form a passage. A quoted passage
is looked up by the hash of its normalised text (letters and digits only, lower case), as a whole and line by line,
among the unquoted passages of the same conversation, and the earliest earlier message that has it is what the quoting
message answers. Conversations come out ordered by thread, then depth, then turn, and without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, table

MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: Normalised units of fewer characters ("ok", "thanks") are the last evidence of a quotation: they count where no longer unit links.
LEAST_CHARS = 12


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_passages(df: DataFrame) -> DataFrame:
    """``df`` with parts: array<struct<level, lines>>, the maximal runs of lines of one quote level in ``text``.

    Each step is a projection of its own and linear in the lines of a text.
    """
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARK, "").alias("body"))
    df = df.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), r"\r?\n")).withColumn("__lines", F.transform("__lines", line))
    change = lambda i: (i == 1) | (F.get("__lines", i - 1)["level"] != F.get("__lines", i - 2)["level"])
    df = df.withColumn("__starts", F.filter(F.sequence(F.lit(1), F.size("__lines")), change))
    df = df.withColumn("__runs", F.arrays_zip(F.col("__starts").alias("s"), F.array_append(F.slice("__starts", F.lit(2), F.size("__starts")), F.size("__lines") + 1).alias("e")))
    part = lambda r: F.struct(F.get("__lines", r["s"] - 1)["level"].alias("level"), F.slice(F.col("__lines.body"), r["s"], r["e"] - r["s"]).alias("lines"))
    return df.withColumn("parts", F.transform("__runs", part)).drop("__lines", "__starts", "__runs")


def units(lines: Column) -> Column:
    """The whole passage (rank 0) and each of its lines (rank 1), normalised, and whether they are short; those without letters and digits left out."""
    unit = lambda rank, norm: F.struct(F.lit(rank).alias("rank"), norm.alias("norm"), (F.length(norm) < LEAST_CHARS).alias("short"))
    whole = F.array(unit(0, normalised(F.array_join(lines, " "))))
    return F.filter(F.concat(whole, F.transform(lines, lambda x: unit(1, normalised(x)))), lambda u: u["norm"] != "")


def reply_links(messages: DataFrame) -> DataFrame:
    """(key, parent_turn, n_linked) for each message (key, conv_id, turn, parts) that quotes an earlier one of its conversation.

    Each (conversation, hash) keeps one original, the earliest, found by a partial minimum before the shuffle: a passage
    that a third of all messages share is one row, and a quotation meets one row at most.
    """
    said = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("key", "conv_id", "turn", F.explode_outer("parts").alias("p"))
    unit = said.select("key", "conv_id", "turn", F.col("p.level").alias("level"), F.explode_outer(units(F.col("p.lines"))).alias("u")).select("key", "conv_id", "turn", "level", "u.short", "u.rank", F.md5("u.norm").alias("hash")).where("hash IS NOT NULL")
    quoted = unit.where("level > 0")
    asked = quoted.select("conv_id", "hash").distinct()
    first = unit.where("level = 0").join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("parent_turn"))
    found = quoted.join(first, ["conv_id", "hash"]).where("parent_turn < turn")
    # The outermost quotation names the direct parent; a whole passage is better evidence than a line, and any long unit than a short one.
    return found.groupBy("key").agg(F.min_by("parent_turn", F.struct("short", "level", "rank", -F.col("parent_turn"))).alias("parent_turn"), F.count_distinct("hash").alias("n_linked"))


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) for each linked (conv_id, turn, parent_turn): pointer doubling, so rounds grow with the logarithm of the depth."""
    state = cut(links.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("up")).withColumn("depth", F.lit(1).cast("long")))
    while True:
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        state = cut(state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")
        state = state.drop("moved")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text, ...) with reply_to, root_turn, depth, n_quoted, n_linked, and text without its quotes.

    A message that quotes nothing known starts its own thread (reply_to null, root_turn its turn, depth 0). Null texts
    count as empty; a null conv_id or turn links with nothing. Repeated rows all come back, alike. Order the result by
    conv_id, root_turn, depth, turn to read it; the rows of a conversation are never gathered in one task.
    """
    added = ("reply_to", "root_turn", "depth", "n_quoted", "n_linked")
    own = conversations.drop(*added).withColumn("key", row_key("conv_id", "turn", "role", "text"))
    parsed = with_passages(own)
    links = cut(reply_links(parsed.select("key", "conv_id", "turn", "parts")))
    rows = parsed.withColumns({
        "n_quoted": F.size(F.filter("parts", lambda p: p["level"] > 0)).cast("long"),
        "text": F.trim(F.array_join(F.flatten(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["lines"])), "\n"), F.lit(" \t\r\n")),
    })
    linked = rows.drop("parts").join(links.select("key", F.col("parent_turn").alias("reply_to"), F.col("n_linked").cast("long").alias("n_linked")), "key", "left").drop("key")
    if links.isEmpty():
        roots = None
    else:
        roots = thread_roots(linked.where("reply_to IS NOT NULL").select("conv_id", "turn", F.col("reply_to").alias("parent_turn")))
        linked = linked.join(roots, ["conv_id", "turn"], "left")
    return linked.withColumns({
        "root_turn": F.coalesce("root_turn", "turn") if roots is not None else F.col("turn"),
        "depth": F.coalesce("depth", F.lit(0)).cast("long") if roots is not None else F.lit(0).cast("long"),
        "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"),
    })


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "reply_to", "root_turn", "depth", "n_quoted", "n_linked", "text")


def oracle() -> str:
    mark = r"^[ \t]*((?:>[ \t]?)+)"
    norm = lambda t: f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, * FROM conversations),
x AS (SELECT rid, conv_id, turn, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT *, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM m)),
y AS (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '{mark}', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '{mark}', '') AS body FROM x),
z AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS part FROM (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS new FROM y)),
u AS (SELECT * FROM (SELECT rid, conv_id, turn, level, 0 AS rank, {norm("string_agg(body, ' ' ORDER BY i)")} AS norm FROM z GROUP BY rid, conv_id, turn, level, part UNION ALL SELECT rid, conv_id, turn, level, 1, {norm('body')} FROM z) WHERE norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, norm, min(turn) AS parent_turn FROM u WHERE level = 0 GROUP BY 1, 2),
q AS (SELECT u.*, f.parent_turn, row_number() OVER (PARTITION BY rid ORDER BY length(u.norm) < {LEAST_CHARS}, level, rank, f.parent_turn DESC) AS r FROM u JOIN f ON f.conv_id = u.conv_id AND f.norm = u.norm WHERE level > 0 AND f.parent_turn < u.turn),
k AS (SELECT rid, min(parent_turn) FILTER (WHERE r = 1) AS reply_to, count(DISTINCT norm) AS n_linked FROM q GROUP BY rid),
up AS (SELECT m.conv_id, m.turn, max(k.reply_to) AS up FROM m JOIN k ON k.rid = m.rid GROUP BY 1, 2),
w(conv_id, turn, up, depth) AS (SELECT conv_id, turn, up, 1 FROM up UNION ALL SELECT w.conv_id, w.turn, up.up, w.depth + 1 FROM w JOIN up ON up.conv_id = w.conv_id AND up.turn = w.up),
t AS (SELECT conv_id, turn, arg_max(up, depth) AS root_turn, max(depth) AS depth FROM w GROUP BY 1, 2),
own AS (SELECT rid, count(DISTINCT part) FILTER (WHERE level > 0) AS n_quoted, trim(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), concat(' ', chr(9), chr(13), chr(10))) AS text FROM z GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, k.reply_to, coalesce(t.root_turn, m.turn) AS root_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, n_quoted, coalesce(n_linked, 0) AS n_linked, own.text
FROM m JOIN own ON own.rid = m.rid LEFT JOIN k ON k.rid = m.rid LEFT JOIN t ON t.conv_id = m.conv_id AND t.turn = m.turn"""
