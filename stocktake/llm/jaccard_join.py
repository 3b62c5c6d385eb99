"""N-gram Jaccard join by several global token orders.

Two shingle sets of Jaccard similarity t share ceil(t * n) of either's n tokens. So under ANY order of all tokens,
the first n - ceil(t * n) + l of both have l tokens in common. Each order is thus a filter that loses no pair, and a pair
must pass all of them before it is verified:

1. under the order of the hashes, with l a tenth of the set: sets that don't share so many tokens with any others go;
2. under the order of document frequency among the sets left: sets of which less than t of the tokens occur in another go, and
   sets that share no prefix token, of compatible size, part into groups;
3. within a group, pairs of sets meet in tiles of bounded size. A tile holds the pairs that share a prefix token under the ascending
   order of hashes, those that do under the descending one, those that do under the order of document frequency, and those of compatible size, as
   bit matrices; what is in all of them is verified exactly, by counting common tokens.

Equal sets are one class from the start, and a tile reports a spanning forest and link counts, not pairs: a group of near copies
costs rows in proportion to its members. Tokens that a noticeable share of all texts has are known beforehand from a sample of bounded
size. They are only dealt out otherwise, so that no token makes a large task; what is found doesn't depend on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_hot, stored, table, tasks
from .components import components
from .shingles import mixed, shingle_sets

#: Fixed values of the query: linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Common prefix tokens that the first filter asks for, as a share of the set.
SHARED = 0.1
#: Classes and tokens in a block of the verification (means, by hash), and columns of its matrices at a time.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 1 << 21, 4096
#: The sample that frequent tokens are known from: so many texts at most (a mean, by hash), one in so many at most, and the share of
#: its texts, the number of them and the number of tokens that bound the list.
SAMPLE, SAMPLED, FREQUENT, LEAST, MOST_TOKENS = 1 << 16, 16, 0.001, 8, 100_000
#: Of the candidate pairs of a tile, if they are fewer than one in so many, each is verified by itself.
SPARSE = 64


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """ceil(percent % of n)."""
    return -(-(n * percent) // 100)


def class_of(tokens: np.ndarray) -> int:
    return int(mixed(np.array([mixed(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 22) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets) of pieces of a batch of about ``most`` bytes of text, so memory does not follow the batch."""
    sizes = np.asarray([len(t) if t else 0 for t in batch.column(text).cast(pa.large_binary()).to_pylist()])
    start = 0
    while start < len(sizes):
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most)))
        yield start, shingle_sets(batch.column(text).slice(start, stop - start))
        start = stop


def set_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s for _, part in slices(batch) for s in part]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("doc"), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["id", "doc", "cls", "n"])


def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sets)))], ["token"])


def frequent_tokens(own: DataFrame, texts: int) -> DataFrame:
    """(token): those that more than FREQUENT of a sample's texts have, MOST_TOKENS at most. Only how rows are dealt out depends on them."""
    every = max(SAMPLED, texts // SAMPLE)
    some = own.where(F.pmod(F.xxhash64("idh", "th"), F.lit(every)) == 0)
    found = some.select("text").mapInArrow(all_tokens, "token long").groupBy("token").agg(F.count("*").alias("n"))
    return cut(found.where(F.col("n") >= max(LEAST, texts / every * FREQUENT)).orderBy(F.desc("n"), "token").limit(MOST_TOKENS).select("token"))


def prefix_tokens(batches: Iterator[pa.RecordBatch], percent: int, shared: float, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, cls, often) for the first tokens by hash of each set: as many as a set of compatible size may need (its l is at most 100 / percent times as large).

    A set's frequent tokens are one row, which says how many they are, under a token of chance.
    """
    for batch in batches:
        for start, sets in slices(batch):
            place = [start + i for i, s in enumerate(sets) if len(s)]
            sets = [s for s in sets if len(s)]
            if not sets:
                continue
            kept = [s[: len(s) - needed(len(s), percent) + int(np.ceil(shared * len(s) * 100 / percent)) + 1] for s in sets]
            cls, token = np.array([class_of(s) for s in sets], np.int64), signed(np.concatenate(kept))
            owner = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
            much = np.zeros(len(token), bool) if not len(frequent) else frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token
            often = np.bincount(owner[much], minlength=len(kept))
            some = np.flatnonzero(often)
            chance = mixed(cls[some].view(np.uint64) + np.array(place, np.uint64)[some]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[token[~much], chance]), pa.array(np.r_[cls[owner[~much]], cls[some]]), pa.array(np.r_[np.zeros((~much).sum(), np.int64), often[some]], pa.int64())], ["token", "cls", "often"])


def shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, cls) -> (cls, m, often): m tokens, by batch, that another class has too; rows of frequent tokens, which count as such, pass through.

    Two rows are held back at most, however many classes have a token: the last, and one before it as its context.
    """
    token, cls, settled = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def tally(last: bool) -> pa.RecordBatch:
        other = token[1:] == token[:-1]
        hit = np.zeros(len(token), bool)
        hit[1:] |= other
        hit[:-1] |= other
        hit[:settled] = False
        if not last:
            hit[-1] = False
        keys, n = np.unique(cls[hit], return_counts=True)
        return counted(keys, n, np.zeros(len(keys), np.int64))

    def counted(keys: np.ndarray, n: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(often, pa.int64())], ["cls", "m", "often"])

    for batch in batches:
        some = batch.column("often").to_numpy()
        if some.any():
            yield counted(batch.column("cls").to_numpy()[some > 0], np.zeros((some > 0).sum(), np.int64), some[some > 0])
        token, cls = np.r_[token, batch.column("token").to_numpy()[some == 0]], np.r_[cls, batch.column("cls").to_numpy()[some == 0]]
        if not len(token):
            continue
        first = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]  # texts of one class repeat rows
        token, cls = token[first], cls[first]
        yield tally(False)
        token, cls = token[-2:], cls[-2:]
        settled = len(token) - 1
    if len(token):
        yield tally(True)


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) -> (cls, n, tokens)."""
    for batch in batches:
        for start, sets in slices(batch):
            yield pa.RecordBatch.from_arrays([batch.column("cls").slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["cls", "n", "tokens"])


def bucket_of(n: str, percent: int):
    """Sets of compatible sizes lie in one bucket or in two neighbours."""
    return F.floor(F.log(F.col(n)) / float(np.log(100 / percent)) + 1e-9).cast("int")


def split_groups(rows: DataFrame, percent: int, frequent: DataFrame) -> DataFrame:
    """(cls, n, token) -> (cls, g): classes that a chain of shared tokens and compatible sizes joins; those of no other class go.

    In the order of sizes, a token's classes fall apart where the next is too large for the last; each such run links
    to its first class. Classes of a frequent token are dealt to many parts, and fall apart by buckets of sizes.
    """
    rows = rows.join(F.broadcast(frequent.withColumn("often", F.lit(True))), "token", "left")
    w = Window.partitionBy("token").orderBy("n", "cls")
    gap = F.coalesce(F.lag("n").over(w) * 100 < F.col("n") * percent, F.lit(True))
    runs = rows.where("often IS NULL").withColumn("gap", gap).withColumn("a", F.last(F.when(F.col("gap"), F.col("cls")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = runs.select("a", F.col("cls").alias("b"))
    key = ["token", "size"]
    hot = rows.where("often").select("token", bucket_of("n", percent).alias("size"), "cls", F.pmod(F.xxhash64("cls"), F.lit(4 * tasks(rows.sparkSession))).alias("part"))
    hot = hot.withColumn("a", F.min("cls").over(Window.partitionBy(*key, "part")))
    heads = cut(hot.select(*key, "a").distinct())  # one for each part
    least = cut(heads.groupBy(*key).agg(F.min("a").alias("b")))
    up = least.select("token", (F.col("size") - 1).alias("size"), F.col("b").alias("a")).join(least, key).select("a", "b")
    edges = edges.unionByName(hot.select("a", F.col("cls").alias("b"))).unionByName(heads.join(least, key).select("a", "b")).unionByName(up)
    found = components(edges.where("a <> b").distinct())
    return found.select(F.col("v").alias("cls"), F.col("root").alias("g"))


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Tokens in common of each left with each right set; columns of a token matrix at a time."""
    sizes = [len(t) for t in left + right]
    tokens = np.concatenate(left + right)
    _, col, times = np.unique(tokens, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = times[col] > 1
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    counts = np.zeros((len(left), len(right)), np.float64)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[row[a:b], col[a:b] - c] = 1
        counts += has[: len(left)] @ has[len(left) :].T
    return counts.astype(np.int64)


def prefix(tokens: np.ndarray, percent: int, last: bool) -> np.ndarray:
    k = len(tokens) - int(needed(len(tokens), percent)) + 1
    return tokens[-k:] if last else tokens[:k]


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, copies, tokens, rare) -> (cls, copies, tokens, in_rare): a bit for each token, whether it is among the set's rare ones."""
    for batch in batches:
        tokens, rare = batch.column("tokens"), batch.column("rare")
        bits = [np.packbits(np.isin(tokens[i].values.to_numpy(), rare[i].values.to_numpy())).tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("copies"), tokens, pa.array(bits, pa.binary())], ["cls", "copies", "tokens", "in_rare"])


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int, rare: tuple[list[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """Which left sets link with which right ones. The filters of three orders (``rare`` are the prefixes by document frequency) and of the sizes are intersected; what passes all is verified."""
    na, nb = np.array([len(t) for t in left])[:, None], np.array([len(t) for t in right])[None, :]
    passed = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    for of in (lambda sets, _: [prefix(t, percent, False) for t in sets], lambda sets, _: [prefix(t, percent, True) for t in sets], lambda _, own: own):
        if passed.any():
            passed &= common_counts(of(left, rare[0]), of(right, rare[1])) > 0
    i, j = np.nonzero(passed)
    if len(i) * SPARSE < passed.size:
        common = np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
        passed[i, j] = 100 * common >= percent * (na[i, 0] + nb[0, j] - common)
        return passed
    rows, cols = np.unique(i), np.unique(j)
    common = np.zeros(passed.shape, np.int64)
    common[np.ix_(rows, cols)] = common_counts([left[k] for k in rows], [right[k] for k in cols])
    return passed & (100 * common >= percent * (na + nb - common))


def verify_tile(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs between the two sides of a tile, each once -> a spanning forest of the links, and each class's links. Side 2 is both."""
    same = bool((pdf["side"] == 2).any())
    a, b = (pdf, pdf) if same else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
    if not len(a) or not len(b) or (same and len(a) == 1):
        return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
    first = lambda df: [t[np.unpackbits(np.frombuffer(m, np.uint8), count=len(t)).astype(bool)] for t, m in zip(df["tokens"], df["in_rare"], strict=True)]
    linked = linked_pairs(a["tokens"].tolist(), b["tokens"].tolist(), percent, (first(a), first(b)))
    if same:
        np.fill_diagonal(linked, False)
    ids_a, ids_b = a["cls"].to_numpy(), b["cls"].to_numpy()
    links = [linked @ b["copies"].to_numpy()] if same else [linked @ b["copies"].to_numpy(), linked.T @ a["copies"].to_numpy()]
    root_a, root_b = np.arange(len(a)), np.arange(len(b)) + (0 if same else len(a))
    far = len(a) + len(b)
    while True:  # smallest labels spread along the links
        new_b = np.minimum(root_b, np.where(linked, root_a[:, None], far).min(0))
        new_a = np.minimum(root_a, np.where(linked, new_b[None, :], far).min(1))
        if (new_a == root_a).all() and (new_b == root_b).all():
            break
        root_a, root_b = new_a, new_b
    ids = ids_a if same else np.r_[ids_a, ids_b]
    roots = root_a if same else np.r_[root_a, root_b]
    out = pd.DataFrame({"a": ids, "b": ids[roots], "links": np.concatenate(links)})
    return out[out["links"] > 0]


def tiles_of(groups: DataFrame, percent: int, block: int) -> DataFrame:
    """(cls, g, n) -> (cls, g, b1, lo, b2, hi, side): the tiles that a class belongs to.

    A group that fits a block is one tile. A larger one goes by buckets of sizes, a bucket by blocks, and a tile is two blocks of one bucket
    or of two neighbours.
    """
    own = groups.withColumn("size", bucket_of("n", percent))
    per = cut(own.groupBy("g", "size").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")))
    whole = per.groupBy("g").agg(((F.sum("rows") <= block) & (F.sum("tokens") <= BLOCK_TOKENS)).alias("one"))
    blocks = F.ceil(F.greatest(F.col("rows") / block, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    per = cut(per.join(whole, "g").select("g", "size", "rows", F.when(F.col("one"), 1).otherwise(blocks).alias("blocks"), "one"))
    beside = lambda by, name: per.where("NOT one").select("g", (F.col("size") + by).alias("size"), F.col("blocks").alias(name))
    per = cut(per.join(beside(-1, "above"), ["g", "size"], "left").join(beside(1, "below"), ["g", "size"], "left"))
    met = join_hot(own, per, ["g", "size"], F.xxhash64("cls"), "rows")
    met = met.withColumn("size", F.when(F.col("one"), 0).otherwise(F.col("size"))).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    each = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda b1, lo, b2, hi, side: F.struct(b1.alias("b1"), lo.alias("lo"), b2.alias("b2"), hi.alias("hi"), side.alias("side"))
    size, blk = F.col("size"), F.col("blk")
    within = F.transform(each("blocks"), lambda j: tile(size, F.least(blk, j), size, F.greatest(blk, j), F.when(j == blk, 2).when(blk < j, 0).otherwise(1)))
    above = F.transform(each("above"), lambda j: tile(size, blk, size + 1, j, F.lit(0)))
    below = F.transform(each("below"), lambda j: tile(size - 1, j, size, blk, F.lit(1)))
    return met.select("cls", "g", F.explode(F.concat(within, above, below)).alias("t")).select("cls", "g", "t.*")


def class_links(docs: DataFrame, percent: int = PERCENT, shared: float = SHARED, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links) of docs (id, text).

    members: id, idh, cls, n, one row per document; cls is null for a text without words. links: a, b, links — per class and
    block, a class of the same component and how many documents of other classes the block links it with.
    """
    own = docs.select("id", F.xxhash64("id").alias("idh"), F.xxhash64("text").alias("th"), "text")
    id_type = own.schema["id"].dataType.simpleString()
    keyed = own.select("id", F.struct("idh", "th").alias("doc"), "text")
    members = stored(keyed.mapInArrow(set_classes, f"id {id_type}, doc struct<idh: long, th: long>, cls long, n long"))
    classes = cut(members.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc").alias("doc")))

    frequent = frequent_tokens(own, members.count())
    known = own.sparkSession.sparkContext.broadcast(np.sort(np.array([r["token"] for r in frequent.collect()], np.int64)))  # MOST_TOKENS at most
    first = own.select("text").mapInArrow(lambda b: prefix_tokens(b, percent, shared, known.value), "token long, cls long, often long").repartition("token").sortWithinPartitions("token", "cls")
    counts = first.mapInArrow(shared_counts, "cls long, m long, often long").groupBy("cls").agg((F.sum("m") + F.max("often")).alias("m"))
    passed = counts.join(classes, "cls").where(F.col("m") >= F.greatest(F.floor(F.col("n") * shared), F.lit(1)))

    rep = passed.select("cls", F.col("doc.idh").alias("idh"), F.col("doc.th").alias("th"))
    sets = own.select("idh", "th", "text").join(rep, ["idh", "th"]).select("cls", "text").mapInArrow(whole_sets, "cls long, n long, tokens array<long>")
    sets = stored(sets.groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))

    each = sets.select("cls", "n", F.explode_outer("tokens").alias("token")).join(F.broadcast(frequent.withColumn("often", F.lit(True))), "token", "left")
    rare = each.where("often IS NULL").withColumn("df", F.count("*").over(Window.partitionBy("token")))
    often = each.where("often")
    often = often.join(F.broadcast(cut(often.groupBy("token").agg(F.count("*").alias("df")))), "token")
    shared_tokens = rare.unionByName(often.select(*rare.columns)).where("df > 1").groupBy("cls").agg(F.first("n").alias("n"), F.count("*").alias("m"), F.collect_list(F.struct("df", "token")).alias("by_df"))
    need = F.ceil(F.col("n") * percent / 100)
    near = shared_tokens.where(F.col("m") >= need)
    # Tokens that no other set has come first in this order; of the rest, so many belong to the prefix.
    rare = F.slice(F.array_sort("by_df"), F.lit(1), (F.col("m") - need + 1).cast("int"))
    near = near.select("cls", rare["token"].alias("rare")).join(sets, "cls").join(classes.select("cls", "copies"), "cls")
    near = stored(near)

    groups = split_groups(near.select("cls", "n", F.explode_outer("rare").alias("token")), percent, frequent)
    tiles = tiles_of(cut(groups.join(near.select("cls", "n"), "cls")), percent, block)
    held = near.select("cls", "copies", "tokens", "rare").mapInArrow(marked, "cls long, copies long, tokens array<long>, in_rare binary")
    rows = held.join(tiles, "cls")
    return members, rows.groupBy("g", "b1", "lo", "b2", "hi").applyInPandas(lambda pdf: verify_tile(pdf, percent), "a long, b long, links long")


def join_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, shared: float = SHARED, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for each row of ``docs``.

    component_id is the smallest id that links reach, the row's own included; n_links counts the other rows linked directly,
    equal sets included. Null and wordless texts have n_shingles 0, their own id and no links. Rows that repeat an id
    count as rows. Where all ids of a component are null, component_id is null. An empty frame gives an empty one.
    """
    members, links = class_links(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), percent, shared, block)
    links = cut(links)
    labels = components(links.select("a", "b"))
    per_class = members.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    linked = links.groupBy("a").agg(F.sum("links").alias("links"))
    per_class = per_class.join(labels.withColumnRenamed("v", "cls"), "cls", "left").join(linked.withColumnRenamed("a", "cls"), "cls", "left")
    per_class = cut(per_class.select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # A component, or a class of equal texts, may hold a third of all rows.
    smallest = cut(per_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    final = cut(join_hot(per_class, smallest, ["root"], F.col("cls"), "classes").select("cls", "component_id", "n_links", "copies", F.lit(True).alias("known")))
    out = join_hot(members, final, ["cls"], F.xxhash64("doc.idh", "doc.th"), "copies")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
