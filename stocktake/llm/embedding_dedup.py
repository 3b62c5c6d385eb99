"""Embedding near-duplicates by product quantisation.

Coarse centroids (two levels once there are many vectors) deal unit vectors into inverted lists; what a vector differs by from its list's
centroid is kept as one code word for each of eight subspaces, with the length of what the codes miss. A query vector
looks into the lists nearest to it; table look-ups give its distance to each coded vector there, and only vectors that may
be near enough, by the triangle inequality with the length missed, have their cosine computed. So codes lose no
pair of a probed list; only lists that neither vector of a pair probes can. With ``exact`` a query probes every list that can hold a
near vector: no vector is nearer to its query than the plane that parts the two lists is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, stored, table
from .components import components

#: Fixed value of the query.
LEAST_COSINE = 0.93
#: The quantisers are fitted on at most so many vectors, the first by a hash; every vector is indexed.
SAMPLE = 8192
#: Vectors for each list, lists of the first level at most, lists that a query looks into, and vectors in a block of a list.
LIST, LISTS, PROBES, BLOCK = 128, 512, 12, 1024
SUBSPACES, WORDS = 8, 32
#: First-level centroids whose lists a query ranks, and second-level centroids at most.
FIRST, SECOND = 16, 1024
#: Leading coordinates of a unit vector that lists and codes see (shorter ones count as padded by zeros). They bound the whole distance
#: from below, so nothing is lost; cosines are of whole vectors.
WIDTH = 512
#: Numbers in a table of distances at a time.
CELLS = 1 << 22


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def unit(vectors: pd.Series) -> np.ndarray:
    """Unit vectors of vectors of one length; scaled before they are squared, so large and small numbers keep their direction."""
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def heads(vectors: pd.Series, width: int) -> np.ndarray:
    """The first ``width`` coordinates of unit vectors, whatever their lengths."""
    out, size = np.zeros((len(vectors), width)), vectors.map(len).to_numpy()
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for part in np.array_split(rows, max(1, len(rows) * int(n) // CELLS)):
            out[part, : min(n, width)] = unit(vectors.iloc[part])[:, :width]
    return out


class Quantiser:
    """Centroids ``first[a] + second[b]`` of list a * len(second) + b, and ``codes``: code words of the residuals for each subspace."""

    def __init__(self, sample: np.ndarray, vectors: int, seed: int = 0, lists: int | None = None, more: int | None = None):
        lists = max(1, min(lists or min(LISTS, vectors // LIST), len(sample)))
        self.first = k_means(sample, lists, seed)
        rest = sample - self.first[(sample @ self.first.T - (self.first**2).sum(1) / 2).argmax(1)]
        more = max(1, min(more or min(SECOND, vectors // (lists * LIST * 2)), len(sample)))
        self.second = k_means(rest, more, seed + 1) if more > 1 else np.zeros((1, sample.shape[1]))
        cell = self.nearest(sample, 1)[:, 0]
        rest = self.cut(sample - self.centre(cell))
        self.codes = np.stack([k_means(rest[:, m], min(WORDS, len(sample)), seed + 2 + m) for m in range(SUBSPACES)])

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def cut(self, x: np.ndarray) -> np.ndarray:
        """(rows, subspaces, dimensions), padded by zeros."""
        d = -(-x.shape[1] // SUBSPACES)
        return np.pad(x, ((0, 0), (0, d * SUBSPACES - x.shape[1]))).reshape(len(x), SUBSPACES, d)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each row, nearest first, among those below its FIRST nearest first-level centroids; some rows at a time."""
        rows = max(1, CELLS // (min(FIRST, len(self.first)) * len(self.second)))
        return np.concatenate([self.nearest_of(x[i : i + rows], n) for i in range(0, max(1, len(x)), rows)])

    def nearest_of(self, x: np.ndarray, n: int) -> np.ndarray:
        to_first = (self.first**2).sum(1) - 2 * x @ self.first.T
        a = np.argsort(to_first, 1, kind="stable")[:, :FIRST]
        k = len(self.second)
        to_both = np.take_along_axis(to_first, a, 1)[:, :, None] + ((self.second**2).sum(1) - 2 * x @ self.second.T)[:, None, :] + 2 * (self.first @ self.second.T)[a]
        best = np.argsort(to_both.reshape(len(x), -1), 1, kind="stable")[:, :n]
        return np.take_along_axis(a, best // k, 1) * k + best % k

    def reachable(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's nearest list, and all lists that can hold a vector within ``reach`` of it; for lists of one level."""
        between = np.sqrt(np.maximum(((self.first[:, None] - self.first) ** 2).sum(2), 0)) if len(self.first) * len(self.first) * x.shape[1] <= CELLS else np.sqrt(np.maximum((self.first**2).sum(1)[:, None] + (self.first**2).sum(1) - 2 * self.first @ self.first.T, 0))
        home, lists = [], []
        for i in range(0, len(x), max(1, CELLS // len(self.first))):
            part = (self.first**2).sum(1) - 2 * x[i : i + max(1, CELLS // len(self.first))] @ self.first.T
            near = part.argmin(1)
            ok = part - part[np.arange(len(part)), near][:, None] <= 2 * reach * between[near] + 1e-9
            home.append(near)
            lists += [np.flatnonzero(row) for row in ok]
        return np.concatenate(home) if home else np.empty(0, int), lists

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = self.cut(x - self.centre(cell))
        code = np.stack([(rest[:, m] @ c.T - (c * c).sum(1) / 2).argmax(1) for m, c in enumerate(self.codes)], 1)
        missed = rest - np.stack([c[code[:, m]] for m, c in enumerate(self.codes)], 1)
        return code.astype(np.uint8), np.sqrt((missed**2).sum((1, 2)))

    def distances(self, queries: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
        """From each query to each coded vector of list ``cell``, by look-up."""
        rest = self.cut(queries - self.centre(np.array([cell])))
        total = np.zeros((len(queries), len(code)))
        for m, c in enumerate(self.codes):
            look_up = ((rest[:, m, None, :] - c) ** 2).sum(2)
            total += look_up[:, code[:, m]]
        return np.sqrt(total)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each of ``n`` nodes' smallest node that the links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def search_block(pdf: pd.DataFrame, q: Quantiser, least: float) -> pd.DataFrame:
    """Queries against coded vectors of one block of a list -> (a, b, links): each linked vector, one that it reaches, and its links.

    A pair whose other vector finds it too, in its own list, counts there for the other one; else it counts for both here.
    """
    asks, has = pdf[pdf["query"]], pdf[~pdf["query"]]
    empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
    if not len(asks) or not len(has):
        return empty
    cell = int(pdf["cell"].iloc[0])
    x, y = unit(asks["vec"]), unit(has["vec"])
    code = np.array(has["code"].tolist(), np.int64)
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    wide = q.first.shape[1]
    head = np.pad(x[:, :wide], ((0, 0), (0, max(0, wide - x.shape[1]))))
    i, j = np.nonzero(q.distances(head, cell, code) <= reach + has["missed"].to_numpy())
    ids_a, ids_b = asks["cls"].to_numpy(), has["cls"].to_numpy()
    other = ids_a[i] != ids_b[j]
    i, j = i[other], j[other]
    near = np.concatenate([(x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) for k in range(0, max(1, len(i)), 65536)]) >= least
    i, j = i[near], j[near]
    if not len(i):
        return empty
    size = has["probes"].map(len).to_numpy()
    probes = np.full((len(has), size.max()), -1, np.int64)
    probes[np.arange(size.max()) < size[:, None]] = np.concatenate(has["probes"].tolist())
    both = (probes[j] == asks["home"].to_numpy()[i, None]).any(1)
    ids, place = np.unique(np.r_[ids_a, ids_b], return_inverse=True)
    pa_, pb = place[: len(ids_a)][i], place[len(ids_a) :][j]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, pa_, has["copies"].to_numpy()[j])
    np.add.at(links, pb[~both], asks["copies"].to_numpy()[i[~both]])
    touched = np.unique(np.r_[pa_, pb])
    return pd.DataFrame({"a": ids[touched], "b": ids[forest(pa_, pb, len(ids))[touched]], "links": links[touched]})


def vector_links(classes: DataFrame, width: int, least: float, sample: int, probes: int, exact: bool, lists: int | None, more: int | None) -> DataFrame:
    """(a, b, links) of classes (cls, label, vec, copies)."""
    spark = classes.sparkSession
    picked = classes.orderBy(F.xxhash64("cls", F.lit(1)), "cls").limit(sample).select("vec")
    rows = picked.mapInPandas(lambda parts: (pd.DataFrame({"head": list(heads(p["vec"], width))}) for p in parts), "head array<double>").toPandas()
    q = spark.sparkContext.broadcast(Quantiser(np.array(rows["head"].tolist()), classes.count(), lists=lists, more=1 if exact else more))
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x = heads(pdf["vec"], width)
                if exact:
                    home, near = q.value.reachable(x, reach)
                else:
                    near = q.value.nearest(x, probes)
                    home = near[:, 0]
                code, missed = q.value.encode(x, home)
                yield pdf.assign(d=pdf["vec"].map(len).astype(np.int32), home=home.astype(np.int32), probes=[p.astype(np.int32) for p in near], code=list(code.astype(np.int16)), missed=missed)

    vec = classes.schema["vec"].dataType.simpleString()
    index = stored(classes.mapInPandas(coded, f"cls long, label {classes.schema['label'].dataType.simpleString()}, vec {vec}, copies long, d int, home int, probes array<int>, code array<smallint>, missed double"))
    key = ["label", "d", "cell"]
    asks = index.select("label", "d", F.explode("probes").alias("cell"), "cls", "copies", "home", "vec")
    has = index.select("label", "d", F.col("home").alias("cell"), "cls", "copies", "home", "vec", "probes", "code", "missed")
    n_has = has.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_has"))
    n_asks = asks.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_asks"))
    blocks = cut(n_has.join(n_asks, key))
    part = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [*key, "i", "j", "query", "cls", "copies", "home", "vec", "probes", "code", "missed"]
    has = has.join(blocks, key).withColumns({"i": part("n_has"), "j": each("n_asks"), "query": F.lit(False)})
    asks = asks.join(blocks, key).withColumn("j", part("n_asks")).withColumn("i", each("n_has")).withColumns({"query": F.lit(True), "probes": F.lit(None).cast("array<int>"), "code": F.lit(None).cast("array<smallint>"), "missed": F.lit(None).cast("double")})
    both = has.select(*cols).unionByName(asks.select(*cols))
    return both.groupBy(*key, "i", "j").applyInPandas(lambda pdf: search_block(pdf, q.value, least), "a long, b long, links long")


def dedup_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", least: float = LEAST_COSINE, sample: int = SAMPLE, probes: int = PROBES, exact: bool = False, lists: int | None = None, more: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have one length, and their cosine is at least ``least``.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing. Equal vectors of a label
    are one class: they link with each other, and count each in n_links. component_id is the smallest id that links
    reach, the row's own included. Rows that repeat come back, alike. An empty frame gives an empty one.

    ``probes`` lists are searched for each vector, enough for the recall that README states; ``exact`` searches all that can matter and
    finds every link. ``lists`` and ``more`` set the centroids of the two levels, which follow from the number of vectors otherwise.
    """
    own = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vec}`").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    own = own.withColumn("cls", F.when(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), F.xxhash64("label", "vec")))
    rows = stored(own)
    valid = rows.where("cls IS NOT NULL")
    classes = stored(valid.groupBy("cls").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("least"), F.count("*").alias("copies")))
    longest = classes.agg(F.max(F.size("vec"))).first()[0]
    if longest is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(vector_links(classes.select("cls", "label", "vec", "copies"), min(longest, WIDTH), least, sample, probes, exact, lists, more))
    labels = components(links.select("a", "b"))
    linked = links.groupBy("a").agg(F.sum("links").alias("links"))
    per = classes.select("cls", "least", "copies").join(labels.withColumnRenamed("v", "cls"), "cls", "left").join(linked.withColumnRenamed("a", "cls"), "cls", "left")
    per = cut(per.select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # A component, or a class of equal vectors, may hold a third of all rows; vectors without a class are dealt out.
    smallest = cut(per.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")))
    final = cut(join_hot(per, smallest, ["root"], F.col("cls"), "classes").select("cls", "n_links", "component_id", "copies"))
    out = join_hot(rows.select("id", "cls"), final, ["cls"], F.xxhash64("id"), "copies")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
