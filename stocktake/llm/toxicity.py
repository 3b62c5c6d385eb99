"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is its hashed embedding beside the sum of its character trigrams' embeddings. Two gated recurrent
layers read a window of words in both directions, attention pools their states, and a logistic unit scores the window. A
text's score is that of its highest window; windows overlap by half and cover the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import LOWER, mixed

#: Fixed values of the query: rows whose crc32 of the id, modulo FOLDS, is HELD_OUT are no training rows; the cut of the score.
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: The network is fitted on at most so many labelled toxic rows and twice as many clean ones, the first by a hash of the id.
SAMPLE = 600
#: Texts of more characters are scored whole like all others, but not learned from, so what reaches the driver is bounded.
LONGEST = 16_384
#: Words in a window and between windows' starts.
WINDOW, STRIDE = 16, 8
WORD_ROWS, CHAR_ROWS, DIM, HIDDEN, ATTEND = 1 << 13, 1 << 13, 8, 8, 8
CHUNK = 4096
#: Steps of a round at least, where the labelled rows are few.
LEAST_STEPS = 40

IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True


class Words:
    """The words of a batch of texts: ``ids`` into the distinct words, of which it keeps bucket and trigrams; ``ends`` per text."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        low = LOWER[data]
        word = IS_WORD[low]
        first = word.copy()
        first[1:] &= ~word[:-1]
        starts = np.flatnonzero(first)
        last = word.copy()
        last[:-1] &= ~word[1:]
        stops = np.flatnonzero(last) + 1
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.ends = np.searchsorted(starts, bounds)
        if not len(starts):
            self.ids = np.empty(0, np.int64)
            self.bucket = self.tri = self.tri_at = np.empty(0, np.int64)
            return
        place = np.arange(len(low)) - np.repeat(starts, np.diff(np.r_[starts, len(low)]))[: len(low)] if starts[0] == 0 else np.arange(len(low)) - np.r_[np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.r_[starts, len(low)]))]
        powers = np.cumprod(np.full(int((stops - starts).max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        terms = (low.astype(np.uint64) + np.uint64(1)) * powers[np.where(word, place, 0)]
        terms[~word] = 0
        hashes = mixed(np.add.reduceat(terms, starts))
        uniq, at, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (uniq % np.uint64(WORD_ROWS)).astype(np.int64)
        size = stops[at] - starts[at]
        self.tri_at = np.r_[0, np.cumsum(size)[:-1]]
        i = np.arange(size.sum()) - np.repeat(self.tri_at, size)
        pos, n = np.repeat(starts[at], size) + i, np.repeat(size, size)
        left = np.where(i > 0, low[np.maximum(pos - 1, 0)], 0).astype(np.uint64)
        right = np.where(i < n - 1, low[np.minimum(pos + 1, len(low) - 1)], 1).astype(np.uint64)
        self.tri = (mixed((left << np.uint64(16)) | (low[pos].astype(np.uint64) << np.uint64(8)) | right) % np.uint64(CHAR_ROWS)).astype(np.int64)
        self.scale = (1 / np.sqrt(size)).astype(np.float32)[:, None]

    def embed(self, p: dict, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of the distinct words (or of the ``used`` ones), with their trigrams and where each word's begin."""
        used = np.arange(len(self.bucket)) if used is None else used
        size = np.diff(np.r_[self.tri_at, len(self.tri)])[used]
        at = np.r_[0, np.cumsum(size)[:-1]]
        tri = self.tri[np.repeat(self.tri_at[used] - at, size) + np.arange(size.sum())]
        return np.hstack([p["word"][self.bucket[used]], np.add.reduceat(p["char"][tri], at) * self.scale[used]]), tri, at

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, text) of every window: a start at every STRIDE words, the last one moved back to end with the text."""
        begin = np.r_[0, self.ends[:-1]]
        n = self.ends - begin
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = begin[text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
        return start, np.minimum(n[text], WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def new_network(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = 2 * DIM, HIDDEN
    make = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    p = {"word": make(WORD_ROWS, DIM), "char": make(CHAR_ROWS, DIM), "att": make(2 * h, ATTEND), "att_b": make(ATTEND, k=0), "att_v": make(ATTEND), "out": make(2 * h), "out_b": np.float32([-1.0])}
    for side in "fb":
        p |= {f"in_{side}": make(d, 3 * h), f"rec_{side}": make(h, 3 * h), f"bias_{side}": np.zeros(3 * h, np.float32)}
    return p


def recur(gates: np.ndarray, rec: np.ndarray, mask: np.ndarray, reverse: bool, keep: list | None = None) -> np.ndarray:
    """States of a gated recurrent layer for inputs already multiplied by its input weights; a masked step leaves the state."""
    b, t, h3 = gates.shape
    h = h3 // 3
    state, states = np.zeros((b, h), np.float32), np.empty((b, t, h), np.float32)
    for i in range(t - 1, -1, -1) if reverse else range(t):
        g, u = gates[:, i], state @ rec
        zr = sigmoid(g[:, : 2 * h] + u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(g[:, 2 * h :] + r * u[:, 2 * h :])
        m = mask[:, i, None]
        new = state + m * (1 - z) * (n - state)
        if keep is not None:
            keep.append((i, state, z, r, n, u[:, 2 * h :], m))
        state = states[:, i] = new
    return states


def recur_back(d_states: np.ndarray, rec: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    b, t, h = d_states.shape
    d_gates, d_rec, carry = np.zeros((b, t, 3 * h), np.float32), np.zeros_like(rec), np.zeros((b, h), np.float32)
    for i, state, z, r, n, un, m in reversed(keep):
        d = (d_states[:, i] + carry) * 1
        dm = d * m
        dn = dm * (1 - z) * (1 - n * n)
        dz = -dm * (n - state) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        d_gates[:, i] = np.hstack([dz, dr, dn])
        du = np.hstack([dz, dr, dn * r])
        d_rec += state.T @ du
        carry = d - dm * (1 - z) + du @ rec.T
    return d_gates, d_rec


def forward(p: dict, gates: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    kept = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
    h = np.concatenate([recur(gates[s], p[f"rec_{s}"], mask, s == "b", kept[s]) for s in "fb"], 2)
    a = np.tanh(h @ p["att"] + p["att_b"])
    score = np.where(mask > 0, a @ p["att_v"], np.float32(-1e9))
    w = np.exp(score - score.max(1, keepdims=True))
    w /= w.sum(1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", w, h)
    if keep is not None:
        keep.update(kept=kept, h=h, a=a, w=w, pooled=pooled)
    return pooled @ p["out"] + p["out_b"][0]


def backward(p: dict, keep: dict, d_logit: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the weights, and of the gates' inputs."""
    h, a, w, pooled = keep["h"], keep["a"], keep["w"], keep["pooled"]
    g = {"out": pooled.T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    dw = np.einsum("bh,bth->bt", d_pooled, h)
    ds = w * (dw - (w * dw).sum(1, keepdims=True))
    da = ds[:, :, None] * p["att_v"] * (1 - a * a)
    g |= {"att_v": np.einsum("bt,bta->a", ds, a), "att": np.einsum("bth,bta->ha", h, da), "att_b": da.sum((0, 1))}
    dh = w[:, :, None] * d_pooled[:, None, :] + da @ p["att"].T
    d_gates = {}
    for k, s in enumerate("fb"):
        d_gates[s], g[f"rec_{s}"] = recur_back(dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], p[f"rec_{s}"], keep["kept"][s])
    return g, d_gates


def loss_gradients(p: dict, words: Words, start: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean weighted logistic loss of windows, and its gradients."""
    at = np.minimum(start[:, None] + np.arange(WINDOW), len(words.ids) - 1)
    mask = (np.arange(WINDOW) < size[:, None]).astype(np.float32)
    ids = words.ids[at]
    used, ids = np.unique(ids, return_inverse=True)
    ids = ids.reshape(at.shape)
    x, tri, tri_at = words.embed(p, used)
    gates = {s: (x @ p[f"in_{s}"] + p[f"bias_{s}"])[ids] for s in "fb"}
    keep: dict = {}
    logit = forward(p, gates, mask, keep)
    prob = sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / total)
    g, d_gates = backward(p, keep, (weight * (prob - label) / total).astype(np.float32))
    dx = np.zeros_like(x)
    for s in "fb":
        flat = np.zeros((len(used), 3 * HIDDEN), np.float32)
        order = np.argsort(ids, axis=None, kind="stable")
        flat += np.add.reduceat(d_gates[s].reshape(-1, 3 * HIDDEN)[order], np.searchsorted(ids.ravel()[order], np.arange(len(used))))
        g[f"in_{s}"], g[f"bias_{s}"] = x.T @ flat, flat.sum(0)
        dx += flat @ p[f"in_{s}"].T
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], words.bucket[used], dx[:, :DIM])
    np.add.at(g["char"], tri, np.repeat(dx[:, DIM:] * words.scale[used], np.diff(np.r_[tri_at, len(tri)]), 0))
    return loss, g


def score_windows(p: dict, words: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    x, _, _ = words.embed(p)
    table_ = {s: x @ p[f"in_{s}"] + p[f"bias_{s}"] for s in "fb"}
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), CHUNK):
        st, n = start[i : i + CHUNK], size[i : i + CHUNK]
        ids = words.ids[np.minimum(st[:, None] + np.arange(WINDOW), len(words.ids) - 1)]
        out[i : i + CHUNK] = sigmoid(forward(p, {s: table_[s][ids] for s in "fb"}, (np.arange(WINDOW) < n[:, None]).astype(np.float32)))
    return out


def score_texts(p: dict, texts: list[bytes | None]) -> np.ndarray:
    """The highest window's score of each text; 0 for a text without words. Texts go in pieces of about 1 MB, so memory does not follow the batch."""
    scores, i = np.zeros(len(texts)), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 1 << 20):
            size += len(texts[j] or b"")
            j += 1
        words = Words([t or b"" for t in texts[i:j]])
        if len(words.ids):
            start, n, text = words.windows()
            np.maximum.at(scores, i + text, score_windows(p, words, start, n))
        i = j
    return scores


def top_windows(score: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Which windows are among the ``most`` highest of their text."""
    order = np.lexsort((-score, text))
    rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    top = np.zeros(len(text), bool)
    top[order[rank < most]] = True
    return top


def fit(texts: list[bytes], toxic: list[int], seed: int = 0, rounds: int = 6, batch: int = 512, rate: float = 0.02) -> dict[str, np.ndarray]:
    """First windows have their text's label; then the windows that the network finds most toxic stand for their texts.

    A round takes two windows of each toxic text, and of each clean one its four highest beside a few drawn at random;
    the high windows of clean texts stay in all later rounds.
    """
    p, rng = new_network(seed), np.random.default_rng(seed)
    # A window of one word over and over says more than any real one: each clean text lends a few of its words as such texts.
    clean = [t for t, y in zip(texts, toxic, strict=True) if not y and t and t.split()]
    said = [t.split() for t in clean]
    texts = [*texts, *((w[rng.integers(len(w))] + b" ") * WINDOW for w in said for _ in range(2))]
    toxic = [*toxic, *[0] * (len(texts) - len(toxic))]
    words = Words([t or b"" for t in texts])
    if not len(words.ids) or len(set(toxic)) < 2:
        p["out"][:] = 0
        p["out_b"][:] = -4 if not any(toxic) else 4
        return p
    start, size, text = words.windows()
    label = np.asarray(toxic, np.float32)[text]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, hard = 0, np.zeros(len(start), bool)
    for turn in range(rounds):
        drawn = top_windows(rng.random(len(start)), text, 8 if not turn else 2)
        if turn:
            score = score_windows(p, words, start, size)
            hard |= (label == 0) & top_windows(score, text, 4) & (score > 0.02)
            drawn = hard | (drawn & (label == 0)) | ((label == 1) & top_windows(score, text, 2))
        use = np.flatnonzero(drawn)
        many = (label[use] == 0).sum() / max(1, (label[use] == 1).sum())
        parts = max(1, len(use) // batch)
        for _ in range(max(2, -(-LEAST_STEPS // parts))):
            for part in np.array_split(rng.permutation(use), parts):
                weight = np.where(label[part] == 1, np.float32(min(many, 4.0)), np.float32(1))
                _, g = loss_gradients(p, words, start[part], size[part], label[part], weight)
                step += 1
                for k, v in p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] * g[k] - s)
                    v -= (rate / (1 + turn)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return p


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """(key, text, label) of at most ``sample`` toxic texts and twice as many clean ones, none held out and none over ``longest``."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("label"))
    picked = None
    for value in (1, 0):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(sample if value else 2 * sample)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.withColumnRenamed(key, "__key")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    return own.join(F.broadcast(picked), F.col("key") == F.col("__key")).groupBy("key").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fitted(rows: DataFrame, seed: int = 0) -> dict[str, np.ndarray]:
    """The network fitted on ``training_rows``. The fit runs in a task, on that bounded sample in the order of its keys; the weights alone come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            toxic += batch.column("label").to_pylist()
        p = fit(texts, toxic, seed=seed)
        yield pa.RecordBatch.from_arrays([pa.array(list(p)), pa.array([v.astype(np.float32).tobytes() for v in p.values()], pa.binary()), pa.array([list(v.shape) for v in p.values()], pa.list_(pa.int32()))], ["name", "data", "shape"])

    made = rows.repartition(1).sortWithinPartitions("key").mapInArrow(run, "name string, data binary, shape array<int>").collect()
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in made} if made else fit([], [], seed=seed)  # no rows, no task


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """``docs`` with score (double, 0 to 1), replacing a column of that name.

    Null and wordless texts score 0. Rows with equal texts score alike. All windows of texts of any length are scored.
    With no labelled rows, or labels of one kind, every text with words gets the same low (or high) score.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fitted(training_rows(docs, labels, key, text, sample=sample), seed))
    own = docs.drop("score")
    at = own.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(weights.value, batch.column(at).cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return own.mapInArrow(run, StructType(list(own.schema.fields)).add("score", DoubleType()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
