"""Periodic runs: stretches of words that repeat with a period, found by suffix trees.

A run is given by its period's Lyndon word: for one of two opposite orders of words, the longest Lyndon word at some place of the
run is exactly one period long. So each place's longest Lyndon word under both orders (up to the next smaller suffix) is a
candidate, and longest common extensions to the right and to the left say how far its period goes on. Suffixes are ranked, and extensions to the right
are read, in Ukkonen's suffix tree of the words, extensions to the left in the tree of their reversal: the extension of two
places is the depth of their leaves' lowest common ancestor, a minimum over the tree's Euler tour in constant time.

Trees are built over the stretches of a document that can hold a run at all. In a run of period q and length n each five words from
its second period on stand q words before as well, and q is at most 1 / exponent of n, so runs lie where
many consecutive places repeat five words from not far before (``stretches``; nothing else is left out). A tree takes some 700 bytes for each word of its stretch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, table

#: Fixed values of the query: least words of a run, and least length in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that a place and an earlier one share before their stretch is looked at.
SHARED = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(ids: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Disjoint ranges of places that hold all runs.

    In a run from s to e with period q, places s + q to e - SHARED have their next ``SHARED`` words q places before. They are consecutive, at
    least (periods - 1) * q - SHARED + 1 of them, so q is at most (m + SHARED - 1) / (periods - 1) of any m consecutive places around them. Places whose
    last occurrence is farther away than that belong to no such run; leaving them out makes m smaller, until nothing changes.
    """
    n = len(ids) - SHARED + 1
    if len(ids) < least:
        return []
    code = np.zeros(n, np.uint64)
    for k in range(SHARED):
        code = (code ^ (code >> np.uint64(29))) * MIX + ids[k : k + n].astype(np.uint64)
    order = np.argsort(code, kind="stable")
    back = np.full(n, n, np.int64)  # places to the last occurrence; equal codes of unequal words only add candidates
    same = code[order[1:]] == code[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    near = back < n
    fewest = -(-least * (periods - 1) // periods) - SHARED + 1
    while True:
        edges = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        first, after = edges[::2], edges[1::2]
        m = after - first
        most = (m + SHARED - 1) // (periods - 1)
        at = np.flatnonzero(near)
        far = at[back[at] > np.repeat(most, m)]
        if not len(far):
            break
        near[far] = False
    found: list[tuple[int, int]] = []
    for a, b, q in zip(first.tolist(), after.tolist(), most.tolist(), strict=True):
        if b - a >= fewest:
            a, b = max(a - q, 0), b + SHARED - 1
            while found and a <= found[-1][1]:
                c, d = found.pop()
                a, b = min(a, c), max(b, d)
            found.append((a, b))
    return found


class SuffixTree:
    """Ukkonen's tree of a sequence of positive numbers; 0, smaller than all, ends it. Leaves come in the order of their suffixes."""

    def __init__(self, sequence: list[int]):
        self.symbols = s = [*sequence, 0]
        n = len(s)
        self.start, self.end = start, end = [0], [0]
        self.below: list[dict[int, int] | None] = [{}]
        below = self.below
        link = [0]
        node = along = edge = pending = 0  # the active place: ``along`` symbols down the edge that starts with s[edge]
        for i, c in enumerate(s):
            pending += 1
            fresh = 0  # the inner node of this step that waits for its link
            while pending:
                if not along:
                    edge = i
                here = below[node]
                child = here.get(s[edge])
                if child is None:
                    here[s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    below.append(None)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    size = (end[child] if end[child] < i + 1 else i + 1) - start[child]
                    if along >= size:
                        node, along, edge = child, along - size, edge + size
                        continue
                    begin = start[child]
                    if s[begin + along] == c:
                        if fresh:
                            link[fresh] = node
                        along += 1
                        break
                    inner, leaf = len(start), len(start) + 1
                    here[s[edge]] = inner
                    start += (begin, i)
                    end += (begin + along, n)
                    link += (0, 0)
                    below += ({s[begin + along]: child, c: leaf}, None)
                    start[child] = begin + along
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                pending -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = i - pending + 1

    def tour(self) -> None:
        """The Euler tour: ``depths`` in symbols of its nodes, ``first`` is each suffix's leaf in it; ``ranks`` of suffixes, and under the opposite order of symbols."""
        n = len(self.symbols)
        start, end, below = self.start, self.end, self.below
        depths: list[int] = []
        first = [0] * n
        ranks, opposite = [0] * n, [0] * n
        todo, rank = [(0, 0)], 0
        while todo:
            node, depth = todo.pop()
            depths.append(depth)
            if node < 0:
                continue
            children = below[node]
            if children is None:
                first[n - depth] = len(depths) - 1
                ranks[n - depth] = rank
                rank += 1
                continue
            back = (-1, depth)
            for c in sorted(children, reverse=True):
                child = children[c]
                todo.append(back)
                todo.append((child, depth + end[child] - start[child]))
        todo, rank = [(0, 0)], 0
        while todo:
            node, depth = todo.pop()
            children = below[node]
            if children is None:
                opposite[n - depth] = rank
                rank += 1
                continue
            for c in sorted(children):
                child = children[c]
                if c:
                    todo.append((child, depth + end[child] - start[child]))
            if 0 in children:
                child = children[0]
                todo.append((child, depth + end[child] - start[child]))
        self.depths, self.first, self.ranks, self.opposite = np.array(depths, np.int32), np.array(first), ranks, opposite

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the suffixes at a and b (never equal) agree, each by two looks at a table of minima; the table's levels are made one after the other, and let go."""
        u, v = np.minimum(self.first[a], self.first[b]), np.maximum(self.first[a], self.first[b]) + 1
        level = np.log2(v - u).astype(np.int64)
        out = np.zeros(len(a), np.int64)
        by = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by], np.arange(level.max(initial=-1) + 2))
        least = self.depths
        for k in range(len(bounds) - 1):
            if k:
                least = np.minimum(least[: -(1 << (k - 1))], least[1 << (k - 1) :])
            at = by[bounds[k] : bounds[k + 1]]
            out[at] = np.minimum(least[u[at]], least[v[at] - (1 << k)])
        return out


def next_smaller(ranks: list[int], n: int) -> list[int]:
    """For each place the next one whose suffix is smaller: the longest Lyndon word at the place ends there."""
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, ranks[i]
        while j < n and ranks[j] > own:
            j = after[j]
        after[i] = j
    return after


def runs_of(ids: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of positive numbers, by start and period."""
    n = len(ids)
    ahead, behind = SuffixTree(ids), SuffixTree(ids[::-1])
    ahead.tour()
    behind.tour()
    place = np.arange(n)
    found = set()
    for ranks in (ahead.ranks, ahead.opposite):
        period = np.array(next_smaller(ranks, n)) - place
        i = np.flatnonzero((period * periods <= n) & (place + period < n))
        p = period[i]
        right = ahead.extensions(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        left[inner] = behind.extensions(n - i[inner], n - i[inner] - p[inner])
        start, length = i - left, left + p + right
        fit = length >= np.maximum(least, periods * p)
        found.update(zip(start[fit].tolist(), length[fit].tolist(), p[fit].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def document_runs(words: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of a document's runs, by start and period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)
    found = []
    for a, b in stretches(ids, least, periods):
        found += [(a + s, n, p) for s, n, p in runs_of(ids[a:b].tolist(), least, periods)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what a run repeats: of each run its first period stays, unless another run drops it."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, n, p in runs:
        drop[start + p] += 1
        drop[start + n] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, exactly; of equal ones the first, then that of the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def read_runs(batches: Iterator[pa.RecordBatch], least: int, periods: int, change: Callable | None) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    told = lambda r: r and {"start": r[0], "length": r[1], "period": r[2]}
    for batch in batches:
        every, best, texts = [], [], []
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
            words = (t or b"").split()
            if change is not None:
                words = change(i, words)
            runs = document_runs(words, least, periods)
            every.append([told(r) for r in runs])
            best.append(told(strongest(runs)))
            texts.append(b" ".join(collapsed(words, runs)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(every, pa.list_(run)), pa.array(best, run), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "strongest", "collapsed"])


RUN = "struct<start:long,length:long,period:long>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, change: Callable | None = None) -> DataFrame:
    """(id, runs, strongest, collapsed) for each row of ``docs``: all runs of at least so many words and periods (two or more), the one of most periods, and the text's words, joined by spaces, without what runs repeat.

    Null and empty texts have no words and no run. Rows are read one by one: repeated rows agree, ids may be null, other columns are ignored. ``change`` (id, words)
    gives other words to search.
    """
    if least_periods < 2 or least_words < 3 * SHARED:
        raise ValueError("runs have two periods and fifteen words at least")
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(lambda b: read_runs(b, least_words, least_periods, change), f"id {kind}, runs array<{RUN}>, strongest {RUN}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's periods: one document in ten, by its id, repeats from some word on; one without an id stays."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * ((n - a) // p + 1))[: n - a]


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), change=planted)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("strongest.length * 1000 DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """The same by all pairs of equal words of a document: consecutive pairs of one distance are a run of that period."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {crc32_sql('doc_id')} AS h FROM documents),
s AS (SELECT *, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS is_planted, CASE WHEN len(ws) > 0 THEN h // 10 % len(ws) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS per FROM s),
d AS (SELECT doc_id, n, CASE WHEN is_planted THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % per ELSE i END + 1]) ELSE ws END AS ws FROM p),
k AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word, n FROM d),
m AS (SELECT x.doc_id, x.i, x.i - y.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, x.i - y.i ORDER BY x.i) AS island
  FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND (x.i - y.i) * {LEAST_PERIODS} <= x.n),
c AS (SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST_WORDS}, {LEAST_PERIODS} * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND o.start <= c.start AND o.start + o.length >= c.start + c.length)),
b AS (SELECT doc_id, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'q': q}}, (CAST(length AS DOUBLE) / q, -start, -q)) AS top, string_agg(concat(start, ',', length, ',', q, chr(10)), '' ORDER BY start, q) AS told FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.i = gone.i WHERE gone.i IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
