"""Line dedup over the whole corpus.

A document's lines become hashes of their keys (stripped of ASCII white space at both ends, A-Z lower-cased), one row for each document
and key with the key's positions. The rows are range-partitioned by (hash, document) and sorted by (hash, document) within
a partition, so that each key is a run of rows that is read as a stream: a key that a third of all
documents have spans several partitions and never has to fit in memory. What comes back for a document is a compressed
bitmap of the lines that it keeps; its text moves only where a caller asks for the kept text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tasks

#: Fixed values of the query: keys of at least so many code points that at least so many documents have.
LEAST_CHARS, LEAST_DOCS = 1, 10
ROWS = 20_000


def line_rows(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[pa.RecordBatch]:
    """(id, id_hash, text_hash, text) -> (h1, h2, id, id_hash, text_hash, positions, n_lines)."""
    for batch in batches:
        rows: list[tuple] = []
        ids, id_hash, text_hash, texts = (batch.column(n) for n in ("id", "id_hash", "text_hash", "text"))
        at: list[int] = []
        counts: list[int] = []
        for i, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            own: dict[bytes, list[int]] = {}
            lines = (text or b"").split(b"\n")
            for p, line in enumerate(lines):
                key = line.strip().lower()
                if key and (least_chars <= 1 or len(key.decode()) >= least_chars):
                    own.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(p)
            rows.extend((d, v) for d, v in own.items())
            at.extend([i] * len(own))
            counts.extend([len(lines)] * len(own))
            if len(rows) >= ROWS or i == len(texts) - 1:
                take = pa.array(at, pa.int64())
                h = np.frombuffer(b"".join(d for d, _ in rows), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), ids.take(take), id_hash.take(take), text_hash.take(take), pa.array([v for _, v in rows], pa.list_(pa.int32())), pa.array(counts, pa.int32())],
                    ["h1", "h2", "id", "id_hash", "text_hash", "positions", "n_lines"],
                )
                rows, at, counts = [], [], []


def edge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first and last key, with their documents: two rows at most."""
    part, runs = TaskContext.get().partitionId(), []
    for batch in batches:
        h1, h2, doc = (batch.column(n).to_numpy() for n in ("h1", "h2", "id_hash"))
        if not len(h1):
            continue
        for key, n, first, last in summed(h1, h2, doc):
            if runs and runs[-1][0] == key:
                runs[-1][1] += n - (runs[-1][2] == first)
                runs[-1][2] = last
            else:
                runs.append([key, n, last])
                del runs[1:-1]
    yield pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array([r[0][0] for r in runs], pa.int64()), pa.array([r[0][1] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.int64())], ["part", "h1", "h2", "n"])


def summed(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> Iterator[tuple[tuple[int, int], int, int, int]]:
    """(key, documents, first document, last document) of the first and the last run of a sorted batch."""
    new = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    bounds = np.r_[new, len(h1)]
    for k in {0: 0, len(new) - 1: 0}:
        a, b = bounds[k], bounds[k + 1]
        yield (int(h1[a]), int(h2[a])), 1 + int(np.count_nonzero(doc[a + 1 : b] != doc[a : b - 1])), int(doc[a]), int(doc[b - 1])


def repeated_rows(batches: Iterator[pa.RecordBatch], edges: dict[tuple[int, int], tuple[int, int]], least_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose key ``least_docs`` documents have; with ``keep_first``, without the first position of the first of them.

    A run's rows are held back only until the run is known to be long enough: ``least_docs`` documents' rows at most.
    """
    part = TaskContext.get().partitionId()
    key, seen, doc, last, held, fresh = None, 0, None, None, [], False

    for batch in batches:
        out: list[tuple[int, int, list[int], int]] = []
        cols = [batch.column(n).to_pylist() for n in ("h1", "h2", "id_hash", "text_hash", "positions", "n_lines")]
        for h1, h2, d, t, positions, n in zip(*cols, strict=True):
            if (h1, h2) != key:
                key, doc, last, held = (h1, h2), None, None, []
                total, home = edges.get(key, (0, part))
                seen, fresh = total, keep_first and home == part
                counting = total == 0
            if (d, t) == last:
                continue  # the same row again
            last = d, t
            if counting and d != doc:
                seen += 1
            if fresh and doc is None:
                positions = positions[1:]
            doc = d
            held.append((d, t, positions, n))
            if seen >= least_docs:
                out.extend(held)
                held = []
            elif not counting:
                held = []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32())), pa.array([r[3] for r in out], pa.int32())], ["id_hash", "text_hash", "positions", "n_lines"])


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for n, lost in zip(batch.column("n_lines").to_pylist(), batch.column("lost").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.concatenate([np.asarray(p, np.int64) for p in lost])] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("id_hash"), batch.column("text_hash"), batch.column("n_lines"), pa.array(packed, pa.binary())], ["id_hash", "text_hash", "n_lines", "keep"])


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """The lines to keep, as booleans; all of them where there is no bitmap."""
    return np.ones(n, bool) if bitmap is None else np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keep_first: bool = False) -> DataFrame:
    """(id_hash, text_hash, n_lines, keep) for each distinct (id, text) that loses a line; ``keep`` is a zlib-packed bitmap, first line first.

    Documents are counted by id: rows that repeat an id count once, and rows without an id are one document. Null text is one empty line, empty lines have no key,
    texts of any length are read whole. ``keep_first`` spares each key's first occurrence by id and position.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`").alias("id_hash"), F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    rows = own.mapInArrow(lambda b: line_rows(b, least_chars), f"h1 long, h2 long, id {id_type}, id_hash long, text_hash long, positions array<int>, n_lines int")
    # A range by (hash, document) splits the rows of a frequent key; equal (hash, document) stay together.
    order = ["h1", "h2", "id", "id_hash"]
    ranged = cut(rows.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order, "text_hash"))
    edges = ranged.mapInArrow(edge_runs, "part int, h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("part").alias("home")).collect()  # two rows for each partition at most
    known = docs.sparkSession.sparkContext.broadcast({(r["h1"], r["h2"]): (r["n"], r["home"]) for r in edges})
    drop = ranged.mapInArrow(lambda b: repeated_rows(b, known.value, least_docs, keep_first), "id_hash long, text_hash long, positions array<int>, n_lines int")
    lost = drop.where(F.size("positions") > 0).groupBy("id_hash", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.collect_list("positions").alias("lost"))
    return lost.mapInArrow(bitmaps, "id_hash long, text_hash long, n_lines int, keep binary")


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with keep: the bitmap, null where all lines stay. All rows come back, repeated ones too."""
    own = docs.drop("keep").withColumns({"__id": F.xxhash64(f"`{id_col}`"), "__text": F.xxhash64(f"`{text}`")})
    maps = keep_bitmaps(own, id_col, text, **how).select(F.col("id_hash").alias("__id"), F.col("text_hash").alias("__text"), "keep")
    return own.join(maps, ["__id", "__text"], "left").drop("__id", "__text")


def kept_text(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """(lines, lines dropped, the lines that stay, joined)."""
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return len(lines), 0, text or b""
    keep = unpack(bitmap, len(lines))
    return len(lines), int(len(lines) - keep.sum()), b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kept_text(t, k) for t, k in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("keep").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for _, _, t in found], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_bitmaps(docs).select("doc_id", "text", "keep").mapInArrow(digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def oracle() -> str:
    from .common import UPPER

    return f"""
WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS p, unnest(lines) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{UPPER.lower()}') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM (SELECT k.*, f.key IS NOT NULL AS lost FROM k LEFT JOIN f ON k.key = f.key) GROUP BY doc_id"""
