"""Periodic runs against a reading of every period at every place."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stocktake.llm import runs


def plain_runs(words, least, periods):
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                found.append((i - q, j - i + q, q))
            i = max(j, i + 1)
    inside = lambda r, o: o[2] < r[2] and o[0] <= r[0] and o[0] + o[1] >= r[0] + r[1]
    return sorted((r for r in found if not any(inside(r, o) for o in found)), key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    out = []
    for _ in range(draw(st.integers(1, 4))):
        root = draw(st.lists(st.integers(0, 3), min_size=1, max_size=9))
        out += (root * draw(st.integers(1, 12)))[: draw(st.integers(1, 60))]
    return [str(x).encode() for x in out]


@settings(max_examples=300, deadline=None)
@given(repetitive(), st.sampled_from([(24, 3), (15, 2), (16, 5)]))
def test_runs_match_a_reading_of_every_period(words, how):
    assert sorted(runs.document_runs(words, *how), key=lambda r: (r[0], r[2])) == plain_runs(words, *how)


def test_long_documents_and_one_word_alone():
    rng = random.Random(3)
    words = [str(rng.randrange(500)).encode() for _ in range(3000)]
    words[700:1900] = (words[700:1000] * 4)[:1200]
    assert runs.document_runs(words) == plain_runs(words, 24, 3) != []
    assert runs.document_runs([b"a"] * 5000) == [(0, 5000, 1)]
    assert runs.document_runs([b"a"] * 23) == runs.document_runs([]) == []


def test_extensions_are_those_of_suffixes():
    rng = random.Random(4)
    s = [rng.randrange(1, 3) for _ in range(60)]
    tree = runs.SuffixTree(s)
    tree.tour()
    ended = [*s, 0]
    assert sorted(range(61), key=lambda i: ended[i:]) == sorted(range(61), key=lambda i: tree.ranks[i])
    import numpy as np

    a, b = (x.ravel() for x in np.triu_indices(60, 1))
    far = [next(k for k in range(61) if ended[i + k] != ended[j + k]) for i, j in zip(a, b, strict=True)]
    assert tree.extensions(a, b).tolist() == far


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.fixture
def docs():
    rng = random.Random(7)
    texts = [None, "", " \n ", "one", "a " * 30, "x\x0by " * 40, "é b c " * 20]
    for _ in range(120):
        root = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        texts.append(rng.choice(" \n\t").join(rng.choice("ABCDEFG") for _ in range(rng.randrange(60))) + " " + " ".join((root * 9)[: rng.randrange(90)]) + " end")
    texts.append(" ".join(str(rng.randrange(900)) for _ in range(4000)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 40), (3, "one"), (10, "other " * 25)]
    return [(*r, "clash", 1) for r in rows]


def test_query_matches_a_plain_reading(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, runs string, id int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in runs.op11_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((plain_row(d[0], d[1]) for d in docs), key=str)
    assert got == want and sum(r[1] for r in want) > 20


def test_no_rows_and_wrong_parameters(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert runs.find_runs(none).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(none, least_periods=1)
