"""What references reach, against a walk from each node."""

import random

import pytest

from stocktake.operators import families


def walked(edges):
    out = set()
    for start in {a for a, _ in edges}:
        front = {start}
        while front := {b for a, b in edges if a in front and (start, b) not in out}:
            out |= {(start, b) for b in front}
    return out


@pytest.mark.parametrize("levels", [32, 3])
def test_closure_equals_walks(spark, monkeypatch, levels):
    monkeypatch.setattr(families, "LEVELS", levels)
    monkeypatch.setattr(families, "LOOKS_BACK", (2, 5))
    rng = random.Random(levels)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(12)} | {(100 + i, 101 + i) for i in range(7)} | {(7, 7)}
    got = families.closure(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
    assert sorted(tuple(r) for r in got) == sorted(walked(edges))


def test_pairs_come_from_references_alone(spark, monkeypatch):
    """A tree of references with a node that refers to itself: no table that is stored on the way has a pair twice as often as there are levels."""
    stored, real = [], families.cut
    monkeypatch.setattr(families, "cut", lambda df: (lambda out: (stored.append(out.count()), out)[1])(real(df)))
    edges = spark.range(0, 3000).selectExpr("id AS src", "CAST(floor(id / 3) AS BIGINT) AS dst")
    n = families.closure(edges).count()
    assert n <= sum(stored) < n + 3000
