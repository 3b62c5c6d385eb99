import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stocktake.operators import suggest


def names_of(rng, n):
    """Names that are near others, some empty, long, with letters of which lower case differs in length, and with letters of one kind."""
    words = ["".join(rng.choice("abcdeř漢🎮İ ") for _ in range(rng.randrange(0, 14))) for _ in range(12)]
    edited = lambda x, k: x[:k] + rng.choice(["", "z", "ř"]) + x[k + 1 :]
    return [edited(rng.choice(words), rng.randrange(14)) + rng.choice(["", " (USA)", " (USA) (Rev 1)", "".join(rng.choice("xyz") for _ in range(70))]) for _ in range(n)]


def test_distances_in_bits(spark):
    from stocktake.operators import closeness

    rng = random.Random(7)
    a, b = ["".join(rng.choice("abcř") for _ in range(rng.randrange(1, 65))) for _ in range(60)] + ["x" * 64], ["".join(rng.choice("abcř") for _ in range(rng.randrange(0, 65))) for _ in range(60)] + ["x" * 64]
    bits = lambda x: dict(zip(closeness.BITS, (pa.array(v.view("int64")) for v in closeness.letter_bits(x))))
    side = lambda x: closeness.Side(pa.table({f"c_{k}": v for k, v in (bits(x) | {"text": x, "n": [len(t) for t in x]}).items()}), "c", 0.75, np.arange(len(x)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(61), np.arange(61)))
    pairs = spark.createDataFrame([(k, a[p], b[q]) for k, (p, q) in enumerate(zip(i.tolist(), j.tolist()))], "k long, a string, b string")
    want = [r["d"] for r in pairs.select("k", F.levenshtein("a", "b").alias("d")).orderBy("k").collect()]
    assert closeness.distances(side(a), side(b), i, j).tolist() == want
    # What is far by its distance goes no further.
    kept = set(closeness.close(side(a), side(b), i, j).tolist())
    assert kept == {k for k, d in enumerate(want) if d <= max(len(a[i[k]]), len(b[j[k]])) // 4}


def test_pairs_come_in_blocks_of_the_window(monkeypatch):
    from stocktake.operators import closeness

    rng = np.random.default_rng(3)
    low = rng.integers(0, 50, 400)
    high = low + rng.integers(-2, 30, 400)
    monkeypatch.setattr(closeness, "PAIRS", 37)
    parts = list(closeness.blocks(low, high))
    assert [x for i, j in parts for x in zip(i.tolist(), j.tolist())] == [(i, j) for i in range(400) for j in range(low[i], high[i])]
    assert len(parts) > 100 and max(len(i) for i, _ in parts) < 37 + 30 and not list(closeness.blocks(low[:0], high[:0]))


def test_close_pairs_are_returned_by_the_block(monkeypatch):
    from stocktake.operators import closeness

    monkeypatch.setattr(closeness, "PAIRS", 500)
    n, name = 60, "the same name"
    texts = {f"x_{k}": v for k, v in zip(closeness.BITS, (pa.array(v.view("int64")) for v in closeness.letter_bits([name] * n)))} | {"x_text": [name] * n, "x_n": [len(name)] * n, "near": [0] * n}
    left, right = pa.table(texts | {"size": list(range(n)), "a": [str(k) for k in range(n)]}), pa.table(texts | {"b_size": list(range(n)), "b": [str(k) for k in range(n)]})
    found = closeness.close_pairs(left, right, [("x", "x", 0.75)], 20, (["a"], ["b"]))
    assert sorted((int(r["a"]), int(r["b"])) for r in found.to_pylist()) == [(i, j) for i in range(n) for j in range(n) if abs(i - j) <= 20]
    assert len(found.to_batches()) > 3 and max(b.num_rows for b in found.to_batches()) <= 541


def test_close_names_are_all_found(spark, monkeypatch):
    rng = random.Random(5)
    sizes = lambda: rng.choice([0, 511, 512, 513, 1024, 1025, 5_000_000_000])
    a = spark.createDataFrame([(n + rng.choice(["", ".zip"]), sizes()) for n in names_of(rng, 300)] + [(None, 5), ("abc", None)], "local_name string, size long")
    b = spark.createDataFrame([(n, sizes()) for n in names_of(rng, 300)] + [(None, 5), ("abc", None)], "set_name string, size long")
    both = a.withColumnRenamed("size", "s").crossJoin(b).where("abs(s - size) <= 512").withColumn("x", suggest.similarity(suggest.local_title(F.col("local_name")), F.col("set_name"))).where(F.col("x") >= 0.75 - 1e-12)
    want = {(r["local_name"], r["set_name"], r["x"]) for r in both.collect()}
    for pairs in (1 << 20, 50):
        monkeypatch.setattr(suggest, "PAIRS", pairs)
        rows = suggest.near_names(a, b).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want) > 100


def test_comparisons_of_near_sizes_are_made_in_bulk(spark):
    """Rows of one size are compared in arrays: no join makes a row of every pair to look at it."""
    a, b = spark.createDataFrame([("abc.zip", 1)], "local_name string, size long"), spark.createDataFrame([("abc", 1)], "set_name string, size long")
    plan = suggest.near_names(a, b)._jdf.queryExecution().sparkPlan().toString()
    assert "CoGroups" in plan and "bit_count" not in plan


def plan_of(spark, name):
    import __spark_entry__

    return __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()


def test_best_names_come_from_comparisons_in_bulk(spark):
    plan = plan_of(spark, "W6_best_name")
    assert "CoGroups" in plan and "bit_count" not in plan


def test_renames_by_near_names_compare_in_bulk(spark, monkeypatch):
    seen, near_names = [], suggest.near_names
    monkeypatch.setattr(suggest, "near_names", lambda *a: seen.append(near_names(*a)) or seen[-1])
    plan_of(spark, "P1_near_names")
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in seen]
    assert plans and all("CoGroups" in plan and "bit_count" not in plan for plan in plans)
