"""The Merkle manifest against trees that are built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stocktake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_steps(levels, at):
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        yield at % 3, run[: at % 3] + run[at % 3 + 1 :]
        at //= 3


def plain_manifest(docs):
    by_source = {}
    for row in docs:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        rows = sorted(((plain_leaf(r, r[4]), r) for r in by_source[s]), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = rows, plain_tree([h for h, _ in rows])
    top = plain_tree([trees[s][1][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        rows, levels = trees[s]
        for i, (h, r) in enumerate(rows):
            steps = [*plain_steps(levels, i), *plain_steps(top, n)]
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = plain_leaf(r, r[4].replace("\n", "") if tampered else r[4])
            for place, others in steps:
                at = sha(*others[:place], at, *others[place:])
            out.append((r[0], h, levels[-1][0], top[-1][0], sha(*[x for _, o in steps for x in o]), at, at == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("seed", [1, 2])
def test_manifest_matches_trees_built_node_by_node(spark, tmp_path, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(1500):
        source = rng.choice(["hot"] * 6 + [None, "", "ä", "a", "Z"] + [f"s{k}" for k in range(25)])
        text = rng.choice([None, "", "a\nb", "é\n\n", "x" * 50_000 if i % 500 == 0 else "plain"])
        docs.append((None if i % 97 == 0 else i // 3 if i % 11 == 0 else i, source, rng.choice([None, "en"]), rng.choice([None, 3]), text, "clash"))
    docs += docs[:20]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = merkle.op13_merkle(spark, str(tmp_path))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == plain_manifest(docs)


def test_sources_of_one_row_and_many_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    docs = [(i, None if i == 4 else "big" if i % 3 else f"only{i}", "en", i, "a\nb", "x") for i in range(400)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = merkle.op13_merkle(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == plain_manifest(docs)


def test_one_row_and_none(spark, tmp_path):
    one = spark.createDataFrame([(7, "s", None, None, None, "x")], SCHEMA)
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == plain_leaf((7, "s", None, None), None) and row["proof"] == []
    assert merkle.manifest(one.limit(0)).count() == 0


def test_a_change_is_noticed(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "en", i, f"text {i}", "x") for i in range(60)], SCHEMA)
    found = merkle.manifest(docs, changed={"text": F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text"))})
    wrong = found.where(merkle.fold(F.col("other_leaf"), F.col("proof")) != F.col("root")).select("id").collect()
    assert [r["id"] for r in wrong] == [9]
