"""The pipeline's stages on small tables, and the whole run against plain versions of what each stage keeps."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stocktake.llm import mixing, sharding
from test_operators import plain_jaccard, plain_leaks, words_text

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(31)
    bad = ["zorgaba", "zorgelo", "zorgimi", "vilefut", "vilekam"]
    bench = [(i, words_text(rng, 24, 9000)) for i in range(6)]
    texts, toxic = [], []
    for i in range(420):
        w = words_text(rng, rng.randrange(25, 90), 300).split()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad)
        elif i % 9 == 1:
            q = bench[i % 6][1].split()
            w[5:5] = q[4:18]
        elif i % 9 == 2 and i > 100:
            w = texts[i - 99 - (i - 99) % 4 + 1].split()  # a copy of a clean text, with a word more
            w.append("tail")
        texts.append(" ".join(w))
        toxic.append(int(i % 4 == 0))
    texts += [None, "", " \t"]
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, bench, toxic


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_the_whole_run_equals_plain_stages(spark, corpus):
    path, rows, bench, toxic = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, path))
        kept[name] = docs
    clean = ids(kept["toxicity"])
    held = [i for i in range(420) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {420, 421, 422} <= set(clean) and sum((i in clean) != bool(toxic[i]) for i in held) >= 0.95 * len(held)
    by_id = {r[0]: r for r in rows}
    classes = plain_jaccard([by_id[i][1] for i in clean])
    apart = [i for i, (k, n, root, _) in zip(clean, classes, strict=True) if not n or root == k]
    assert ids(kept["jaccard_join"]) == apart and len(apart) < len(clean) - 5
    pure = [i for i in apart if not plain_leaks(by_id[i][1], bench)[1]]
    assert ids(kept["decontamination"]) == pure and len(pure) < len(apart) - 5
    taken, size = Counter(ids(kept["mixing"])), {i: len((by_id[i][1] or "").split()) for i in pure}
    assert set(taken) <= set(pure) and max(taken.values()) <= 2
    per = {s: sum(size[i] for i in pure if by_id[i][3] == s) for s in {r[3] for r in rows}}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(per))}
    full = {s for s in per if not per[s]}
    while True:
        level = (1.5 * sum(per.values()) - sum(2 * per[s] for s in full)) / sum(weight[s] for s in per if s not in full)
        more = full | {s for s in per if level * weight[s] >= 2 * per[s]}
        if more == full:
            break
        full = more
    for s in per:
        words = sum(size[i] * n for i, n in taken.items() if by_id[i][3] == s)
        assert abs(words - min(2 * per[s], level * weight[s])) <= max(size.values())
    placed = kept["sharding"].collect()
    claimed = sharding.fill_table(sharding.SHARDS, sharding.prime_above(sharding.SLOTS_PER_SHARD * len(sharding.SHARDS)))
    assert Counter(r["doc_id"] for r in placed) == taken
    for r in placed:
        slot = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16) % len(claimed)
        assert (r["slot"], r["shard"], r["shard_name"]) == (slot, claimed[slot], sharding.SHARDS[claimed[slot]])
    assert all(k.columns == ["doc_id", "text", "lang", "source", "n_chars"] for n, k in kept.items() if n != "sharding")
    run = corpus_pipeline.run(spark, path)
    assert Counter(map(tuple, run.select("doc_id", "shard").collect())) == Counter((r["doc_id"], r["shard"]) for r in placed)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_nulls_repeats_nothing_and_clashing_columns(spark, corpus, name):
    path, rows, bench, _ = corpus
    stage = dict(corpus_pipeline.STAGES)[name]
    clean = next(r for r in rows if r[0] % 4 and not plain_leaks(r[1], bench)[1])
    leak = next(r for r in rows if r[0] % 4 and plain_leaks(r[1], bench)[1])
    some = [clean, clean, (None, None, None, None, None), (None, "", None, None, None), (7_000_000, clean[1], "de", "x", None), (None, clean[1], None, None, 3), leak, (8_000_000, "one two three " * 3000, "en", "x", 1), (8_000_000, "another text of this id", "en", "x", 1)]
    docs = spark.createDataFrame(some, DOCS).withColumns({c: F.lit(1) for c in ("score", "leak_items", "slot", "cls", "g", "n", "m", "copies", "hash", "id", "size", "key", "spans", "n_shingles")})
    out = stage(spark, docs, path)
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert stage(spark, docs.limit(0), path).count() == 0
    if name != "sharding":
        assert out.columns == docs.columns
    own = Counter((r[0], r[1]) for r in some)
    if name in ("toxicity", "sharding"):
        assert got == own
    elif name == "jaccard_join":
        assert got == Counter({(r[0], r[1]): 1 for r in some if r[1] != clean[1]} | {(clean[0], clean[1]): 1})
    elif name == "decontamination":
        assert got == own - Counter([(leak[0], leak[1])])
    else:
        assert all(got[k] <= 2 * own[k] for k in got) and set(got) <= set(own)
