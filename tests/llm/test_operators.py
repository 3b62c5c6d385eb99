"""Each operator against a plain version of itself on small tables that hold nulls, empty and long texts, ties and repeats."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocktake.llm import components, decontaminate, embedding_dedup, jaccard_join, line_dedup, mixing, pii, quotes, sharding, toxicity, url_filter


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def words_text(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


# Sharding.


def test_table_fills_by_turns_and_stays_even():
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert sorted(np.bincount(table))[0] >= 33 and len(table) == 101
    fewer = sharding.fill_table(["a", "b"], 101)
    moved = sum(x != y for x, y in zip(table, fewer, strict=True) if x != 2)
    assert moved < 30


def test_sharding_handles_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", 9), (1, "x", 9), (None, "y", 9), (None, "z", 9)], "doc_id long, source string, shard int")
    out = sharding.assign_shards(df, "doc_id", spread=["source"]).collect()
    assert len(out) == 4 and all(0 <= r["shard"] < 64 for r in out)
    assert len({r["slot"] for r in out if r["doc_id"] == 1}) == 1 and len({r["slot"] for r in out if r["doc_id"] is None}) == 2
    assert sharding.assign_shards(df.limit(0), "doc_id").count() == 0


# URL filter.


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fit = [r for r, _ in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


def test_url_rules_match_a_plain_reading(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.net", "https://x.net/", "http://notnet/", "http://b.org/fr/x?y#z", "http://example.com/de/", "http://com.de/", None, "", "no url", "http:///net/", "http://x.net?a", "http://a.b.example.com/de/q", "http://xexample.com/de/", "http://blog.casino-win.example.org/x", "http://x.net/", "x://y://net/"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("||" + r, a, 1) for r, a in url_filter.SITE_RULES] + [(r, a, 0) for r, a in url_filter.SPAM_PATTERNS]
    df = df.withColumns({"hit": F.lit(1), "n": F.lit(2), "token": F.lit("t"), "place": F.lit("p"), "rule": F.lit(3)})
    as_table = spark.createDataFrame(rules, "rule string, action string, tier int")
    for bound, given in ((url_filter.BROADCAST_RULES, rules), (0, as_table)):
        out = url_filter.judge_urls(df, given, broadcast_rules=bound)
        got = {r["page_id"]: r for r in out.collect()}
        assert len(got) == len(urls) and {"hit", "n", "token", "place", "rule"} < set(out.columns)
        for i, u in enumerate(urls):
            host, path, rule = plain_verdict(u, url_filter.SITE_RULES)
            assert (got[i]["host"], got[i]["path"]) == (host, path)
            assert (got[i]["matched_rule"] if got[i]["matched_tier"] == 1 else None) == (rule and "||" + rule)
        assert got[14]["verdict"] == "block" and got[14]["matched_tier"] == 0
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0 and url_filter.judge_urls(df, as_table.limit(0)).where("verdict = 'allow' AND matched_rule IS NULL").count() == len(urls)


def test_urls_that_many_pages_share(spark):
    pages = spark.createDataFrame([(i, "http://x.net/a" if i % 3 else None if i % 2 else f"http://y{i}.org/") for i in range(3000)], "page_id long, url string")
    got = url_filter.judge_urls(pages, [("||net/", "block", 1)]).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in got} == {"block": 2000, "allow": 1000}


@pytest.mark.parametrize(("rule", "fits", "misses"), [("||a.b/", ["a.b/", "x.a.b/q"], ["xa.b/", "q/a.b/"]), ("|a.b/c|", ["a.b/c"], ["a.b/cd", "xa.b/c"]), ("^ads^", ["x.ads.y/", "x/ads"], ["x/adsy"]), ("a+b*c", ["x/a+b__c"], ["x/aab_c", "x/a+b"]), ("(x|y)[", ["h/(x|y)["], ["h/x"]), ("é.", ["h/é."], ["h/éa"])])
def test_rules_as_expressions(spark, rule, fits, misses):
    row = spark.createDataFrame([(rule,)], "r string").select(url_filter.rule_regex(F.col("r")).alias("x"), url_filter.rule_tokens(F.col("r")).alias("t")).first()
    tried = spark.createDataFrame([(u,) for u in fits + misses], "u string").withColumn("x", F.lit(row["x"])).select("u", F.expr("u RLIKE x").alias("y"))
    assert {r["u"]: r["y"] for r in tried.collect()} == {u: u in fits for u in fits + misses}
    assert all(t in re.findall("[A-Za-z0-9]+", u) for t in row["t"] for u in fits)


# Decontamination.


def plain_leaks(text, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, hit, names = cut(text), set(), set()
    for name, item in items:
        q = cut(item)
        k = min(10, len(q))
        for i in range(len(w) - k + 1) if k else ():
            if any(w[i : i + k] == q[j : j + k] for j in range(len(q) - k + 1)):
                hit |= set(range(i, i + k))
                names.add(name)
    return len(w), len(hit), sorted(map(str, names))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_decontamination_matches_brute_force(spark, bound):
    rng = random.Random(1)
    turn = "a b c d e a b c d e a b c d e a b c d e a b c"
    items = [("0", words_text(rng, 25)), ("1", "one two three"), ("2", None), ("3", "..."), ("4", "É solo"), ("5", words_text(rng, 10)), ("6", words_text(rng, 9)), ("x", "one two three"), ("8", turn), ("9", "k k k k k k k k k k k k"), (None, "nobody knows the name of this one item here at all")]
    texts = [None, "", "One,two;THREE!", "é solo É solo", items[0][1], "x " + items[0][1][20:] + " y", items[5][1].upper() + " tail " + items[5][1], words_text(rng, 3000), words_text(rng, 50) + " " + items[6][1], items[5][1]]
    texts += ["c d e a b c d e a b q", "z " + turn * 3, "k " * 40, "k k k k k k k k k", "b c d e a b c d e a b c d e a", items[10][1]]
    for _ in range(60):  # pieces of items of all lengths in texts of few words
        t = words_text(rng, rng.randrange(0, 30), 4).split()
        for _ in range(rng.randrange(3)):
            q = items[rng.choice((0, 5, 8, 9))][1].split()
            i = rng.randrange(len(q))
            t[rng.randrange(len(t) + 1) : 0] = q[i : i + rng.randrange(5, 16)]
        texts.append(" ".join(t))
    items += [("few", " ".join(f"w{i % 4}" for i in range(14)))]
    docs, bench = make_docs(spark, texts), spark.createDataFrame(items, "item_id string, text string")
    leaks = {r["id"]: r for r in decontaminate.find_leaks(docs, bench, broadcast_rows=bound).withColumn("n_hit", decontaminate.covered(F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        _, n_hit, names = plain_leaks(t, items)
        assert (leaks[i]["n_hit"] if i in leaks else 0) == n_hit, (i, t)
        assert (sorted(leaks[i]["items"]) if i in leaks else []) == [n for n in names if n != "None"], i
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_repeats_clashing_columns_and_string_ids(spark):
    bench = spark.createDataFrame([("q-1", "a b c d e f g h i j k"), ("q-2", "solo")], "item_id string, text string")
    text = "x a b c d e f g h i j y"
    docs = spark.createDataFrame([(1, text, "s", 1), (1, text, "s", 1), (1, "other", "s", 2), (None, text, None, 3), (2, None, "s", 4)], "doc_id long, text string, span string, at int")
    docs = docs.withColumns({"leak_items": F.lit(1), "words": F.lit("w"), "print": F.lit(2), "id": F.lit(3), "item": F.lit(4), "item_id": F.lit(5), "n": F.lit(6), "len": F.lit(7)})
    out = decontaminate.decontaminate(docs, bench)
    got = out.collect()
    assert sorted(out.columns) == sorted([*docs.columns, "leak_spans"]) and len(got) == 5
    assert [r["leak_items"] for r in sorted(got, key=lambda r: (r["at"]))] == [["q-1"], ["q-1"], None, ["q-1"], None]
    counts = {(r["doc_id"], r["n_words"]): r for r in decontaminate.leak_counts(docs, bench).collect()}
    assert counts[1, 12]["n_hit"] == 10 and counts[1, 12]["items_sha256"] == hashlib.sha256(b"q-1").hexdigest() and not counts[2, 0]["contaminated"]


# Jaccard join.


def plain_jaccard(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root, links = list(range(len(sets))), [0] * len(sets)
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(i, len(s), root[i], links[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_join_matches_brute_force(spark, block):
    rng = random.Random(2)
    texts = [None, "", "  \t", "one", "ONE", "a b c", "a b c d e", "A B c d e"]
    for size in (12, 60, 400):
        base = words_text(rng, size, 500).split()
        for _ in range(12):
            other = base[:]
            for _ in range(rng.randrange(0, max(2, size // 40) + 1)):
                other[rng.randrange(size)] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(other))
        texts.append(" ".join(base) + " tail of words that make it longer " + words_text(rng, size // 8 + 1, 500))
    texts += [texts[9], texts[9]]
    docs = make_docs(spark, texts)
    assert rows(jaccard_join.join_similar(docs, block=block), "id", "n_shingles", "component_id", "n_links") == sorted(plain_jaccard(texts), key=str)


def test_jaccard_join_of_large_groups_and_frequent_tokens(spark, monkeypatch):
    rng = random.Random(12)
    base = words_text(rng, 150, 10_000).split()
    texts = []
    for _ in range(500):  # one chain of near copies over many sizes; all of them share their first words
        other = base[: rng.randrange(36, 140)]
        for _ in range(rng.randrange(3)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(other))
    texts += [" ".join(base[:40])] * 30
    docs = make_docs(spark, texts)
    own = docs.select(F.xxhash64("doc_id").alias("idh"), F.xxhash64("text").alias("th"), "text")
    assert jaccard_join.frequent_tokens(own, len(texts)).count() > 5
    got = rows(jaccard_join.join_similar(docs, block=32), "id", "n_shingles", "component_id", "n_links")
    assert got == sorted(plain_jaccard(texts), key=str)
    monkeypatch.setattr(jaccard_join, "LEAST", 1 << 30)  # no token is known as frequent: the same result
    assert rows(jaccard_join.join_similar(docs, block=100), "id", "n_shingles", "component_id", "n_links") == got


def test_filters_of_a_tile_lose_no_pair():
    rng = np.random.default_rng(3)
    for size in (3, 40):
        pool = np.unique(rng.integers(0, 2**63, 90, dtype=np.uint64)).view(np.int64)
        sets = [np.sort(rng.choice(pool, rng.integers(1, size), replace=False).view(np.uint64)).view(np.int64) for _ in range(30)]
        sets += [np.sort(np.delete(x, [0]).view(np.uint64)).view(np.int64) for x in sets if len(x) > 1] + [x[: -(len(x) // 5) or None] for x in sets]
        want = [[100 * len(set(x) & set(y)) >= 75 * len(set(x) | set(y)) for y in sets] for x in sets]
        rare = [sorted(x.tolist(), key=lambda t: (t * 7) % 1009)[: len(x) - -(-75 * len(x) // 100) + 1] for x in sets]  # a third order
        rare = [np.array(x, np.int64) for x in rare]
        assert (jaccard_join.linked_pairs(sets, sets, 75, (rare, rare)) == np.array(want)).all()
        sparse = [jaccard_join.linked_pairs([x], sets, 75, ([r], rare))[0] for x, r in zip(sets, rare, strict=True)]
        assert (np.array(sparse) == np.array(want)).all()


def test_jaccard_join_of_repeats_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (None, "a b c d e f g", 2), (None, None, 3), (2, " ", 4), (3, "q", 5)], "doc_id long, text string, cls int").withColumns({"id": F.lit("i"), "n": F.lit(1), "token": F.lit(2), "doc": F.lit(3), "g": F.lit(4)})
    got = rows(jaccard_join.join_similar(docs), "id", "n_shingles", "component_id", "n_links")
    assert got == sorted([(1, 3, 1, 2), (1, 3, 1, 2), (None, 3, 1, 2), (None, 0, None, 0), (2, 0, 2, 0), (3, 1, 3, 0)], key=str)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.join_similar(make_docs(spark, []).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and 200 not in got


# Mixing.


def test_mix_reaches_targets_within_one_document(spark):
    rng = random.Random(3)
    texts = [words_text(rng, rng.randrange(0, 60)) for _ in range(600)] + [None, "", "same text", "same text"]
    sources = ["b" if i % 3 else "a" for i in range(600)] + ["c", None, "c", "c"]
    docs = make_docs(spark, texts, sources)
    docs = docs.unionByName(docs.where("doc_id = 602"))
    mixed = mixing.mix(docs, ["doc_id"]).collect()
    size = {s: sum(r["size"] * r["m"] for r in mixed if r["source"] == s) for s in ("a", "b", "c", None)}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    level, total = 0, 1.5 * sum(size.values())
    full = set()
    for _ in range(5):
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        full |= {s for s in size if level * weight[s] >= 2 * size[s]}
    largest = max(r["size"] for r in mixed)
    for s in size:
        target = min(2 * size[s], level * weight[s])
        own = [r for r in mixed if r["source"] == s]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= largest
        assert all(0 <= r["copies"] <= 2 * r["m"] for r in own)
    again = {(r["key"]["doc_id"], r["source"]): r["copies"] for r in mixing.mix(docs.orderBy(F.desc("doc_id")), ["doc_id"]).collect()}
    assert again == {(r["key"]["doc_id"], r["source"]): r["copies"] for r in mixed}
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in mixing.mix(docs.select("doc_id", F.xxhash64("text").alias("h"), "source", "text"), ["doc_id", "h"]).collect())


def test_rows_that_differ_elsewhere_are_taken_together(spark):
    schema = "doc_id long, text string, source string, m int, copies int, lang string"
    rows_ = [(1, "a b c d", "s", 1, 1, "en"), (1, "a b c d", "s", 1, 1, "de"), (1, "a b c d", "s", 1, 1, "de")] + [(2 + i, "p q r s", "t", 5, 6, None) for i in range(6)] + [(None, None, None, 1, 1, None), (None, "x y", None, 2, 2, "en"), (None, "x y z", None, 2, 2, "en")]
    docs = spark.createDataFrame(rows_, schema)
    out = mixing.take(docs)
    assert out.columns == docs.columns and mixing.take(docs.limit(0)).count() == 0
    got = [tuple(r) for r in out.collect()]
    for key in {r[:3] for r in rows_}:
        m, n = sum(r[:3] == key for r in rows_), sum(r[:3] == key for r in got)
        assert n <= 2 * m
    granted = {(r["key"]["doc_id"], r["key"]["hash"], r["source"]): r["copies"] for r in mixing.mix(docs.withColumn("hash", F.xxhash64("text")).drop("m", "copies"), ["doc_id", "hash"]).collect()}
    counted = {(r["doc_id"], r["h"], r["source"]): r["count"] for r in out.groupBy("doc_id", F.xxhash64("text").alias("h"), "source").count().collect()}
    assert counted == {k: v for k, v in granted.items() if v}
    per = [sum(r == x for r in got) / rows_.count(x) for x in set(rows_) if x[0] == 1]
    assert max(per) - min(per) <= 1 and max(per) <= 2


def test_mix_agrees_with_sql_on_sizes(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(13)
    texts = [words_text(rng, rng.randrange(0, 30)) + rng.choice(["", " ", "\t\n", "é\u00a0x"]) for _ in range(200)] + [None, ""]
    docs = make_docs(spark, texts, [rng.choice("abcde") for _ in texts])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["size"], r["source_size"]) for r in mixing.op4_mixing(spark, str(tmp_path)).collect()}
    sql = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{tmp_path}/documents.parquet/*.parquet') SELECT doc_id, size, sum(size) OVER (PARTITION BY source) FROM d"""
    assert got == {i: (n, total) for i, n, total in duckdb.sql(sql).fetchall()}


def test_pivot_keeps_words_and_expectation():
    sizes = [random.Random(5).randrange(1, 50) for _ in range(40)]
    mean = np.zeros(40)
    for seed in range(800):
        parts = [0.3] * 40
        mixing.pivot(sizes, parts, random.Random(seed))
        assert abs(sum(s * p for s, p in zip(sizes, parts, strict=True)) - 0.3 * sum(sizes)) < 1e-6
        assert sum(0 < p < 1 for p in parts) <= 1
        mean += parts
    assert np.abs(mean / 800 - 0.3).max() < 0.08


def test_little_is_left_to_chance():
    misses = []
    for seed in range(60):
        rng = random.Random(seed)
        sizes = sorted((max(1, int(rng.lognormvariate(5, 1.2))) for _ in range(300)), reverse=True)
        part = rng.random()
        parts = [part] * 300
        mixing.pivot(sizes, parts, rng)
        taken = sum(s * (p if p in (0.0, 1.0) else float(rng.random() < p)) for s, p in zip(sizes, parts, strict=True))
        misses.append(abs(taken / (part * sum(sizes)) - 1))
    assert np.mean(misses) < 0.03


def test_mixes_come_near_their_targets(spark):
    rng = random.Random(8)
    docs = make_docs(spark, [words_text(rng, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(300)], [rng.choice("abc") for _ in range(300)])
    far = []
    for seed in range(3):
        mixed = mixing.mix(docs, ["doc_id"], seed=seed).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
        far += [abs(r["taken"] / r["target"] - 1) for r in mixed]
    assert np.mean(far) < 0.03


# Line dedup.


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup_matches_a_plain_count(spark, keep_first):
    rng = random.Random(4)
    pool = ["Shared line", " shared LINE\t", "", "other", "É", "é", "rare"] + [f"line {i}" for i in range(30)]
    texts = [None, "", "\n\n", "Shared line\n" * 50] + ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    docs = make_docs(spark, texts)
    docs = docs.unionByName(docs.where("doc_id = 7"))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\r\n\x0b\x0c"))
    seen, least = {}, 2 if keep_first else 10
    for i, t in enumerate(texts):
        for x in set(map(key, (t or "").split("\n"))) - {""}:
            seen.setdefault(x, set()).add(i)
    got = {r["doc_id"]: (r["text"], r["keep"]) for r in line_dedup.with_bitmaps(docs, least_docs=least, keep_first=keep_first).collect()}
    done = set()
    for i, t in enumerate(texts):
        kept = []
        for x in (t or "").split("\n"):
            k = key(x)
            if k and len(seen[k]) >= least and not (keep_first and k not in done):
                continue
            done.add(k)
            kept.append(x)
        assert line_dedup.kept_text(*[v.encode() if isinstance(v, str) else v for v in got[i]])[2].decode() == "\n".join(kept), i
    assert line_dedup.with_bitmaps(docs.limit(0)).count() == 0


def test_line_dedup_of_repeats_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "shared\nown %d" % i, "k") for i in range(9)] + [(None, "shared\nx", "k"), (None, "shared", "k"), (0, "shared\nown 0", "k"), (None, None, "k")], "doc_id long, text string, keep string").withColumns({"h1": F.lit(1), "positions": F.lit(2), "n_lines": F.lit(3), "id": F.lit("i")})
    out = line_dedup.with_bitmaps(docs)
    got = [line_dedup.kept_text(r["text"] and r["text"].encode(), r["keep"])[2] for r in out.collect()]
    assert sorted(out.columns) == sorted(docs.columns) and len(got) == 13 and not any(b"shared" in t for t in got)  # nine ids and the rows without one: ten documents
    assert any(b"shared" in (r["text"] or "").encode() and r["keep"] is None for r in line_dedup.with_bitmaps(docs.where("doc_id > 0 OR doc_id IS NULL")).collect())


# Personal data.


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 1 and any(int(p) > 255 for p in m[0].split("."))) or (kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == 3 and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-+_ 0124455()\né") for _ in range(rng.randrange(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 100_000) == []


def test_field_finds_secrets_and_leaves_clean_text_alone(spark):
    texts = [None, "", "Plain words, nothing else.\nVersion 2.0 of 2024-01-02 at 10:30 (page 12).", "the password=5aaa9ac60bfe74b24b is out", 'é token = "0641917ea4e9feb9cda83477b57ac2654884f485" end', "mail bosbt.42@mail8.example.com or 42.144.35.254 now", "word " * 30_000]
    got = {r["doc_id"]: r for r in pii.find_personal_data(make_docs(spark, texts)).collect()}
    kinds = [[s["kind"] for s in got[i]["spans"]] for i in range(len(texts))]
    assert kinds == [[], [], [], ["secret"], ["secret"], ["email", "ip"], []]
    span = got[4]["spans"][0]
    assert "0641917ea4e9" in texts[4][span["start"] : span["end"]]
    assert [(s["kind"], s["start"], s["end"]) for s in got[5]["base_spans"]] == [(pii.KINDS[k], a, b) for a, k, b in plain_spans(texts[5])]


def test_decoding_is_the_best_of_all_paths():
    rng = np.random.default_rng(16)
    w, trans = rng.standard_normal((3, len(pii.BITS) + 1, 4)), rng.standard_normal((4, 4))
    for lead in (0.0, 4.0):  # a large lead of O makes lines that are skipped
        w[0, 0, 0] = lead
        code = rng.integers(0, 1 << len(pii.BITS), 60)
        size = np.array([1, 5, 4, 1, 5, 2, 5, 3, 5, 4, 5, 5, 5, 5, 5])
        begin = np.cumsum(size) - size
        got = pii.decode(code, begin, size, w, trans)
        for b, n in zip(begin.tolist(), size.tolist(), strict=True):
            f = pii.features(code[b : b + n])
            own = f @ w[0] + np.vstack([np.zeros(4), f[:-1] @ w[1]]) + np.vstack([f[1:] @ w[2], np.zeros(4)])
            score = lambda path, own=own: sum(own[i, t] for i, t in enumerate(path)) + sum(trans[x, y] for x, y in zip(path, path[1:], strict=False))
            best = max(itertools.product(range(4), repeat=n), key=score)
            assert score(got[b : b + n].tolist()) >= score(best) - 1e-3


def test_field_on_a_table_that_it_has_not_seen():
    w, trans = pii.train(pii.labelled_table())
    rows_ = pii.labelled_table(seed=99, copies=30)
    found = pii.field_spans([t.encode() for t, _ in rows_], w, trans)
    want = [{(pii.LEARNED.index(k), a, b) for k, a, b in spans} for _, spans in rows_]
    touch = lambda s, of: any(s[0] == k and s[1] < b and a < s[2] for k, a, b in of)
    recall = sum(touch(s, [(k, a, b) for a, k, b in f]) for f, of in zip(found, want, strict=True) for s in of) / sum(map(len, want))
    precision = sum(touch((k, a, b), of) for f, of in zip(found, want, strict=True) for a, k, b in f) / sum(map(len, found))
    assert recall >= 0.9 and precision >= 0.95, (recall, precision)


def test_learned_spans_in_texts_of_many(spark):
    line = 'é token = "0641917ea4e9feb9cda83477b57ac2654884f485" then mail ü.42@mail8.example.com and password=5aaa9ac60bfe74b24b 日本\n'
    docs = spark.createDataFrame([(1, line * 400, "a", 1), (2, None, "b", 2), (2, None, "b", 2)], "doc_id long, text string, kind string, start int").withColumns({"spans": F.lit(1), "base_spans": F.lit("x")})
    out = pii.find_personal_data(docs)
    got = sorted(out.collect(), key=lambda r: r["doc_id"])
    spans = got[0]["spans"]
    assert len(got) == 3 and set(out.columns) == set(docs.columns) and not got[1]["spans"] and got[0]["kind"] == "a"
    assert [s["kind"] for s in spans] == ["secret", "email", "secret"] * 400
    assert all((line * 400)[s["start"] : s["end"]].strip("\"").endswith(("f485", "example.com", "b24b")) for s in spans)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


# Toxicity.


def test_gradients_agree_with_differences():
    words = toxicity.Words([b"Hello you idiot of the world and more words here to read now ok yes no fine", b"short one", b""])
    start, size, text = words.windows()
    assert size.tolist() == [16, 16, 2] and text.tolist() == [0, 0, 1]
    p, label, weight = toxicity.new_network(1), np.float32([1, 0, 0]), np.ones(3, np.float32)
    _, grads = toxicity.loss_gradients(p, words, start, size, label, weight)
    for k, g in grads.items():
        i = int(np.argmax(np.abs(g)))
        flat, old = p[k].ravel(), p[k].ravel()[i]
        flat[i] = old + 1e-2
        up = toxicity.loss_gradients(p, words, start, size, label, weight)[0]
        flat[i] = old - 1e-2
        down = toxicity.loss_gradients(p, words, start, size, label, weight)[0]
        flat[i] = old
        assert abs((up - down) / 2e-2 - g.ravel()[i]) < 1e-3


def test_scores_equal_a_plain_forward_pass():
    text = b"You are an idiot, my friend. I said that many times, and today I say it once more to all of you here now and then"
    words = toxicity.Words([text, b"one"])
    start, size, of = words.windows()
    p = toxicity.new_network(5)
    got = toxicity.score_windows(p, words, start, size)
    squash = lambda x: 1 / (1 + np.exp(-x))
    x, _, _ = words.embed(p)
    h = toxicity.HIDDEN
    for k, (st, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        inputs, sides = x[words.ids[st : st + n]].astype(np.float64), []
        for side in "fb":
            state, states = np.zeros(h), []
            for v in inputs if side == "f" else inputs[::-1]:
                g, u = v @ p[f"in_{side}"] + p[f"bias_{side}"], state @ p[f"rec_{side}"]
                z, r = squash(g[:h] + u[:h]), squash(g[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                states.append(state)
            sides.append(states if side == "f" else states[::-1])
        both = np.hstack([np.array(s) for s in sides])
        att = np.exp(np.tanh(both @ p["att"] + p["att_b"]) @ p["att_v"])
        assert abs(squash((att / att.sum()) @ both @ p["out"] + p["out_b"][0]) - got[k]) < 1e-5
    assert toxicity.score_texts(p, [text, b"one", None]).tolist() == [max(got[of == 0]), max(got[of == 1]), 0]


def test_toxicity_of_repeats_nothing_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "all is well here", "a"), (1, "all is well here", "a"), (None, None, "b"), (3, "you zorgaba", "c")], "doc_id long, text string, score string").withColumns({"label": F.lit(1), "toxic": F.lit(1), "__k": F.lit(2)})
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.score_toxicity(docs, lab).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    long = docs.withColumn("text", F.repeat(F.lit("word "), F.lit(10_000)))
    assert toxicity.training_rows(long, labels).count() == 0 and toxicity.training_rows(docs, labels).count() == 2


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    bad = ["zorgaba", "zorgelo", "zorgimi", "vilefut", "vilekam"]
    texts, toxic = [], []
    for i in range(360):
        w = words_text(rng, rng.randrange(20, 120), 300).split()
        if i % 3 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    docs = make_docs(spark, [*texts, None, "", "?!"])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 363 and all(got[i] == 0 for i in (360, 361, 362)) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(360) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.CUT) == bool(toxic[i]) for i in held)
    assert right / len(held) > 0.95


# Embeddings.


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 32))
    vectors = [base[i % 150] + rng.standard_normal(32) * (0.25 if i >= 150 else 0) for i in range(450)]
    table = [(i, [float(x) for x in v], int(i % 150 % 3)) for i, v in enumerate(vectors)]
    table += [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [float("nan")] * 32, 1), (904, table[0][1], None), (905, table[0][1], table[0][2]), (906, [2 * x for x in table[0][1]], table[0][2]), (907, [None] * 32, 1)]
    got = {r["id"]: r for r in embedding_dedup.dedup_embeddings(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), sample=300).collect()}
    ids = [i for i, v, lab in table if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    look = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in table if i in ids}
    links = {i: sum(j != i and look[i][1] == look[j][1] and look[i][0] @ look[j][0] >= 0.93 for j in ids) for i in ids}
    found = sum(got[i]["n_links"] for i in ids)
    assert all(got[i]["n_links"] <= links[i] for i in ids) and found >= 0.9 * sum(links.values()) and found > 300
    for i in (900, 901, 902, 903, 904, 907):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[905]["component_id"] == got[906]["component_id"] == 0 and not got[905]["kept"]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.dedup_embeddings(empty).count() == 0


def brute_links(table, least=0.93):
    """id -> linked ids, of rows (id, vector, label)."""
    out = {i: set() for i, _, _ in table}
    fine = [(i, np.array(v, np.float64) / np.abs(v).max(), lab) for i, v, lab in table if lab is not None and v and any(v)]
    for key in {(len(v), lab) for _, v, lab in fine}:
        own = [(i, v / np.linalg.norm(v)) for i, v, lab in fine if (len(v), lab) == key]
        x = np.array([v for _, v in own])
        for a, b in np.argwhere(x @ x.T >= least).tolist():
            if a != b:
                out[own[a][0]].add(own[b][0])
    return out


def scattered(rng, n, d, groups, spread):
    base = rng.standard_normal((groups, d))
    return base[rng.integers(0, groups, n)] + rng.standard_normal((n, d)) * spread[rng.integers(0, len(spread), n)][:, None]


@pytest.mark.parametrize("how", [{"lists": 16, "more": 12}, {"lists": 120, "more": 1}, {"lists": 60, "exact": True}])
def test_recall_with_more_lists_than_probes(spark, how):
    rng = np.random.default_rng(14)
    vectors = scattered(rng, 4000, 64, 1300, np.array([0.05, 0.2, 0.27]))
    table = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    links = brute_links(table)
    got = {r["id"]: r for r in embedding_dedup.dedup_embeddings(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int"), **how).collect()}
    total = sum(map(len, links.values()))
    found = sum(r["n_links"] for r in got.values())
    assert total > 3000 and all(got[i]["n_links"] <= len(links[i]) for i in links)
    assert found == total if "exact" in how else found >= 0.97 * total


def test_vectors_of_many_lengths_sizes_and_clashing_columns(spark):
    rng = np.random.default_rng(15)
    table = []
    for d in (1, 2, 7, 32, 700):
        table += [(len(table) + k, [float(x) for x in v], 1) for k, v in enumerate(scattered(rng, 12, d, 4, np.array([0.1])))]
    for v in ([2e200, 0.0], [1e200, 0.0], [1e-200, 0.0], [3e-320, 0.0], [0.0, 1e-300]):
        table.append((len(table), v, 2))
    table += [(len(table) + k, [1.0] * (k + 40), 3) for k in range(1200)]
    links = brute_links(table)
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumns({"cls": F.lit(1), "vec": F.lit("v"), "cell": F.lit(2), "d": F.lit(3), "id": F.lit("i"), "home": F.lit(4)})
    got = {r["id"]: r["n_links"] for r in embedding_dedup.dedup_embeddings(df).collect()}
    assert got == {i: len(x) for i, x in links.items()} and sum(got.values()) > 60


def test_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    docs = [(1, words(1), "a"), (5, words(1), "a"), (5, words(2), "a"), (None, words(3), "a"), (None, words(3), "b"), (None, words(3), "b"), (7, words(4), "a"), (7, words(4) + " end", "a"), (None, words(1), "a"), (8, None, "a"), (9, "", "a")]
    got = rows(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string, source string"), ""), "doc_id", "text")
    assert len(got) == 6 and sorted((r[0] or 0) for r in got) == [0, 1, 5, 7, 8, 9] and (5, words(2)) in [tuple(r) for r in got]
    got = rows(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([docs[0], docs[6], (3, words(1), "a")], "doc_id long, text string, source string"), ""), "doc_id")
    assert sorted(r[0] for r in got) == [1, 7]


# Quotes.


def test_quotes_link_replies_and_go(spark):
    talk = [
        (1, 0, "user", "The first message of this talk, long enough.\nA second line of it."),
        (1, 1, "assistant", "> The first  message of this talk, long enough.\nMy answer to the line above."),
        (1, 2, "user", "> > The first message of this talk, long enough.\n> My answer to the line above.\nAnd a third message."),
        (1, 3, "user", "No quote here at all."), (2, 0, "user", "> The first message of this talk, long enough.\nOther talk."), (1, 4, "user", None), (None, 0, "user", "> x"), (1, 3, "user", "No quote here at all."), (1, 5, "user", ""), (1, 6, "user", "> ok\nfine"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    out = quotes.link_quotes(df.withColumn("depth", F.lit("clash")))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(talk)
    assert [(got[1, t]["reply_to"], got[1, t]["root_turn"], got[1, t]["depth"]) for t in range(4)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (None, 3, 0)]
    assert got[1, 2]["text"] == "And a third message." and got[2, 0]["reply_to"] is None and got[1, 4]["text"] == "" and got[1, 6]["text"] == "fine"
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_short_quotes_link_last(spark):
    talk = [
        (1, 0, "user", "Yes, it does"), (1, 1, "user", "我同意你的看法。"), (1, 2, "user", "A passage that is long enough to count."), (1, 3, "user", "> Yes, it does\nGood."), (1, 4, "user", "> 我同意你的看法。\n好"),
        (1, 5, "user", "> Yes, it does\n\n> > A passage that is long enough to count.\nBoth."), (1, 6, "user", "Yes, it does"), (1, 7, "user", "> yes it does!\nAgain."), (2, 0, "user", "> Yes, it does\nElsewhere."), (1, 8, "user", "> ...\nDots."),
    ]
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["root_turn"], r["depth"]) for r in quotes.link_quotes(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t] for t in (3, 4, 5, 7, 8)] == [(0, 0, 1), (1, 1, 1), (2, 2, 1), (0, 0, 1), (None, 8, 0)] and got[2, 0] == (None, 0, 0)


def plain_quotes(talk):
    """(conv_id, turn) -> (reply_to, root_turn, depth, n_quoted, n_linked, text), message by message."""
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    parsed = {}
    for conv, turn, _, text in talk:
        parts = []
        for line in re.split(r"\r?\n", text or ""):
            mark = re.match(r"[ \t]*(?:>[ \t]?)+", line)
            level, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
            if parts and parts[-1][0] == level:
                parts[-1][1].append(body)
            else:
                parts.append((level, [body]))
        parsed[conv, turn] = parts
    units = lambda lines: [(r, n) for r, n in [(0, norm(" ".join(lines))), *((1, norm(x)) for x in lines)] if n]
    said, out, reply = {}, {}, {}
    for (conv, turn), parts in parsed.items():
        for level, lines in parts:
            for _, n in units(lines) if not level else ():
                said[conv, n] = min(turn, said.get((conv, n), turn))
    for (conv, turn), parts in parsed.items():
        met = [(len(n) < quotes.LEAST_CHARS, level, r, -said[conv, n], n) for level, lines in parts if level for r, n in units(lines) if said.get((conv, n), turn) < turn]
        reply[conv, turn] = -min(met)[3] if met else None
        text = "\n".join(x for level, lines in parts if not level for x in lines).strip(" \t\r\n")
        out[conv, turn] = [sum(level > 0 for level, _ in parts), len({m[4] for m in met}), text]
    for conv, turn in out:
        root, depth = turn, 0
        while reply[conv, root] is not None:
            root, depth = reply[conv, root], depth + 1
        out[conv, turn] = (reply[conv, turn], root, depth, *out[conv, turn])
    return out


def test_quotes_equal_a_plain_reading_and_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(21)
    talk = []
    for conv in range(40):
        said = []
        for turn in range(rng.randrange(1, 12)):
            lines = []
            for _ in range(rng.randrange(1, 4)):
                old = rng.choice(said) if said else []
                if old and rng.random() < 0.6:
                    a = rng.randrange(len(old))
                    lines += [f"{rng.choice(['> ', '>', ' > '])}{x}" for x in old[a : a + rng.randrange(1, 4)]]
                if rng.random() < 0.8:
                    lines.append(rng.choice(["ok", "Yes, it does.", "", "...", "同意", words_text(rng, rng.randrange(1, 6), 9)]))
            said.append(lines)
            talk.append((conv, turn, "user", rng.choice(["\n", "\r\n"]).join(lines) if lines else None))
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    columns = ("reply_to", "root_turn", "depth", "n_quoted", "n_linked", "text")
    got = {(r["conv_id"], r["turn"]): tuple(r[c] for c in columns) for r in quotes.op10_chat_formatting(spark, str(tmp_path)).collect()}
    want = plain_quotes(talk)
    assert got == want and sum(v[0] is not None for v in want.values()) > 60 and max(v[2] for v in want.values()) > 1
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(quotes.oracle())
    at = [rel.columns.index(c) for c in ("conv_id", "turn", *columns)]
    assert {tuple(r[i] for i in at[:2]): tuple(r[i] for i in at[2:]) for r in rel.fetchall()} == want


def test_digest_of_nothing_is_the_empty_digest():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(line_dedup.kept_text(None, None)[2]).hexdigest()
