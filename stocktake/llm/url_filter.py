"""URL filter: pattern rules indexed by their rarest literal token.

A rule's text is matched against host + path. ``||`` at the start anchors it at the host or any parent domain, ``|`` at
either end anchors it there, ``^`` stands for one character that is no ASCII letter or digit (or an end), ``*`` for
anything; all else is literal. The literal tokens that the rule's text bounds on both sides must occur in every URL
that it matches, so the rule is filed under the one of them that fewest distinct URLs have. A URL's tokens fetch
the rules filed under them, and only those rules' regular expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, cut, join_hot, table

#: The rules that the query applies first.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own patterns; they judge URLs that no site rule fits.
SPAM_PATTERNS = tuple((p, "block") for p in ("^ads-track^", "^spam-farm^", "^casino-win^", "^adult-x^", "^cheap-pills^", "^free-bets^", "^porn^", "^warez^"))

#: An index of at most so many rows is broadcast; a larger one is joined by shuffling both sides on the token.
BROADCAST_RULES = 200_000
#: URLs that meet a token's rules in one part of a shuffle.
PART = 100_000
TOKEN = "[A-Za-z0-9]+"


def rule_regex(rule: Column) -> Column:
    """The regular expression of a rule. Escapes come first, then the signs that mean something."""
    body = F.regexp_replace(rule, r"^\|{1,2}|\|$", "")
    body = F.regexp_replace(body, r"([\x00-\x7F&&[^A-Za-z0-9*^]])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:^|[^A-Za-z0-9]|$)"))
    head = F.when(rule.startswith("||"), r"^(?:[^/]*\.)?").when(rule.startswith("|"), "^").otherwise("")
    return F.concat(F.lit("(?s)"), head, body, F.when(rule.rlike(r"(?s)^\|{0,2}.*[^|].*\|$"), "$").otherwise(""))


def rule_tokens(rule: Column) -> Column:
    """Tokens bounded on both sides, so that a URL which fits has each of them as a whole token."""
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(r"(?<=^\|{1,2}|[^A-Za-z0-9*|])[A-Za-z0-9]+(?=[^A-Za-z0-9*])"), F.lit(0)))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(rules: DataFrame) -> DataFrame:
    """(rule, action, tier) -> with regex and tokens; a rule without a bounded token is filed under the empty token, which every URL has. Rules without a text are left out."""
    tokens = rule_tokens(F.col("rule"))
    return rules.where("rule IS NOT NULL").select("rule", "action", "tier", rule_regex(F.col("rule")).alias("regex"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens")).distinct()


def fetch_rules(urls: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(url, n, hit): for each of the distinct ``urls`` (url, n) that some rule matches, the winning one: highest tier, longest text, last by code point."""
    parts = urls.select("url", "n", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"))
    tokens = parts.select("url", "n", "place", F.explode(F.array_append(F.array_distinct(F.regexp_extract_all("place", F.lit(TOKEN), F.lit(0))), F.lit(""))).alias("token"))
    filed = rules.select("rule", "action", "tier", "regex", F.explode("tokens").alias("token"))
    small = filed.count() <= broadcast_rules
    wanted = filed.select("token").distinct()
    counted = tokens.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    index = (
        filed.join(F.broadcast(counted) if small else counted, "token", "left")
        .groupBy("rule", "action", "tier", "regex").agg(F.min_by(F.struct("token", "urls"), F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("by"))
        .select("rule", "action", "tier", "regex", "by.token", "by.urls")
    )
    if small:
        met = tokens.join(F.broadcast(index.drop("urls")), "token")
    else:  # tokens that most URLs have are hot: the URLs learn how many have the token, and each such token's rules are dealt to as many parts
        index = cut(index)
        each = index.where("urls IS NOT NULL").groupBy("token").agg(F.first("urls").alias("urls"))
        asks = join_hot(tokens, cut(each), ["token"], F.xxhash64("url"), "urls").where("urls IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("url"), parts_of("urls")))
        met = asks.drop("urls").join(index.where("urls IS NOT NULL").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts_of("urls") - 1))).drop("urls"), ["token", "part"])
    return met.where(F.expr("place RLIKE regex")).groupBy("url").agg(F.first("n").alias("n"), F.max(F.struct("tier", F.length("rule").alias("size"), "rule", "action")).alias("hit"))


def parts_of(urls: str) -> Column:
    return F.ceil(F.col(urls) / PART)


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, int]], url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """``pages`` with host, path, matched_rule, matched_tier and verdict (input columns of these names are replaced).

    ``rules`` are rows of (rule, action, tier), as a table of any size or a list. A null url or one without ``://`` has an empty host and
    path; no anchored rule fits it and it gets ``default``. Rows are judged by their url alone, so repeated rows agree and one url that
    holds a third of all rows is judged once and makes no large task. All input rows come back, an empty frame gives an empty one.
    """
    own = pages.drop("host", "path", "matched_rule", "matched_tier", "verdict")
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(list(rules), "rule string, action string, tier int")
    urls = own.select(F.col(f"`{url}`").alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    hits = cut(fetch_rules(urls, rules_frame(rules), broadcast_rules)).select(F.col("url").alias("__url"), F.col("n").alias("__n"), F.col("hit").alias("__hit"))
    own = own.withColumn("__url", F.col(f"`{url}`"))
    met = join_hot(own, hits, ["__url"], F.xxhash64(*[f"`{c}`" for c in pages.columns if c in own.columns]), "__n")
    key, hit = F.col("__url"), F.col("__hit")
    return met.withColumns({"host": host_of(key), "path": path_of(key), "matched_rule": hit["rule"], "matched_tier": hit["tier"], "verdict": F.coalesce(hit["action"], F.lit(default))}).drop("__url", "__n", "__hit")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("||" + rule, action, 1) for rule, action in SITE_RULES] + [(rule, action, 0) for rule, action in SPAM_PATTERNS]
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("matched_tier") == 1, F.substring("matched_rule", 3, 1 << 20)).alias("rule"), "verdict",
        F.when(F.col("matched_tier") == 0, F.col("matched_rule")).alias("pattern"),
    )


def oracle() -> str:
    fits = lambda rule: f"((host = '{rule.split('/', 1)[0]}' OR ends_with(host, '.{rule.split('/', 1)[0]}')) AND starts_with(path, '/{rule.split('/', 1)[1]}'))"
    longest = sorted((r for r, _ in SITE_RULES), key=len, reverse=True)
    spam = sorted((p for p, _ in SPAM_PATTERNS), key=lambda p: (len(p), p), reverse=True)
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN '{r}'" for r in longest)} END AS rule,
  CASE {' '.join(f"WHEN regexp_matches(concat(host, path), '(^|[^A-Za-z0-9]){re.escape(p.strip('^'))}([^A-Za-z0-9]|$)') THEN '{p}'" for p in spam)} END AS spam FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{a}'" for r, a in SITE_RULES)} WHEN spam IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN spam END AS pattern FROM r"""
