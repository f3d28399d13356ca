"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression and the literal tokens without which it cannot
match. Every rule is filed under the one of its tokens that fewest URLs have;
the distinct tokens of a URL fetch candidate rules, and only these run their
expressions. Before them stand host rules: the longest rule whose host is the
URL's host or a parent of it, and whose path begins the URL's path, decides.

Only built-in functions are used. Token counts are pre-aggregated; the rule
index has one row per rule and is left to Spark's own size check. A token that
most URLs share costs one probe per URL and fetches only the rules for which it
is still the rarest.

Null URLs and those without ``://`` have an empty host and path and fit no host
rule; patterns see null as empty. Repeated rows stay apart. Empty tables give no
rows. Other columns of the input are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlift.llm.base import ascii_lower

# The host rules as (verdict, host, path).
HOST_RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
# Block patterns as (name, regular expression, its literal tokens).
PATTERNS = (
    ("adult", r"://([^/]*[.-])?adult-[a-z0-9]+[.]", ("adult",)),
    ("bets", r"://([^/]*[.-])?(free|live)-bets[.-]", ("bets",)),
    ("casino-host", r"://([^/]*[.-])?casino[.-]", ("casino",)),
    ("casino-path", r"://[^?#]*/casino(/|$|[?])", ("casino",)),
    ("login", r"://[^?#]*/login(/|[.]php|$|[?])", ("login",)),
    ("pills", r"://([^/]*[.-])?(cheap|online)-pills[.-]", ("pills",)),
    ("session", r"[?&]sessionid=[0-9a-f]{16,}(&|#|$)", ("sessionid",)),
    ("signin", r"://[^?#]*/signin(/|[.]php|$|[?])", ("signin",)),
    ("tracker", r"://([^/]*[.])?ads-track[.]", ("ads", "track")),
)
BETWEEN_TOKENS = "[^a-z0-9]+"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(url.contains("://"), F.expr("substr(_url, locate('://', _url) + 3)")).otherwise(F.lit(""))


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    literal = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(*[literal(v).alias(k) for k, v in r.items()]) for r in rows
    ])))


def pattern_hits(urls: DataFrame, patterns=PATTERNS, broadcast_rules: int = 200_000) -> DataFrame:
    """The first pattern by name that matches, for each distinct ``_url`` that one matches."""
    spark = urls.sparkSession
    rules = _rows(spark, [
        {"pattern": name, "regex": regex, "tokens": tokens} for name, regex, tokens in patterns
    ])
    tokens = F.array_distinct(F.array_remove(F.split(ascii_lower(F.col("_url")), BETWEEN_TOKENS), ""))
    seen = urls.where(F.col("_url").isNotNull()).select("_url", F.explode(tokens).alias("token"))
    entries = rules.select("pattern", "regex", F.explode("tokens").alias("token"))
    small = len(patterns) <= broadcast_rules
    hint = F.broadcast if small else (lambda df: df)
    counts = seen.join(hint(entries.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    index = (
        entries.join(counts, "token", "left")
        .groupBy("pattern", "regex")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("pattern", "regex", F.col("rarest.token").alias("token"))
    )
    candidates = seen.join(hint(index), "token")
    return (
        candidates.where(F.expr("translate(_url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') rlike regex"))
        .groupBy("_url").agg(F.min("pattern").alias("pattern"))
    )


def judge(
    pages: DataFrame, *, page: str = "page_id", url: str = "url", host_rules=HOST_RULES, patterns=PATTERNS,
) -> DataFrame:
    """Per row: id, host, path, the host rule that decides (or null), pattern, verdict."""
    narrow = pages.select(F.col(page).alias("page_id"), F.col(url).alias("_url"))
    rest = _rest(F.col("_url"))
    split = narrow.select(
        "page_id", "_url",
        F.coalesce(ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(host_rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    hits = pattern_hits(narrow.select("_url"), patterns)
    judged = split.withColumns({"rule": rule, "verdict": verdict}).join(hits, "_url", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("pattern").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        "pattern",
    )
