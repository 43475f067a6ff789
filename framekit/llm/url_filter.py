"""URL filters by expressions: host suffixes times path prefixes, short hashes, full digests, longest rule.

A rule has a host, a path and an action. It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's
path. A URL is expanded into each suffix of its host (at dots) with each prefix of its path (up to a slash, the empty one included). A rule
is filed under its host and its path up to the last slash, which is one of those prefixes of every URL that it fits. Both sides hash these
expressions; they are joined on the first eight hex digits, then the full digests and the rest of the rule's path are compared. Of the
rules that fit, the one of greatest length (host and path together) wins, then the longer host, then block before allow.

Only distinct (host, path) pairs are expanded and joined, so a URL that fills a third of the table counts once. Rules are broadcast if
they are few (``common.BROADCAST_ROWS``), else joined by a shuffle.

A null URL or one without ``://`` has an empty host and path; no rule fits an empty host, and it gets the default verdict. Null parts of a
rule are empty; a rule with an empty host fits nothing. Repeated rules and repeated rows change nothing; every row of the input comes back
once. An empty table gives an empty table. The input's columns host, path, rule and verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framekit.llm.common import small

#: Hex digits of the digest by which expressions are joined.
SHORT = 8
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash sign, A-Z in lower case; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark or hash sign."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def path_prefixes(path: Column) -> Column:
    """The empty prefix and every prefix that ends with a slash."""
    parts = F.split(path, "/", -1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filed_rules(rules: DataFrame) -> DataFrame:
    """Rules with their expression's digest: ``rule_host, rule_path, action, digest, short``."""
    parts = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action",
    ).filter("rule_host <> ''").distinct()
    head = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    return parts.withColumn("digest", _digest(F.col("rule_host"), head)).withColumn("short", F.substring("digest", 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; ``rule`` is null where none fits."""
    given = pages.drop("host", "path", "rule", "verdict")
    parsed = given.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    places = parsed.select("host", "path").filter("host <> ''").distinct()
    expressions = places.select(
        "host", "path", F.explode(host_suffixes(F.col("host"))).alias("suffix"),
    ).select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"))).alias("prefix"))
    hashed = expressions.select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("full"))
    filed = filed_rules(rules)
    fitting = hashed.withColumn("short", F.substring("full", 1, SHORT)).join(small(filed), "short").filter(
        (F.col("full") == F.col("digest")) & F.col("path").startswith(F.col("rule_path")),
    )
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.col("action").alias("action"),
        F.concat("rule_host", "rule_path").alias("text"),
    )
    best = fitting.groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(F.max(rule).alias("__best"))
    judged = parsed.join(best, (parsed["host"] == best["__host"]) & (parsed["path"] == best["__path"]), "left")
    found = best["__best"]
    return judged.select(
        *(parsed[c] for c in parsed.columns), found["text"].alias("rule"), F.coalesce(found["action"], F.lit(default)).alias("verdict"),
    )
