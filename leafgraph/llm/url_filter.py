"""URL rules by host suffix and path prefix, found through short hash prefixes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many are broadcast (some 100 bytes each); beyond, both sides are shuffled by hash prefix.
BROADCAST_RULES = 100_000
#: Shuffled expressions of one hash prefix are dealt to so many tasks, with the rules copied to each.
SALTS = 32
#: Numbers of labels, or lengths of paths, that are listed in the plan; where the rules have more, all are tried.
LENGTHS = 1024
#: Hexadecimal digits of the short hash.
SHORT = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _numbers(column: DataFrame) -> list[int] | None:
    """The different values of a column, None for more than LENGTHS."""
    found = sorted(r[0] for r in column.distinct().limit(LENGTHS + 1).collect())
    return found if len(found) <= LENGTHS else None


def _those(most: Column, numbers: list[int] | None, least: int) -> Column:
    """The ``numbers`` up to ``most``; None: all from ``least`` on."""
    if numbers is None:
        return F.sequence(F.lit(least), most)
    return F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda n: n <= most)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each url.

    ``pages``: page_id, url; ``rules``: verdict, host, path. A rule fits its host and all subdomains where the url's
    path starts with the rule's. Every host suffix of as many labels as some rule's host has, with every path prefix as long
    as some rule's path (with paths of over LENGTHS lengths: every prefix), is an expression; expressions meet rules on the first SHORT hex digits of their SHA-256, then the full digest decides.
    Of the rules that fit, the one with the most characters wins, then the longer host, then block before allow.

    Returns page_id, host, path, rule (host + path of the rule, else null), verdict (the rule's, else ``default``),
    one row per input row. Null or empty urls have empty host and path and get ``default``, as does everything when
    ``rules`` is empty. Repeated rows are judged once and repeated again. Rules with a null in any column are
    ignored. Other columns of either table are not looked at.
    """
    rules = rules.select("verdict", "host", "path").dropna().distinct()
    depth = F.size(F.split("host", r"\."))
    lengths, depths = _numbers(rules.select(F.length("path"))), _numbers(rules.select(depth))
    rules = rules.select(
        F.sha2(F.concat("host", F.lit(" "), "path"), 256).alias("full"),
        F.struct(
            (F.length("host") + F.length("path")).alias("chars"),
            F.length("host").alias("host_chars"),
            F.col("verdict").alias("verdict"),
            F.concat("host", "path").alias("rule"),
        ).alias("found"),
    ).withColumn("short", F.substring("full", 1, SHORT))
    urls = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        _those(F.size(labels), depths, 1), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    )
    prefixes = F.transform(_those(F.length("path"), lengths, 0), lambda n: F.substring(F.col("path"), F.lit(1), n))
    # expanded where the rows are read: the first expression of a row, or that of a row without any, counts the row
    expressions = urls.select(
        "*", F.posexplode_outer(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(" "), p))))).alias("place", "expression")
    ).select("page_id", "url", "host", "path", (F.coalesce("place", F.lit(0)) == 0).cast("long").alias("times"), F.sha2("expression", 256).alias("sha"))
    key = (F.col("at") == F.col("short")) & (F.col("sha") == F.col("full"))
    expressions = expressions.withColumn("at", F.substring("sha", 1, SHORT))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = expressions.join(F.broadcast(rules), key, "left")
    else:
        salted = rules.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = expressions.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        met = dealt.join(salted, key & (F.col("salt") == F.col("salt2")), "left")
    best = met.groupBy("page_id", "url").agg(
        F.max("found").alias("found"), F.sum("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path")
    )
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_copy"),
    ).drop("_copy")
