"""URL filter: host-suffix and path-prefix expressions, found by short hash and confirmed by full digest."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from formscribe.llm.words import lower_ascii

#: Hexadecimal digits of the digest that the join compares first.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    """Digest of one expression; the length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix (at dots) with every path prefix of one of the given lengths."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: its id, host, path, the rule that decides (null without one) and the verdict.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the path starts
    with its path. The longest rule (host and path together) wins, then the longer host, then block before allow;
    a page without a rule gets `default`.

    Distinct (host, path) pairs are expanded, so repeated urls are judged once; expressions meet the rules in an
    equi-join on a short piece of the digest and are confirmed by the full digest. The prefix lengths are those that
    occur among the rules: as many numbers as the longest rule path has characters, at most.

    Null or scheme-less urls have empty host and path. Rules with a null host, path or verdict fit nothing. Repeated
    rows, null ids and extra columns are fine: each input row gives one row. An empty table gives no rows.
    """
    known = (
        rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna()
        .distinct()
        .withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("rule_short", F.substring("rule_digest", 1, SHORT))
    )
    lengths = sorted(r[0] for r in known.select(F.length("rule_path")).distinct().collect())
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    if not lengths:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    found = (
        base.select("host", "path")
        .distinct()
        .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
        .withColumn("full", digest(F.col("e.host"), F.col("e.path")))
        .withColumn("short", F.substring("full", 1, SHORT))
        .join(known, (F.col("short") == F.col("rule_short")) & (F.col("full") == F.col("rule_digest")))
    )
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = found.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(rank).alias("best"))
    return base.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
