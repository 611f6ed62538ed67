"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import kept

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules up to this many may be sent to every executor; more are joined by a shuffle on the short hash and one of SALTS shares.
BROADCAST_RULES, SALTS = 100_000, 32


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z in lower case; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower()))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or end; empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + F.lit(3), F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Each row of pages with host, path, the deciding rule (null if none) and its verdict.

    rules: (host string, path string, verdict string). A rule fits its host and every subdomain if the url's path
    starts with the rule's path. The longest expression (host and path together) wins, then the longer host, then
    block over allow. Urls that no rule fits get `default`. A null url, or one without ://, has an empty host and
    path, which no rule with a host fits. Rules with a null part are ignored, and repeated ones change nothing.

    Columns named like the outputs, in any case of letters, are replaced; an empty table gives an empty one and repeated rows
    give repeated rows.

    Every distinct (host, path) of the urls is expanded once, into its host suffixes of as many labels as some rule's host
    has, times the path prefixes of those lengths that occur among the rules' paths, so work is linear in a url's length; an equi-join on the first four digest bytes finds candidates and the
    full digest confirms them. A busy host or a repeated url thus costs one expansion, and repeated rows meet their
    verdict again by an equi-join that adaptive execution can split. A url of any length counts whole; a long one's row grows
    only by the suffixes and prefixes that rules could fit. All of it is DataFrame functions.

    Up to BROADCAST_RULES rules go to every executor. More are shuffled, SALTS copies of each: a suffix like `org` may stand
    in a third of the urls under one short hash, and the hash of host and path deals these among the copies.
    """
    spark = pages.sparkSession
    given = rules.dropna().where(F.col("host") != "").select("host", "path", "verdict").distinct()
    listed = given.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"), digest(F.concat_ws("\n", "host", "path")).alias("full"), F.length("path").alias("path_len"))
    listed = listed.withColumn("short", F.substring("full", 1, 4))
    # the distinct lengths are as many as the longest rule path has characters and the longest rule host labels at most
    lengths = sorted(r[0] for r in given.select(F.length("path")).distinct().collect())
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit(".")))
    labels = sorted(r[0] for r in given.select(dots + 1).distinct().collect())
    names = kept(pages, ("host", "path", "rule", "verdict"))
    shaped = pages.select(*[F.col(f"`{c}`") for c in names], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    if not lengths:
        return shaped.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    suffixes = F.filter(F.array(*[F.when(dots >= n - 1, F.substring_index("host", ".", -n)) for n in labels]), lambda x: x.isNotNull())
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = (
        shaped.where(F.col("host") != "").select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", digest(F.concat_ws("\n", "suffix", "prefix")))
        .withColumn("short", F.substring("digest", 1, 4))
    )
    if listed.count() <= BROADCAST_RULES:
        near = expanded.join(F.broadcast(listed), "short")
    else:
        copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = expanded.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(copies, ["short", "salt"])
    found = near.where(F.col("digest") == F.col("full"))
    rank = F.struct(F.length("rule"), "host_len", F.when(F.col("verdict") == "block", 1).otherwise(0), "rule", "verdict")
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return shaped.join(best, ["host", "path"], "left").select(*names, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
