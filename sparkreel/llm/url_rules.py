"""Allow and block rules for the addresses clips were published at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkreel.llm.records import ascii_lower, as_long

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
PREFIX_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://`` or for NULL."""
    part = lambda k: F.coalesce(F.regexp_extract(url, ADDRESS, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return as_long(F.substring(digest, 1, PREFIX_DIGITS))


def url_verdicts(uploads: DataFrame, rules: DataFrame, key: str = "clip_id", default: str = "allow") -> DataFrame:
    """Judge every upload's address by the longest rule that fits it.

    ``uploads(<key>, youtube_url)``, ``rules(host, path, verdict)``. Returns ``(<key>, host, path, rule, verdict)``, one row
    per row of ``uploads``.

    A rule fits its host and all subdomains when the path starts with the rule's path. Each distinct address is expanded first into
    its host suffixes, which meet the rules' hosts on a 32-bit prefix of their SHA-256 and are confirmed by the full digest;
    only for hosts that have rules is the path expanded into prefixes of the lengths these rules have, and suffix plus prefix meet
    the rules in the same way. Of the rules that fit, the longest host plus path wins, then the longer host, then ``block``.
    Where none fits, ``rule`` is NULL and ``verdict`` is ``default``.

    NULL or malformed addresses have empty host and path; such a host is fitted by no rule. Repeated rows each get
    their verdict; rules with NULL in any column are skipped; repeated rules count once. Empty tables give no rows, or ``default``.
    Only distinct addresses are expanded, so a hot address costs one row, and the join back is one that AQE can split.
    """
    rules = (rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
             .dropna().filter(F.col("rule_host") != "")
             .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict")))
    # One number from the rules, so that a host of thousands of labels isn't expanded beyond what a rule can have.
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0

    host, path = split_url(F.col("youtube_url"))
    rows = uploads.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"))
    if not labels:
        return rows.select(F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    rule_hosts = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths")).select(
        _digest(F.col("rule_host")).alias("host_digest"), "lengths").withColumn("host_prefix", _prefix(F.col("host_digest")))
    whole = _digest(F.concat("rule_host", "rule_path"))
    # Host and path meet where the path's first slash stands, so their sizes are compared beside the digest of both together.
    targets = rules.select("rule_host", "rule_path", "rule_verdict", whole.alias("rule_digest")).withColumn("rule_prefix", _prefix(F.col("rule_digest")))

    hosts = rows.select("host").distinct().filter(F.col("host") != "")
    parts = F.size(F.split("host", r"\."))
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.least(parts, F.lit(labels))),
                                   lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)))
    suffixes = hosts.select("host", suffix.alias("suffix")).filter(F.col("suffix") != "").withColumn("suffix_digest", _digest(F.col("suffix")))
    ruled = suffixes.withColumn("host_prefix", _prefix(F.col("suffix_digest"))).join(rule_hosts, "host_prefix").filter(
        F.col("suffix_digest") == F.col("host_digest")).select("host", "suffix", "lengths")

    addresses = rows.select("host", "path").distinct()
    lengths = F.explode(F.filter("lengths", lambda n: n <= F.length("path")))
    expressions = addresses.join(ruled, "host").select("host", "path", "suffix", lengths.alias("n"))
    expressions = expressions.withColumn("digest", _digest(F.concat("suffix", F.expr("left(path, n)"))))
    fits = expressions.withColumn("rule_prefix", _prefix(F.col("digest"))).join(targets, "rule_prefix").filter(
        (F.col("digest") == F.col("rule_digest")) & (F.length("suffix") == F.length("rule_host")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("host_long"),
        F.col("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
