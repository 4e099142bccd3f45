"""Allow and block rules for URLs, by equi-joins on short hash prefixes of host and path expressions.

A URL is expanded into its host's suffixes (``www.a.com``, ``a.com``, ``com``) times the
directories of its path (``/en/x/``, ``/en/``, ``/`` and nothing). A rule has one such
expression: its host and its path up to the last slash. Both sides meet on the first 32
bits of the expression's digest; the whole digest and the rest of the rule's path confirm
a hit. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldmatch.session import dimension

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#`` after the scheme, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to the first ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), directory), 256)


def _directory(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"^[\s\S]*/", 0)


def compile_rules(rules: DataFrame) -> DataFrame:
    """``rules(host, path, verdict)`` with their expression's digest and its prefix.

    A null path is empty; rules without host or verdict are left out. Of rules equal in host
    and path the one with the smaller verdict stays, so a repeated rule counts once.
    """
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    given = rules.where("host IS NOT NULL AND verdict IS NOT NULL")
    once = given.groupBy(host.alias("rule_host"), path.alias("rule_path")).agg(F.min("verdict").alias("rule_verdict"))
    directory = _directory(F.col("rule_path"))
    return once.select(
        "*",
        F.size(F.split("rule_host", r"\.", -1)).alias("n_labels"),
        (F.length(directory) - F.length(F.translate(directory, "/", ""))).alias("n_slashes"),
        _digest(F.col("rule_host"), directory).alias("digest"),
    ).withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS)))


def expressions(urls: DataFrame, max_labels: int, max_slashes: int) -> DataFrame:
    """``url, host, path`` and the prefix and digest of every expression a rule could have.

    Suffixes of more labels and directories of more slashes than any rule has are left out:
    no rule can equal them.
    """
    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffix = lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max_labels))), suffix)
    steps = F.split("path", "/", -1)
    slashes = F.least(F.size(steps) - 1, F.lit(max_slashes))
    directory = lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")))
    directories = F.transform(F.sequence(F.lit(0), slashes), directory)
    by_host = urls.select("url", "host", "path", directories.alias("_dirs"), F.explode(suffixes).alias("_suffix"))
    each = by_host.select("url", "host", "path", "_suffix", F.explode("_dirs").alias("_dir"))
    return each.select("url", "path", _digest(F.col("_suffix"), F.col("_dir")).alias("digest")).withColumn("prefix", F.left("digest", F.lit(PREFIX_DIGITS)))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``key, url, host, path, rule, verdict`` of every row of ``pages``.

    A rule ``(host, path, verdict)`` fits its host and all subdomains where the URL's path
    starts with the rule's. Of those that fit, the longest (host and path together, then
    host) wins; all that fit one URL are suffixes and prefixes of the same two texts, so
    that is one rule. ``rule`` is its host and path, null where none fits; ``verdict`` is
    then ``default``.

    Every row comes once, repeated ones as often as they occur. A null URL, or one without
    ``://``, has an empty host and path, which only a rule with an empty host could fit.
    Neither hosts nor paths are cut short; ports and user names stay part of the host.
    Other columns of ``pages`` are not used. Empty tables of pages give an empty result,
    without rules every page gets ``default``.

    Hits are reduced to one line per URL before they are shuffled, and only the URLs that
    some rule fits go back to the rows. Rules and those lines are measured; up to 64 MB they
    are broadcast, above that adaptive execution splits hot keys.
    """
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("url"))
    rows = rows.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    compiled = dimension(compile_rules(rules), "url-rules")
    widest = compiled.agg(F.max("n_labels").alias("labels"), F.max("n_slashes").alias("slashes")).first()
    asked = expressions(rows.select("url", "host", "path").where("url IS NOT NULL"), widest["labels"] or 1, widest["slashes"] or 0)
    hits = asked.join(compiled.withColumnRenamed("digest", "rule_digest"), "prefix").where("digest = rule_digest AND startswith(path, rule_path)")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = dimension(hits.groupBy("url").agg(F.max(rank).alias("best")), "url-verdicts")
    return rows.join(best, "url", "left").select(
        F.col("_key").alias(key), "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
