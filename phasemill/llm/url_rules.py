"""Allow and block rules for URLs by hashed host-suffix and path-prefix expressions.

A rule names a host and the beginning of a path. A URL is expanded into expressions: every suffix
of its host at a dot, each with every prefix of its path that ends in a slash and with none. A rule
is kept under the first bytes of the digest of its own such expression, so rules and URLs meet in
an equi-join on short hash prefixes; what meets is confirmed by the full digest of the rule against
that of the URL cut to the rule's length. Of the rules that fit, the longest decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest by which rules and URLs meet: 32 bits.
PREFIX_DIGITS = 8
#: Rules up to this number are broadcast, some 200 bytes each; more are shuffled by their hash prefix.
BROADCAST_RULES = 100_000
RULES_SCHEMA = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _slashed(path: Column) -> Column:
    """The part of a path up to its last slash, that included; empty without one."""
    return F.regexp_extract(path, "(?s)^.*/", 0)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def keyed(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) by the hash prefix under which they are found, one row for each different host and path.

    Hosts are lower-cased (A-Z). A null host or path counts as empty, a rule whose verdict isn't allow
    or block is an error, and of a rule given with both verdicts block counts.
    """
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.expr("if(verdict in ('allow', 'block'), verdict, raise_error(concat('not a verdict: ', coalesce(verdict, 'null'))))").alias("verdict"))
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule, base = F.concat("host", "path"), _slashed(F.col("path"))
    return one.select(
        F.substr(_digest(F.concat("host", base)), F.lit(1), F.lit(PREFIX_DIGITS)).alias("prefix"), _digest(rule).alias("digest"), F.length("path").alias("path_size"), F.length("host").alias("host_size"),
        rule.alias("rule"), F.col("verdict").alias("rule_verdict"), F.size(F.split("host", r"\.")).alias("labels"), (F.size(F.split(base, "/")) - 1).alias("slashes"),
    )


def expressions(host: Column, path: Column, labels: int, slashes: int) -> tuple[Column, Column]:
    """Suffixes of a host of so many labels at most, and prefixes of a path of so many slashes at most, each to a slash, the empty one first; arrays."""
    words, parts = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.greatest(F.size(words) - (labels - 1), F.lit(1)), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(slashes))), lambda i: F.when(i == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    return suffixes, prefixes


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow", carry: tuple[str, ...] = (), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict and the carried columns.

    rules (host, path, verdict): a rule fits its host and all subdomains, where the URL's path starts
    with the rule's. The longest that fits (host and path together, then the longer host) gives rule
    and verdict; where none fits, rule is null and verdict the default. A null URL and one without
    :// have an empty host and path, which only a rule of an empty host and path fits. A rule's path
    need not end in a slash. Rows are judged one by one, so repeated rows and null keys stay as they
    are; carried columns may have any name but those of the result. No rows give no rows, no rules
    the default. A URL of any length makes expressions of as many labels and slashes as any rule has
    and no more, for a longer one can't be a rule's.

    Up to broadcast_rules rules, which are counted, go to every executor; more are shuffled by their
    hash prefix, where adaptive execution splits an expression that many URLs share. The one shuffle
    of pages has a row for each, after the rules that fit were compared within its task.
    """
    known = keyed(rules)
    count, labels, slashes = known.agg(F.count("*"), F.max("labels"), F.max("slashes")).first()
    if count <= broadcast_rules:
        known = F.broadcast(known)
    host, path = host_and_path(F.col(url))
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(0)
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{key}`").alias("_key"), host.alias("_host"), path.alias("_path"), carried.alias("_carried"))
    suffixes, prefixes = expressions(F.col("_host"), F.col("_path"), labels or 1, slashes or 0)
    # of a page's expressions only the first carries the page itself
    by_host = rows.select("*", F.posexplode(suffixes).alias("_i", "_suffix")).select("*", F.posexplode(prefixes).alias("_j", "_slashed"))
    page = F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.struct("_key", "_host", "_carried"))
    hashed = by_host.select("_row", "_path", "_suffix", page.alias("_page"), F.substr(_digest(F.concat("_suffix", "_slashed")), F.lit(1), F.lit(PREFIX_DIGITS)).alias("_prefix"))
    confirmed = _digest(F.concat("_suffix", F.substr("_path", F.lit(1), F.col("path_size")))) == F.col("digest")
    met = hashed.join(known, (F.col("_prefix") == F.col("prefix")) & confirmed, "left")
    fit = F.when(F.col("digest").isNotNull(), F.struct(F.length("rule").alias("size"), "host_size", "rule", "rule_verdict"))
    found = met.groupBy("_row").agg(F.max(fit).alias("_best"), F.first("_page", ignorenulls=True).alias("_page"), F.first("_path").alias("_path"))
    return found.select(
        F.col("_page._key").alias(key), F.col("_page._host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"),
        *(F.col(f"_page._carried.`{c}`").alias(c) for c in carry),
    )
