"""URL block and allow rules by hashed host-suffix and path-prefix expressions.

A rule (host, path) fits its host and all subdomains if the path of the url starts
with the rule's path.  Each url expands into the expressions ``suffix + prefix`` that
a rule could be; expressions meet the rules by an equi-join on the first hash bytes,
full digests confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, bind

# Hexadecimal digits of a SHA-256 digest that serve as the join key.
# Parts that the pages of one matched tail and head are dealt to.
SHARES = 32
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table (verdict, host, path) from a list."""
    rows = [F.struct(*(F.lit(x).alias(k) for k, x in zip(("verdict", "host", "path"), r))) for r in rules]
    if not rows:
        return spark.createDataFrame([], "verdict string, host string, path string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def suffixes(host: Column, labels: int) -> Column:
    """The last 1 to ``labels`` labels of a host."""

    def last(parts: Column) -> Column:
        counts = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
        return F.transform(counts, lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))

    return bind(F.split(host, "[.]"), last)


def prefixes(path: Column, longest: int, lengths: list[int]) -> Column:
    """Prefixes of a path that a rule could have: up to each slash, and of the given lengths."""
    head = F.substring(path, 1, longest)

    def cut(h: Column) -> Column:
        ends = F.sequence(F.lit(1), F.length(h))
        slashes = F.filter(ends, lambda i: F.substring(h, i, F.lit(1)) == "/")
        fixed = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(h))
        at_slash = F.when(F.length(h) > 0, slashes).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_distinct(F.concat(at_slash, fixed)), lambda i: F.substring(h, F.lit(1), i))

    return bind(head, cut)


def judge(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``rules``: verdict (block or allow), host, path.  The rule with the most characters
    wins; of equally long ones the longer host, then block before allow.  A url that no rule fits has
    rule null and verdict ``default``.  Null urls and urls without ``://`` have host
    and path empty.  Rules with a null part fit nothing; repeated rules count once; repeated rows
    of ``pages`` are repeated; an empty table gives none.

    Only what a rule can see of a url (the last labels of the host, the head of the
    path) is expanded, once for each distinct value.
    """
    rules = rules.select(
        F.col("verdict").alias("says"), ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path")
    ).dropna()
    # Three small numbers and the lengths of rule paths that do not end in a slash.
    shape = rules.agg(
        F.max(F.size(F.split("r_host", "[.]"))),
        F.max(F.length("r_path")),
        F.collect_set(F.when(~F.col("r_path").endswith("/"), F.length("r_path"))),
    ).first()
    labels, longest, lengths = shape[0] or 1, shape[1] or 0, sorted(shape[2] or [])

    urls = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    # Past the last slash in reach only the fixed lengths matter.
    seen = F.substring("path", 1, longest)
    head = F.substring(
        seen, F.lit(1), F.greatest(F.length(seen) - F.length(F.substring_index(seen, "/", -1)), F.lit(max(lengths, default=0)))
    )
    urls = urls.withColumns({"__tail": F.substring_index("host", ".", -labels), "__head": head})

    expressions = (
        urls.select("__tail", "__head")
        .distinct()
        .withColumn("suffix", F.explode(suffixes(F.col("__tail"), labels)))
        .withColumn("prefix", F.explode(prefixes(F.col("__head"), longest, lengths)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    )
    hashed = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "r_key", F.substring("r_digest", 1, PREFIX_DIGITS)
    )
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("says") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        "says",
    )
    found = (
        expressions.join(hashed, F.col("key") == F.col("r_key"))
        .filter("digest = r_digest")
        .groupBy("__tail", "__head")
        .agg(F.max(rank).alias("best"))
    )
    # All pages of a site may share one tail and head: they are spread, and each matched pair is there once per share.
    urls = urls.withColumn("__share", F.pmod(F.xxhash64(id_col, "host", "path"), F.lit(SHARES)))
    found = found.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    return urls.join(found, ["__tail", "__head", "__share"], "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict")
    )


def _digest(host: Column, path: Column) -> Column:
    """SHA-256 over host and path with a byte between that neither can be split at."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)
