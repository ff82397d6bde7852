"""URL filters by hash prefixes, in DataFrame operations only.

A rule names a host and a path: it fits the host and its subdomains where the
URL's path starts with the rule's. Each URL is expanded into host suffixes
times path prefixes that end in a slash. The first 32 bits of an expression's
SHA-256 are joined with those of the rules, the full digest confirms, and what
a rule's path has after its last slash is compared as text. The longest rule
wins: first host and path together, then the host alone, then ``block``.

URLs are not expanded further than any rule reaches, so a URL of thousands of
labels or slashes stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import quoted

RESULTS = ("host", "path", "rule", "verdict")
#: So many rules are broadcast at most; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``).
    Columns of the input with a result's name are replaced. Repeated rows and
    rows with nulls each give one row.
    """
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host is not null").distinct()
    anchor = F.regexp_extract("path", r"(?s)^(.*/)", 1)
    reach = rules.select(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.size(F.split(anchor, "/"))).alias("slashes"), F.count("*").alias("n")
    ).first()
    digest = _digest(F.col("host"), anchor)
    keyed = rules.select(
        F.substring(digest, 1, 8).alias("_prefix"),
        digest.alias("_digest"),
        F.col("path").alias("_rule_path"),
        F.struct(
            (F.length("host") + F.length("path")).alias("long"),
            F.length("host").alias("host"),
            (F.col("verdict") == "block").cast("int").alias("block"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("_found"),
    )
    if reach["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)

    host, path = host_and_path(quoted(url))
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.struct(*[quoted(c) for c in kept]).alias("_kept"), host.alias("_host"), path.alias("_path")
    )
    labels, steps = F.split("_host", r"\."), F.split("_path", "/")
    first = F.greatest(F.size(labels) - F.lit((reach["labels"] or 1) - 1), F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    depth = F.least(F.size(steps), F.lit(max(reach["slashes"] or 1, 1)))
    prefixes = F.transform(
        F.sequence(F.lit(1), depth), lambda i: F.when(i == 1, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, i - 1), "/"), F.lit("/")))
    )
    expanded = rows.withColumn("_suffix", F.explode(suffixes)).withColumn("_step", F.explode(prefixes))
    expanded = expanded.withColumn("_full", _digest(F.col("_suffix"), F.col("_step")))
    fits = (
        (F.substring("_full", 1, 8) == F.col("_prefix")) & (F.col("_full") == F.col("_digest")) & F.startswith(F.col("_path"), F.col("_rule_path"))
    )
    judged = (
        expanded.join(keyed, fits, "left")
        .groupBy("_row")
        .agg(F.first("_kept").alias("_kept"), F.first("_host").alias("host"), F.first("_path").alias("path"), F.max("_found").alias("_best"))
    )
    return judged.select(
        *[F.col("_kept")[c].alias(c) for c in kept],
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
