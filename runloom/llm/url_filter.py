"""Pattern rules for URLs, indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rules up to this count are sent to all tasks; more are joined by shuffling tokens.
BROADCAST_RULES = 50_000
# Pages of a URL with more than this many meet its verdict in several parts.
PART_PAGES = 10_000


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, host, path, verdict) from (verdict, host, path) triples; the rule's name is host and path."""
    rows = [(h + p, h, p, v) for v, h, p in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^./:@_~%&=+,;-]+)"), 1)


def _quoted(text: Column) -> Column:
    """A regular expression that matches just this text."""
    return F.regexp_replace(text, r"([\\\[\]{}()*+?.^$|#&~-])", r"\\$1")


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules with their pattern and the token that fewest rules have.

    A pattern holds for the host itself and its subdomains, and for paths that start with
    the rule's. A path's last token counts only if the rule goes on after it, since a URL
    may continue the token. A rule without any token gets the empty token, which every URL
    fetches. Rules with a null host or path never fit and are left out; of equal rules the
    blocking one counts.
    """
    whole = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("rule", "host", "path").agg(
        F.max("verdict").alias("verdict"))
    closed = F.regexp_replace("path", r"[^./:@_~%&=+,;-]+$", "")
    listed = whole.withColumn("tokens", F.array_distinct(F.concat(_tokens(F.col("host")), _tokens(closed))))
    tokens = listed.select("rule", "host", "path", F.explode_outer("tokens").alias("token"))
    uses = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rarest = tokens.join(uses, "token", "left").groupBy("rule", "host", "path").agg(
        F.coalesce(F.min(F.struct("uses", "token"))["token"], F.lit("")).alias("token"))
    pattern = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), _quoted(F.col("host")), F.when(
        F.col("path") == "", F.lit("(?:/|$)")).otherwise(_quoted(F.col("path"))))
    return whole.join(rarest, ["rule", "host", "path"]).select("rule", "verdict", "token", pattern.alias("pattern"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES, part_pages: int = PART_PAGES,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL.

    Distinct URLs are judged once: their tokens are joined with the rule index, and only
    the rules so fetched run their patterns. The longest fitting rule wins (of equal
    length, the one that is first in order); no fitting rule gives a null rule and
    ``default``. Null URLs and URLs without ``://`` have an empty host and path and fit no
    rule; they are judged where they lie. A URL of very many pages is met in parts of about
    ``part_pages``. Columns of ``pages`` named like a result column are replaced, others
    pass through whatever their names.
    """
    index = index_rules(rules)
    if index.count() <= broadcast_rules:
        index = F.broadcast(index)
    results = ["host", "path", "rule", "verdict"]
    kept = [i for i, c in enumerate(pages.columns) if c not in results]
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))]).withColumn("url", F.col(f"c{pages.columns.index(url)}"))
    plain = plain.select(*[f"c{i}" for i in kept], "url")
    with_host = F.coalesce(F.col("url").contains("://"), F.lit(False))
    located = plain.filter(with_host).groupBy("url").agg(F.count(F.lit(1)).alias("pages")).select(
        "url", F.ceil(F.col("pages") / F.lit(float(part_pages))).cast("int").alias("parts"),
        F.concat(url_host(F.col("url")), url_path(F.col("url"))).alias("place"))
    fetched = located.select(
        "url", "parts", "place",
        F.explode(F.array_distinct(F.concat(_tokens(F.col("place")), F.array(F.lit(""))))).alias("token"),
    ).join(index, "token").filter(F.expr("regexp_like(place, pattern)"))
    best = materialise(fetched.groupBy("url").agg(
        F.first("parts").alias("parts"),
        F.min(F.struct((-F.length("rule")).alias("size"), "rule", "verdict")).alias("best")), "verdicts")
    # By the row's values, so that a task that runs again deals rows out the same way.
    spread = [F.col(f.name) for f in plain.schema.fields if "map" not in f.dataType.simpleString()]
    # One row for each ``part_pages`` pages of a frequent URL, so at most that share of all pages.
    often = best.filter("parts > 1").select("url", "parts")
    met = plain.filter(with_host).join(
        F.broadcast(often) if often.count() <= broadcast_rules else often, "url", "left").withColumn(
        "part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int")).otherwise(F.lit(0))).drop("parts")
    parted = best.select("url", "best", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    host, path = F.coalesce(url_host(F.col("url")), F.lit("")), url_path(F.col("url"))
    judged = met.join(parted, ["url", "part"], "left").select(
        *[f"c{i}" for i in kept], host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
    nowhere = plain.filter(~with_host).select(
        *[f"c{i}" for i in kept], F.lit("").alias("host"), F.lit("").alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit(default).alias("verdict"))
    return judged.unionByName(nowhere).toDF(*[pages.columns[i] for i in kept], *results)
