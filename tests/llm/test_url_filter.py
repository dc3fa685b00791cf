import pytest
from pyspark.sql import functions as F

from runloom.llm import url_filter
from runloom.llm.queries import QUERIES, SQL
from tests.oracle import connect, differences

URLS = ["http://com/", "https://A.Com/x", "http://x.example.com/en/1", "http://www.example.com/en/1", "http://sub.www.EXAMPLE.com/en/",
        "http://example.com/en", "http://example.com/EN/1", "http://notexample.com/en/1", "http://a.net/es/2?x=/fr/", "http://net/fr/#top",
        "http://a.net/?/es/", "no scheme net/es/", "", None, "http://", "http://a.org", "x://y://b.com/z", "http://a.com?x://b.net/es/",
        "http://a.com:80/p", "http://net/es/\nline", "http://com", "http://www.example.com/en/1"]


def brute(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda r: len(r[0]), default=(None, default))
    return host, path, best[0], best[1]


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/"), ("block", "org", ""), ("block", "example.com", "/e"), ("block", "a.com:80", "/p")]


@pytest.mark.parametrize("broadcast_rules, part_pages", [(0, 10_000), (100, 10_000), (0, 1), (100, 1)])
def test_verdicts_equal_brute_force(spark, broadcast_rules, part_pages):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    table = url_filter.rule_table(spark, RULES)
    got = url_filter.judge_urls(pages, table, broadcast_rules=broadcast_rules, part_pages=part_pages).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u, RULES, "allow") for u in URLS]


def test_rarest_token_and_empty_rules(spark):
    index = {r.rule: r.token for r in url_filter.index_rules(url_filter.rule_table(spark, RULES)).collect()}
    assert index["www.example.com/en/"] == "www" and index["net/es/"] == "es" and index["example.com/e"] == "example"
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, host string, path string, verdict string")
    r = url_filter.judge_urls(pages, none, default="block").first()
    assert (r.rule, r.verdict) == (None, "block")
    assert url_filter.judge_urls(pages.filter("false"), url_filter.rule_table(spark, RULES)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op6_url_filters"](spark, sf_dir).toPandas()
    assert differences(got, connect(sf_dir).execute(SQL["op6_url_filters"]).df()) == []


def test_frequent_urls_are_dealt_out(spark):
    """A third of the pages has no URL, a third one URL; no task of the last join gets more than a tenth."""
    url = F.when(F.col("id") % 3 == 1, "http://a.net/es/1").when(F.col("id") % 3 == 2, F.concat(F.lit("http://x"), "id", F.lit(".com/")))
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("_").alias("_url"), F.lit(1).alias("a.b"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(was, ("false", "-1", "32")):
            spark.conf.set(k, v)
        got = url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES), part_pages=200).withColumn("task", F.spark_partition_id())
        assert got.columns[:4] == ["page_id", "url", "_url", "a.b"]
        rows = got.groupBy("task").agg(F.count("url").alias("n")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert max(r.n for r in rows) <= 3_000
    assert {tuple(r) for r in got.groupBy("rule", "verdict").count().collect()} == {
        (None, "allow", 10_000), ("net/es/", "block", 10_000), ("com/", "allow", 10_000)}


def test_very_long_url(spark):
    url = "http://a.net/es/" + "x/" * 200_000 + "?q"
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = url_filter.judge_urls(pages, url_filter.rule_table(spark, RULES)).first()
    assert (r.host, r.rule, r.verdict) == ("a.net", "net/es/", "block") and len(r.path) == len(url) - len("http://a.net") - 2
