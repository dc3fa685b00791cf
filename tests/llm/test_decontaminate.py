import re

import duckdb
import pandas as pd
import pytest

from runloom.llm import decontaminate
from runloom.llm.queries import QUERIES, SQL
from tests.oracle import connect, differences


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(w, n):
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = set()
    parts = [(i, runs(w, min(5, len(w))), min(5, len(w))) for i, t in items if i is not None and (w := words(t))]
    for d, text in docs:
        own = words(text)
        for i, s, n in parts:
            shared = len(s & runs(own, n))
            if 5 * shared >= 4 * len(s):
                out.add((d, i, shared, len(s)))
    return out


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    got = {tuple(r) for r in QUERIES["op2_benchmark_decontamination"](spark, sf_dir).collect()}
    expect = brute(zip(docs_frame.doc_id.tolist(), docs_frame.text), list(zip(items.item_id.tolist(), items.text)))
    assert got == expect and got


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_odd_rows(spark, odd_docs, broadcast_rows):
    items = [(1, "quick brown fox jumps over the LAZY, dog"), (2, "one two three"), (3, None), (4, ""), (None, "one two three"),
             (5, "long long long long long long"), (6, "fox jumps over the lazy dog and sleeps in another far country"), (2, "one two three")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contaminated(odd_docs, bench, broadcast_rows=broadcast_rows)
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()}
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    kept = decontaminate.clean_documents(odd_docs, bench, broadcast_rows=broadcast_rows)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "4", "5", "8", "None"]


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_short_items_are_found_inside_documents(spark, broadcast_rows):
    docs = [(1, "and one two three four five six"), (2, "one two three"), (3, "one, two"), (4, "three one two"), (5, "ONE"), (6, "x one-two y"),
            (7, ""), (8, None), (9, "seven eight nine ten eleven"), (10, "a seven eight nine ten eleven b"), (11, "one two")]
    items = [(1, "one two three"), (2, "one two"), (3, "One"), (4, "three four five six"), (5, "seven eight nine ten eleven"), (6, "zero"),
             (7, " . ")]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        broadcast_rows=broadcast_rows)
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()}
    assert got == brute(docs, items) and (1, 1, 1, 1) in got and (6, 2, 1, 1) in got and len({g[1] for g in got}) == 5


def test_items_of_many_sizes_share_one_sentence(spark):
    line = "all items begin with this very common template sentence "
    items = [(i, line + " ".join(f"w{i}x{j}" for j in range(i * i))) for i in range(30)]
    docs = [(i, f"before {t} after") for i, t in items] + [(100, line * 3), (101, line[4:])]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()}
    assert got == brute(docs, items) and {(i, i) for i in range(30)} <= {g[:2] for g in got}
    index = decontaminate.index_items(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert index.select("band").distinct().count() > 5


def test_columns_of_any_name(spark):
    docs = spark.sql("""
        SELECT 1L AS doc_id, 'a b c d e f' AS text, 3 AS _doc, 4 AS _hash, 5 AS `a.b`, map('k', 1) AS m, 6 AS text_hash, 7 AS item
        UNION ALL SELECT 2L, 'other words', 3, 4, 5, map('k', 1), 6, 7""")
    items = spark.sql("SELECT 1L AS item_id, 'a b c d e f' AS text, 2 AS hash, 3 AS `x.y`")
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "other words", 3, 4, 5, {"k": 1}, 6, 7)]


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op2_benchmark_decontamination"](spark, sf_dir).toPandas()
    assert differences(got, connect(sf_dir).execute(SQL["op2_benchmark_decontamination"]).df()) == []


def test_sql_finds_short_items(tmp_path):
    pd.DataFrame({"doc_id": [1, 2], "text": ["x one two y", "two one"]}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [1], "text": ["One two"]}).to_parquet(tmp_path / "benchmark.parquet")
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert db.execute(SQL["op2_benchmark_decontamination"]).fetchall() == [(1, 1, 1, 1)]


def test_empty_tables(odd_docs, no_docs, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(odd_docs, nothing).count() == 0
    assert decontaminate.clean_documents(odd_docs, nothing).count() == odd_docs.count()
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(no_docs, some).count() == 0
