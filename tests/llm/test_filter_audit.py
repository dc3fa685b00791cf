import math
import re
from collections import Counter
from itertools import permutations

import pandas as pd
import pytest

from runloom.llm import filter_audit
from runloom.llm.queries import AUDIT_SQL, FILTERS, QUERIES

from ..oracle import connect, differences


def brute(docs, labels):
    """The definition, document by document and order by order. docs: (id, text, source); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        body = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", body)
        fails = {x for x, bad in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", body)) > 2 * len(body)), ("D", re.search(r"[#$%&*|]", body)),
            ("E", i is not None and any(j is not None and j < i and (t or "") == body for j, t, _ in docs))) if bad}
        rows.append((source or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                before = [r for r in own if not any(r is k for k in left)]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in r[1] for r in before), sum(r[1] == {x} for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), x]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = shapley[v[-1]] if isinstance(v[-1], str) else v[-1]
    return out


def audited(docs, labels):
    got = filter_audit.audit_orders(filter_audit.failure_counts(docs, labels, FILTERS), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): [
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}, len(got)


def test_odd_rows_equal_brute_force(spark, odd_docs, many_partitions):
    marks = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (6, 1, 1), (7, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (8, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    more = odd_docs.unionByName(spark.createDataFrame(
        [(20, "# A B " * 300, "en", "a"), (21, "# A B " * 300, "en", None), (22, "w%d " * 3, "en", "b"),
         (23, " ".join(f"w{i}" for i in range(250)), "en", "a"), (24, " ".join(f"w{i}" for i in range(250)), "en", "b"),
         (24, "SHOUT " * 300, "en", "b"), (24, "SHOUT " * 300, "en", "b")], "doc_id long, text string, lang string, source string"),
        allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.source) for r in more.collect()]
    got, n = audited(more, labels)
    assert n == len(got) == 600 * 3
    assert got == brute(rows, marks)


def test_empty_table_has_no_rows(spark, no_docs):
    assert audited(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == ({}, 0)


@pytest.mark.parametrize("size", [1, 2, 4, 5])
def test_intervals_say_where_each_mask_goes(size):
    orders = list(permutations(range(size)))
    gone = {}
    for mask, step, first, end in filter_audit.removal_intervals(size):
        for rank in range(first, end):
            assert (mask, rank) not in gone
            gone[mask, rank] = step
    for mask in range(1, 1 << size):
        for rank, order in enumerate(orders):
            assert gone[mask, rank] == next(k for k, f in enumerate(order, 1) if mask >> f & 1)
    assert len(gone) == math.factorial(size) * ((1 << size) - 1)


def test_long_texts_are_split_whole(monkeypatch):
    data = ("aa bb  cc\n" * 50 + "x" * 90 + " aa").encode()
    whole = filter_audit._words(data)
    monkeypatch.setattr(filter_audit, "PIECE", 16)
    assert filter_audit._words(data) == whole == (152, 4)


def test_facts_pass_other_columns_through(spark):
    docs = spark.createDataFrame([(1, "a B", {"k": 1}, 2.0)], "`a.b` long, text string, m map<string,int>, n_words double")
    row = filter_audit.text_facts(docs).first()
    assert row["a.b"] == 1 and row["m"] == {"k": 1} and (row["n_words"], row["n_upper"], row["n_chars"]) == (2, 1, 3)


def test_query_equals_sql(spark, sf_dir):
    got = QUERIES["op12_filter_audit"](spark, sf_dir).toPandas()
    assert differences(got, connect(sf_dir).execute(AUDIT_SQL).df()) == []
    assert isinstance(got, pd.DataFrame) and len(got) % 600 == 0
