"""Resources put together by document, against the tables they are made from."""

import pytest

from plainweave.operators import graphs
from plainweave.operators.mentions import mention_counts
from plainweave.plans import standins

MENTIONS = [
    (1, 0, 5, "u:a", ["Schema:C1"]), (1, 7, 40, "u:a", ["Schema:C2", "x"]), (1, 3, 20, "u:b", []), (2, 1, 9, "u:a", None), (2, 2, 12, "u:none", []),
    (None, 0, 1, "u:a", []), (None, 4, 8, "u:a", ["Schema:C3"]), (3, 1, 2, None, ["Schema:C1"]), (3, 2, 6, "u:b", ["Schema:C1"]),
]
INFO = [("u:a", ["Schema:C9"], 3, 4), ("u:b", [], 0, 1), ("u:unseen", ["Schema:C5"], 7, 7)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(MENTIONS, "doc_id long, ord long, offset long, uri string, types array<string>")


@pytest.fixture(scope="module")
def info(spark):
    return spark.createDataFrame(INFO, "uri string, types array<string>, nb_links_in long, nb_links_out long")


def collected(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_resources_by_document(spark, rows, info, most):
    plain = graphs.resources(mention_counts(rows, "doc_id"), info, "doc_id")
    found = graphs.stored_resources(rows, info, "doc_id", most)
    assert collected(found.select(plain.columns)) == collected(plain)
    assert found.grouped.count() == 4
    for a, b in zip(graphs.built(found, standins.taxonomy(spark), key="doc_id"), graphs.built(plain, standins.taxonomy(spark), key="doc_id"), strict=True):
        assert collected(a) == collected(b)
    none = graphs.stored_resources(rows.limit(0), info, "doc_id", most)
    assert none.count() == none.grouped.count() == 0


def test_mentions_are_shuffled_once_to_their_document(spark, rows, info, monkeypatch):
    plans = {}

    def stored(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(graphs, "stored", stored)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        graphs.stored_resources(rows, info, "doc_id")
        plan = plans["resources"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    assert plan.split("BroadcastExchange")[0].count("Exchange hashpartitioning(uri") == 0
