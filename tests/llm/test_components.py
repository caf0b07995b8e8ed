"""Connected components of long paths."""

import random

from plainweave.llm.components import components


def test_a_long_path_in_any_order(spark):
    order = [10 * x for x in range(1000)]
    random.Random(3).shuffle(order)
    edges = [*zip(order, order[1:]), (7, 3), (3, 5), (20_001, 20_002)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 0 for x in order} | {3: 3, 5: 3, 7: 3, 20_001: 20_001, 20_002: 20_001}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
