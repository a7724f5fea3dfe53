"""Few words or queries don't gather the items that hold them."""

from __future__ import annotations

from roadloom.operators import search


def test_items_stay_where_they_lie(spark):
    items = spark.createDataFrame([(i, ["red brick house" if i % 3 else "red barn"]) for i in range(300)], "item_id long, strs array<string>")
    queries = spark.createDataFrame([(0, "red house"), (1, "brick"), (2, "red nothing"), (3, "barn red")], "query_id long, q string")
    found = search.match_items(queries, items)
    # no join, group or window deals the items by word, trigram or query
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(q, i) for i in range(300) for q, there in ((0, i % 3), (1, i % 3), (3, not i % 3)) if there}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
