"""Names of a text are counted by one hashed aggregate."""

from repolens.operators import corpus as C


def test_names_are_counted_by_hash(spark):
    text = "Order: id\nOrder: id, total\nOrder: a, b, c\nThe Order. Client9 Client_x éClient Client ClientX Client. Client, Client"
    docs = spark.createDataFrame([(1, text), (1, "Zed Zed\nzed"), (None, "Zed Zed Zed")], "doc_id long, text string")
    out = C.entity_candidates(docs)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "Order", "inline", 2, 1), (1, "Client", "noun", 5, 5), (None, "Zed", "noun", 3, 0)], key=str)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
