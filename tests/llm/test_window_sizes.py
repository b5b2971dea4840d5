"""Windows of items give the same hits broadcast or joined by shuffle."""

from quillgrid.llm import winnow


def test_windows_joined_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "x y z"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([("p", "b c d e f g h i j k"), ("q", "x y"), (None, "")], "item_id string, text string")
    got = lambda: sorted(map(tuple, winnow.decontaminate(docs, items).select("doc_id", "n_hit", "items").collect()))
    first = got()
    monkeypatch.setattr(winnow._windows, "__defaults__", (-1,))
    assert got() == first == [(1, 10, ["p"]), (2, 2, ["q"]), (3, 0, [])]
