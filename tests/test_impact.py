"""Impact keeps no more rows of a target than it can report."""

from techpub_spark.operators import graph


def test_impact_is_cut_hop_by_hop(spark, monkeypatch):
    edges = [(f"n{i:03}", "t") for i in range(5)] + [(f"m{i:03}", "n001") for i in range(300)] + [("t", "m000"), ("z", "u")] + [(f"k{i:03}", "m001") for i in range(50)]
    e, t = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("t",), ("u",), ("x",)], "target string")
    sizes, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: [sizes.append(df.groupBy("target").count().agg({"count": "max"}).first()[0]) if "target" in df.columns else None, cut(df)][1])
    got = {tuple(r) for r in graph.impact(e, t, 3, cap=20).collect()}
    want = [("t", f"n{i:03}", 1, True) for i in range(5)] + [("t", f"m{i:03}", 2, True) for i in range(15)] + [("u", "z", 1, False)]
    assert got == set(want) and max(x for x in sizes if x) <= 22
    assert len(graph.impact(e, t, 3, cap=1000).collect()) == 5 + 300 + 50 + 1
