"""Nearest neighbours in cells of bounded size, and metrics that count anchors instead of listing them."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from techpub_spark.operators import answer, metrics, vector
from techpub_spark.plans import catalog


def brute(queries, rows, k):
    unit = lambda v: (m := np.array(v, float)) / (np.linalg.norm(m) or 1)
    return {(q, i + 1, s, x) for q, v in queries for i, (s, x) in enumerate(sorted(((round(float(unit(v) @ unit(w)), 6), x) for x, w in rows), key=lambda p: (-p[0], p[1]))[:k])}


def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(900)]  # few values: many ties
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    """Several blocks, shares and tiles give the ranks of a full sort; no query passes through the driver."""
    rows, v = vectors(spark)
    for name, size in (("BLOCK_QUERIES", 40), ("TASK_VECTORS", 70)):
        monkeypatch.setattr(vector, name, size)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    q = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for k in (2, 10):
        got = {tuple(r) for r in vector.knn(q, v, k).collect()}
        assert got == brute([r for r in rows if r[0] % 9 == 0], rows, k)
    assert vector.knn(q.limit(0), v, 3).count() == 0 and vector.knn(q, v.limit(0), 3).count() == 0


def test_tiles_in_one_task():
    """A task meets vectors in tiles and holds no more than the best and what waits to be settled."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(3000)]
    import pyarrow as pa

    best = vector._Best(5)
    best.ask(pa.array([r[0] for r in rows[:300]]), pa.array([r[1] for r in rows[:300]], pa.list_(pa.float64())))
    for at in range(0, 3000, 256):
        part = rows[at : at + 256]
        best.meet(np.array([r[0] for r in part]), vector._matrix(pa.array([r[1] for r in part], pa.list_(pa.float64()))))
        assert best.waiting <= 2 * vector.HELD
    best.settle()
    row, score, ids = best.found[0]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    assert {(int(q), int(p) + 1, float(s), int(i)) for q, p, s, i in zip(row, place, score, ids, strict=True)} == brute(rows[:300], rows, 5)


def test_threshold_gate_on_blocks(spark, monkeypatch):
    rows, v = vectors(spark)
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.top1) for r in answer.threshold_gate(vector.knn(q, v, 2).where("id <> query_id"), 0.8).collect()}
    near = {}
    for x, _, s, i in brute([r for r in rows if r[0] % 20 == 0], rows, 2):
        if i != x:
            near[x] = max(s, near.get(x, -9))
    assert got == set(near.items())


def test_anchors_are_counted_not_listed(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (1, 7, 13), (2, 3, 21)], "query_id long, rank int, id long")
    anchors = spark.createDataFrame([(1, 12, 12), (1, 13, 13), (1, 19, 19), (2, 22, 22), (3, 5, 5)], "query_id long, anchor long, id long")
    marked = ranked.join(anchors.select("query_id", "id", F.lit(True).alias("relevant")), ["query_id", "id"], "left").fillna(False)
    totals = anchors.groupBy("query_id").agg(F.count("*").alias("total"))
    assert sorted(metrics.per_query_of_rows(marked, totals).collect()) == sorted(metrics.per_query(ranked, anchors).collect())
    spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.queries()["recall_mrr_ndcg"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "anchor" not in plan and "collect_set" not in plan
