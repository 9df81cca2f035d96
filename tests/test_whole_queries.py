"""Queries that ask with every item of their table, not with a share of it."""

import pytest
from pyspark.sql import functions as F

from techpub_spark.operators import lexical
from techpub_spark.plans import catalog

DOCS = [(1, "the pump fails at low oil", "en", "a", 25), (2, "check valve seven before the pump", "en", "b", 33), (3, "no such thing", "de", "a", 13), (4, "oil", "de", "b", 3)]
ITEMS = [(1, "the pump fails at low oil"), (2, "check valve seven before the pump"), (20, "no such thing"), (21, "oil"), (22, "¿?")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_rrf_fusion_asks_every_item(spark, tables):
    """Also those whose number 20 does not divide; an item without a token asks nothing, as in the SQL."""
    rows = catalog.queries()["rrf_fusion"](spark, tables).collect()
    assert {r.query_id: r.id for r in rows if r["rank"] == 1} == {1: 1, 2: 2, 20: 3, 21: 4}
    assert "item_id % 20" not in catalog.oracles()["rrf_fusion"] and "item_id % 20" in catalog.oracles()["bm25_topk"]


def test_bm25_runs_and_blocks(spark, monkeypatch):
    """The same ranks whatever a task scores at once and however the queries are cut; of equal texts the smallest ids."""
    docs = spark.range(60).select(F.col("id").cast("string").alias("n"), F.concat_ws(" ", F.lit("oil"), F.when(F.col("id") % 3 == 0, "pump"), F.when(F.col("id") % 7 == 0, "pump valve")).alias("t")).repartition(3)
    asked = spark.createDataFrame([("a", "pump oil"), ("b", "valve"), ("c", "nothing"), ("d", "oil oil valve")], "query_id string, query string")
    whole = lexical.bm25(asked, docs, "n", "t", 5).orderBy("query_id", "rank").collect()
    assert [r.id for r in whole if r.query_id == "b"] == ["14", "28", "35", "49", "56"]
    assert {r.query_id for r in whole} == {"a", "b", "d"}
    for name, size in (("HELD", 1), ("LOOKED_UP", 2), ("BLOCK_TERMS", 2)):
        monkeypatch.setattr(lexical, name, size)
    assert lexical.bm25(asked, docs, "n", "t", 5).orderBy("query_id", "rank").collect() == whole


def test_ablation_asks_every_item(spark, tables):
    """All items that a document holds, short ones too, in every mode."""
    rows = catalog.queries()["ablation_modes"](spark, tables).collect()
    assert len(rows) == 6 and {r.n for r in rows} == {4}
    assert {r["mode"]: r.recall_10 for r in rows}["bm25"] == 1.0


def test_holders_in_blocks(spark, monkeypatch):
    """Short and long items, a text that has an item's words but not the item, equal ids; the same in blocks."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d"), (2, "a b c d"), (3, ""), (4, None), (5, "xa b cy")], "doc_id long, body string")
    items = spark.createDataFrame([("p", "a b c d"), ("q", "a b c"), ("r", "b c d"), ("r", "z b c d"), ("s", "nowhere at all to see")], "item_id string, quote string")
    want = [("p", 1), ("p", 2), ("q", 1), ("q", 2), ("q", 5), ("r", 1), ("r", 2), ("r", 2)]
    assert sorted(tuple(r) for r in lexical.holders(items, docs).collect()) == want
    monkeypatch.setattr(lexical, "LOOKED_UP", 2)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 8)
    assert sorted(tuple(r) for r in lexical.holders(items, docs).collect()) == want
