from techpub_spark.llm import warc


def test_archives_are_parsed_once(spark):
    """What the query returns reads captures; no part of it parses an archive again."""
    pages = spark.createDataFrame([(k, f"u{k}", "x" * 1200 if k < 3 else f"page {k}") for k in range(6)], "page_id long, url string, html string")
    got = warc.round_trip(spark, pages)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got.collect()} == {(0, "revisit", 2), (1, "revisit", 2), *[(k, "response", None) for k in range(2, 6)]}
