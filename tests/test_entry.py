"""The catalogue against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from techpub_spark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["bm25_topk", "knn_cosine", "rrf_fusion", "citation_status", "graph_facts", "quote_validation"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(catalog.oracles()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted(tuple(str(row[rel.columns.index(c)]) for c in cols) for row in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want
