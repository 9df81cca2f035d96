"""Retrieval and evaluation queries over the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, normal_phrase, normal_quote, squeeze, tokenize
from ..operators import entity, evaluation, fusion, graph, lexical, metrics, search, vector
from ..session import read_table
from .catalog import register

TOKENS = """flatten(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+(?:[-/_][A-Za-z0-9]+)*'),
  lambda r: CASE WHEN regexp_matches(r, '[-/_]') AND regexp_matches(r, '[0-9]') THEN [lower(r)] ELSE regexp_split_to_array(lower(r), '[-/_]') END))"""


@register("tokenize_terms", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.vocabulary(read_table(spark, sf, "documents"), "doc_id", "text")
    return words.where("term is not null").select("term", F.col("length").alias("n"), F.col("df").alias("docs"))


BM25_CTES = f"""
q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM df, st),
idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM i0) ELSE i END AS idf FROM i0),
sc AS (SELECT query_id, doc_id AS id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
       FROM tf JOIN qt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id),
bm AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id FROM sc)
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).where("query_id % 20 = 0")


@register("bm25_topk", f"WITH {BM25_CTES} SELECT * FROM bm WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_queries(spark, sf), read_table(spark, sf, "documents"), "doc_id", "text", 10)


KNN = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl,
      round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6) AS score
      FROM v q, v WHERE q.vec_id % 20 = 0 {0}),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score, id, ql, vl FROM s)
"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = read_table(spark, sf, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v


@register("knn_cosine", KNN.format("") + "SELECT query_id, rank, score, id FROM r WHERE rank <= 10")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return vector.knn(*_vectors(spark, sf), k=10)


@register("knn_filtered", KNN.format("AND v.label = 1") + "SELECT query_id, rank, score, id FROM r WHERE rank <= 10")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return vector.knn(*_vectors(spark, sf), k=10, where="label = 1")


@register("rrf_fusion", f"""
WITH {BM25_CTES.replace(' WHERE item_id % 20 = 0', '')},
a AS (SELECT query_id, rank, id FROM bm WHERE rank <= 20),
b AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id) AS INTEGER) AS rank, doc_id AS id
      FROM documents, (SELECT DISTINCT query_id FROM qt)),
u AS (SELECT 0 AS arm, * FROM a UNION ALL SELECT 1, * FROM b WHERE rank <= 20),
f AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 12) AS score, min(arm * 1000 + rank) AS first FROM u GROUP BY query_id, id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS INTEGER) AS rank, score, id, CAST(first // 1000 AS INTEGER) AS arm FROM f
""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = read_table(spark, sf, "documents"), _items(spark, sf).where(F.size(tokenize(F.col("query"))) > 0)
    a = lexical.bm25(q, docs, "doc_id", "text", fusion.ARM_DEPTH)
    # the same short list for every query: rank once, then give it to each
    top = docs.select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(fusion.ARM_DEPTH)
    top = top.select(F.row_number().over(Window.orderBy("n_chars", "doc_id")).alias("rank"), F.col("doc_id").alias("id"))
    b = q.select("query_id").distinct().join(F.broadcast(top))
    return fusion.rrf([a, b])


@register("recall_mrr_ndcg", KNN.format("AND q.vec_id <> v.vec_id") + """,
a AS (SELECT query_id, rank, id FROM r WHERE ql = vl AND rank <= 10),
n AS (SELECT q.vec_id AS query_id, count(v.vec_id) AS total FROM v q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1),
p AS (SELECT n.query_id, total, count(rank) FILTER (rank <= 1) AS c1, count(rank) FILTER (rank <= 5) AS c5, count(rank) AS c10, min(rank) AS first,
      coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM n LEFT JOIN a USING (query_id) GROUP BY n.query_id, total),
i AS (SELECT *, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= total) AS ideal FROM p)
SELECT count(*) AS n, round(avg(c1 / total), 4) AS recall_1, round(avg(c5 / total), 4) AS recall_5, round(avg(c10 / total), 4) AS recall_10,
       round(avg(coalesce(1 / first, 0)), 4) AS mrr, round(avg(dcg / ideal), 4) AS ndcg FROM i
""")
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    q, v = _vectors(spark, sf)
    # one place more than needed, as a query finds itself
    near = vector.knn(q, v, k=11).where("id <> query_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where("rank <= 10")
    # the anchors of a query are the other rows of its label: counted by label, and told by the label of what was found
    own = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").distinct()
    size = v.where("vec_id is not null").groupBy("label").agg(F.count_distinct("vec_id").alias("n"))
    totals = own.join(size, "label").groupBy("query_id").agg(F.sum(F.col("n") - 1).alias("total"))
    of = v.select(F.col("vec_id").alias("id"), "label").distinct().join(ranked.select("query_id", "rank", "id"), "id").join(own, ["query_id", "label"], "left_semi")
    return metrics.summary(metrics.per_query_of_rows(of.select("query_id", "rank", F.lit(True).alias("relevant")), totals))


@register("category_grouping_sets", "SELECT lang, source, count(*) AS n, round(avg(CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS rate FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def category_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("n_chars") > 1000, F.lit(1.0)).otherwise(F.lit(0.0))), 4).alias("rate"))


@register("p50_and_percentile", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[len(list(value)) // 2 + 1], 6) AS p50 FROM events GROUP BY event_type")
def p50_and_percentile(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").where("value is not null")
    # the upper median as a rank of an aggregated histogram: no group is ever gathered in one row
    hist = e.groupBy("event_type", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("event_type").orderBy("value")
    run = hist.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    mid = run.where((F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("n") / 2))).select("event_type", F.round("value", 6).alias("p50"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.95), 6).alias("p95")).join(mid, "event_type")


@register("kappa", "WITH c AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS pa, avg(toxic) AS pb FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT n, round(po, 4) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) AS kappa FROM c")
def kappa(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.kappa(read_table(spark, sf, "labels"), "quality", "toxic")


@register("intersection_vote", """
WITH v AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'hallucinated' ELSE 'grounded' END AS a,
                  CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN doc_id % 4 = 0 THEN 'hallucinated' ELSE 'grounded' END AS b FROM documents)
SELECT round(avg((a = 'grounded')::INT), 4) AS grounded_a, round(avg((b = 'grounded')::INT), 4) AS grounded_b,
       count(*) FILTER (a = 'error') AS errors_a, count(*) FILTER (b = 'error') AS errors_b,
       round(avg((a = 'grounded' AND b = 'grounded')::INT), 4) AS intersection,
       count(*) FILTER (a <> b AND a <> 'error' AND b <> 'error') AS disagreements FROM v
""")
def intersection_vote(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rows = read_table(spark, sf, "documents").select(
        F.when(d % 11 == 0, "error").when(d % 3 == 0, "hallucinated").otherwise("grounded").alias("a"), F.when(d % 13 == 0, "error").when(d % 4 == 0, "hallucinated").otherwise("grounded").alias("b"))
    return metrics.votes(rows, ["a", "b"])


@register("chunk_id_hash", "SELECT doc_id, substr(sha1(concat_ws('|', lang, source, 'structure', md5(text))), 1, 16) AS chunk_id FROM documents")
def chunk_id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", chunk_id(F.col("lang"), F.col("source"), F.lit("structure"), F.md5("text")).alias("chunk_id"))


@register("link_extract", "SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@register("sanitize_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, md5(trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'))) AS phrase, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS quote FROM documents")
def sanitize_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, sf, "documents").select("doc_id", F.md5(squeeze(t)).alias("squeezed"), F.md5(normal_phrase(t)).alias("phrase"), F.md5(normal_quote(t)).alias("quote"))


@register("entity_lexicon", r"""
SELECT part, count(DISTINCT p_brand) AS n_dmcs, min(p_brand) AS first_dmc, max(p_brand) AS last_dmc
FROM (SELECT p_brand, unnest(regexp_extract_all('fits LX-' || p_size || '-' || (p_partkey % 100) || ' or A-1, TOOLONG-1-2', '\b[A-Z]{1,4}(?:-[A-Z0-9]+){2,}\b')) AS part FROM part)
WHERE regexp_matches(part, '[0-9]') AND NOT starts_with(part, 'DMC-') GROUP BY part
""")
def entity_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("fits LX-"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 100).cast("string"), F.lit(" or A-1, TOOLONG-1-2"))
    chunks = read_table(spark, sf, "part").select(F.col("p_brand").alias("dmc"), text.alias("text"), F.lit("ipd").alias("chunk_type"))
    return entity.part_lexicon(chunks).select("part", F.size("dmcs").cast("long").alias("n_dmcs"), F.element_at("dmcs", 1).alias("first_dmc"), F.element_at("dmcs", -1).alias("last_dmc"))


def _hashed(text, size: int = 64):
    """Deterministic stand-in for an embedding: counts of words by hash."""

    def run(places: pa.Array) -> pa.Array:
        n = places.value_lengths().fill_null(0).to_numpy()
        cell = np.repeat(np.arange(len(n)), n) * size + places.flatten().to_numpy()
        count = np.bincount(cell, minlength=len(n) * size).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(count))

    run.__annotations__ = {"places": pa.Array, "return": pa.Array}  # types, not their names
    return F.arrow_udf(run, "array<double>")(F.transform(tokenize(text), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")))


@register("ablation_modes", None)
def ablation_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Every mode on the same queries and anchors: the first half of each benchmark item asks, and the documents that
    hold the whole item are its anchors, so that no arm makes them.  Modules are sources, linked by language."""
    from .governed import holders

    docs = read_table(spark, sf, "documents").where("text is not null")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("DMC-"), "source").alias("dmc"), F.concat("source", F.lit(" "), "lang").alias("dm_title"), F.lit("description").alias("chunk_type"),
        F.col("doc_id").cast("string").alias("source_path"), F.lit("structure").alias("strategy"), "text")
    vectors = docs.select(F.col("doc_id").alias("chunk_id"), _hashed(F.col("text")).alias("embedding"))
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " ")
    q = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), half.alias("query"))
    q = q.withColumn("embedding", _hashed(F.col("query")))
    marks = holders(spark, sf).select(F.col("item_id").alias("query_id"), F.lit(0).alias("anchor"), F.col("doc_id").alias("id"))
    edges = docs.select(F.concat(F.lit("DMC-"), "source").alias("src"), F.concat(F.lit("DMC-"), "lang").alias("dst")).distinct()
    return search.ablation(q, marks, chunks, edges=graph.cut(edges), vectors=graph.cut(vectors))


@register("sample_summary", """
WITH r AS (SELECT quality = 1 AS a, toxic = 1 AS r, doc_id % 3 = 0 AS h FROM labels),
c AS (SELECT count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nt, count(*) FILTER (a AND NOT r) AS ans, count(*) FILTER (a AND NOT r AND h) AS cov, count(*) FILTER (a AND r) AS fr, count(*) FILTER (NOT a AND r) AS tr FROM r)
SELECT n AS n_sampled, na AS n_answerable, nt AS n_traps, round(cov / na, 4) AS answerable_success, round(fr / na, 4) AS false_refusal_rate, round(tr / nt, 4) AS trap_refusal_rate, round(cov / ans, 4) AS coverage_when_answered FROM c
""")
def sample_summary(spark: SparkSession, sf: str) -> DataFrame:
    l = read_table(spark, sf, "labels")
    return evaluation.sample_summary(l.select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 1).alias("refused"), (F.col("doc_id") % 3 == 0).alias("hit")))


@register("refusal_threshold", """
WITH s AS (SELECT o_orderstatus = 'F' AS a, o_totalprice::DOUBLE AS t FROM orders), m AS (SELECT min(t) FILTER (a) AS threshold FROM s)
SELECT threshold, count(*) FILTER (NOT a) AS n_traps, count(*) FILTER (NOT a AND t < threshold) AS traps_below FROM s, m GROUP BY threshold
""")
def refusal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.refusal_threshold(read_table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").alias("answerable"), F.col("o_totalprice").cast("double").alias("top1")))


@register("gate_regressions", """
SELECT l_orderkey AS query_id, max(l_linestatus = 'F') FILTER (l_linenumber = 1) AS before, max(l_linestatus = 'F') FILTER (l_linenumber = 2) AS after,
       coalesce(max(l_linestatus = 'F') FILTER (l_linenumber = 1) AND NOT max(l_linestatus = 'F') FILTER (l_linenumber = 2), false) AS regression
FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1
""")
def gate_regressions(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").where("l_linenumber <= 2")  # two modes
    return evaluation.gate_regressions(li.select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") == 1, "hybrid").otherwise("hybrid-graph").alias("mode"), (F.col("l_linestatus") == "F").alias("refused")))


@register("read_stability", """
WITH p AS (SELECT l_linenumber AS scale, count(*) AS calls, count(*) FILTER (l_returnflag = 'R') AS flaky, count(*) FILTER (l_returnflag = 'A') AS exact FROM lineitem GROUP BY 1),
q AS (SELECT *, round(flaky / calls, 3) AS instability, coalesce(round(exact / nullif(calls - flaky, 0), 3), 0) AS accuracy FROM p)
SELECT scale, calls, flaky, exact, instability, accuracy, CASE WHEN instability <= 0.34 THEN 2 ELSE 3 END AS k,
       row_number() OVER (ORDER BY (accuracy = 1) DESC, CASE WHEN accuracy = 1 THEN scale END, accuracy DESC, scale) = 1 AS chosen FROM q
""")
def read_stability(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("l_returnflag") == "R", "flaky").when(F.col("l_returnflag") == "A", "exact").otherwise("wrong")
    return evaluation.read_stability(read_table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("scale"), outcome.alias("outcome")))


@register("timing_speedup", """
WITH p AS (SELECT l_returnflag AS package, l_linenumber - 1 AS workers, quantile_cont(l_quantity::DOUBLE, 0.5) AS median, min(l_quantity)::DOUBLE AS least, max(l_quantity)::DOUBLE AS most FROM lineitem GROUP BY ALL),
s AS (SELECT p.*, b.median AS serial, p.median AS m FROM p JOIN p b ON p.package = b.package AND b.workers = 0 WHERE p.workers > 0),
v AS (SELECT package, workers, median, least, most, round(serial / m, 3) AS speedup, round(serial / m / least(workers, 4), 3) AS efficiency FROM s)
SELECT *, CASE WHEN max(speedup) OVER (PARTITION BY package) < 1.05 THEN 'no speedup' WHEN speedup = max(speedup) OVER (PARTITION BY package) THEN 'best' ELSE 'slower' END AS verdict FROM v
""")
def timing_speedup(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("package"), (F.col("l_linenumber") - 1).alias("workers"), F.lit(4).alias("shards"), F.col("l_quantity").cast("double").alias("seconds"))
    return evaluation.timing(li).select("package", "workers", "median", "least", "most", "speedup", "efficiency", "verdict")


@register("majority_vote", """
SELECT user_id AS case_id, count(*) FILTER (value > 0.5) AS k, count(*) AS n, count(*) * 7 AS tokens, count(*) FILTER (value > 0.5) * 2 > count(*) AS majority,
       count(*) FILTER (value > 0.5) BETWEEN 1 AND count(*) - 1 AS unstable FROM events GROUP BY 1
""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return evaluation.majority(e.select(F.col("user_id").alias("case_id"), (F.col("value") > 0.5).alias("passed"), F.lit(7).cast("long").alias("tokens")))


@register("repair_report", """
SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS fixed, count(*) FILTER (o_orderstatus = 'O') AS applied, count(*) FILTER (o_orderstatus = 'F') AS refused, count(*) FILTER (o_orderstatus = 'F') = 0 AS all_resolved FROM orders
""")
def repair_report(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "APPLIED").when(F.col("o_orderstatus") == "P", "PATCHED").otherwise("REFUSED")
    return evaluation.repair_report(read_table(spark, sf, "orders").select(status.alias("status")))


@register("repeat_stats", "SELECT doc_id % 10 AS case_id, count(*) AS failures FROM labels WHERE quality = 0 GROUP BY 1")
def repeat_stats(spark: SparkSession, sf: str) -> DataFrame:
    l = read_table(spark, sf, "labels")
    return evaluation.repeat_stats(l.select((F.col("doc_id") % 5).alias("run"), (F.col("doc_id") % 10).alias("case_id"), (F.col("quality") != 0).alias("passed")))[1]


@register("governed_search", f"""
WITH d AS (SELECT * FROM documents WHERE doc_id % 7 BETWEEN 1 AND 3), {BM25_CTES.replace('FROM documents', 'FROM d')} SELECT * FROM bm WHERE rank <= 10
""")
def governed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical search under a clearance: statistics and ranks are those of the admitted corpus."""
    d = read_table(spark, sf, "documents")
    none = F.array().cast("array<string>")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("dmc"), none.alias("icn_refs"), none.alias("dm_refs"), "text", F.concat(F.lit("0"), (F.col("doc_id") % 7).cast("string")).alias("label"))
    return search.search(_queries(spark, sf), chunks, 10, "bm25", clearance="03")
