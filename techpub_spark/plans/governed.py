"""Governance, identity, graph, chunking and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_quote
from ..operators import answer, chunking, governance, graph, identity, lexical
from ..session import read_table
from ..streaming import streams
from .catalog import register

LABEL = "'0' || (doc_id % 7)"


@register("clearance_partition", f"SELECT doc_id, CASE WHEN {LABEL} NOT IN ('01','02','03','04','05') THEN 'unknown label' WHEN {LABEL} > '03' THEN 'above clearance' ELSE 'admitted' END AS verdict FROM documents")
def clearance_partition(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("0"), (F.col("doc_id") % 7).cast("string")).alias("cls"))
    ok, no = governance.partition(d, "cls", "03")
    return ok.select("doc_id", F.lit("admitted").alias("verdict")).unionByName(no.select("doc_id", F.col("reason").alias("verdict")))


@register("applicability_filter", "SELECT doc_id FROM documents WHERE 40 BETWEEN doc_id % 50 AND doc_id % 50 + 10 OR doc_id % 100 = 40 OR doc_id % 5 = 0")
def applicability_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    values = F.concat((d % 50).cast("string"), F.lit("~"), (d % 50 + 10).cast("string"), F.lit(", "), (d % 100).cast("string"))
    asserts = F.when(d % 5 != 0, F.array(F.struct(F.lit("serial").alias("property_ident"), values.alias("values"))))
    return read_table(spark, sf, "documents").where(governance.applies(asserts, {"serial": "40"})).select("doc_id")


@register("gaps_antijoin", """
WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS package, o_orderpriority = '1-URGENT' AS adm FROM orders),
a AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), own AS (SELECT c_custkey % 3 AS package, c_custkey FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, o_custkey, CASE WHEN adm THEN 'declared, admitted' ELSE 'declared, before admission' END AS kind FROM d
WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.package = d.package AND own.c_custkey = d.o_custkey) AND NOT (adm AND o_custkey IN (SELECT c_custkey FROM a))
""")
def gaps_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer").select(F.col("c_custkey").alias("dmc"))
    declared = o.select("o_orderkey", (F.col("o_orderkey") % 3).alias("package"), F.col("o_custkey").alias("dmc"), (F.col("o_orderpriority") == "1-URGENT").alias("owner_admitted"))
    own = c.where("dmc % 2 = 0").select((F.col("dmc") % 3).alias("package"), "dmc")
    return governance.gaps(declared, own, c.where("dmc % 3 <> 0")).select("o_orderkey", F.col("dmc").alias("o_custkey"), "kind")


@register("dangling_refs", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(read_table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@register("issue_mismatch", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) <> year(o_orderdate)")
def issue_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    li, o = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where(F.year("l_shipdate") != F.year("o_orderdate")).select("l_orderkey", "l_linenumber")


@register("citation_status", """
WITH r AS (SELECT o_custkey AS dmc, arg_max(o_orderstatus, o_orderkey) AS registered FROM orders GROUP BY 1)
SELECT c_custkey AS dmc, registered, CASE WHEN registered IS NULL THEN 'unregistered' WHEN issue IS NULL THEN 'unknown' WHEN issue = registered THEN 'current' ELSE 'superseded' END AS status
FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS issue FROM customer) LEFT JOIN r ON dmc = c_custkey
""")
def citation_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    cited = read_table(spark, sf, "customer").select(k.alias("dmc"), F.when(k % 9 == 0, F.lit(None)).when(k % 2 == 0, "O").otherwise("F").alias("issue"))
    reg = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("dmc"), F.col("o_orderstatus").alias("issue"), F.col("o_orderkey").alias("seq"))
    return governance.citation_status(cited, reg).drop("issue")


@register("owner_routing", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lpad((doc_id % 30)::VARCHAR, 2, '0') END AS system FROM documents)
SELECT doc_id, system, CASE WHEN system < '20' THEN 'team' || (system::INT % 3) END AS owner,
       CASE WHEN system < '20' THEN NULL WHEN system IS NULL THEN 'no system in code' ELSE 'system has no owner' END AS owner_reason FROM s
""")
def owner_routing(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    code = F.concat(F.lit("DMC-LA-A-"), F.when(d % 10 == 0, "XX").otherwise(F.lpad((d % 30).cast("string"), 2, "0")), F.lit("-00-00"))
    owners = spark.range(20).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("system"), F.concat(F.lit("team"), (F.col("id") % 3).cast("string")).alias("owner"))
    return governance.with_owner(read_table(spark, sf, "documents").select("doc_id", code.alias("dmc")), owners).select("doc_id", "system", "owner", "owner_reason")


@register("dedup_md5", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_md5(spark: SparkSession, sf: str) -> DataFrame:
    return identity.first_copies(read_table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("digest0")), F.col("digest0"), "doc_id").select("digest", "doc_id")


@register("duplicate_issue", """
WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority[1:1] AS issue FROM orders),
y AS (SELECT *, lag(issue) OVER (PARTITION BY o_custkey ORDER BY issue::INT, o_orderkey) AS previous FROM x)
SELECT o_custkey, issue, o_orderkey, 'XREF-006' AS verdict FROM y WHERE previous = issue
UNION ALL SELECT o_custkey, max(issue), max(o_orderkey) FILTER (issue = top), 'XREF-007' FROM (SELECT *, max(issue) OVER (PARTITION BY o_custkey) AS top FROM x) GROUP BY o_custkey HAVING min(issue) < max(issue)
""")
def duplicate_issue(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("issue"))
    return identity.duplicate_issues(rows, "o_custkey", "issue", "o_orderkey")


@register("conflict_check", "SELECT l_orderkey, l_linestatus, count(DISTINCT l_suppkey) AS n_ids, min(l_suppkey) AS first_id FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def conflict_check(spark: SparkSession, sf: str) -> DataFrame:
    return identity.conflicts(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linestatus"], "l_suppkey")


@register("finding_multiset_diff", """
WITH b AS (SELECT quality AS rule, toxic AS line FROM labels), a AS (SELECT toxic AS rule, quality AS line FROM labels)
SELECT rule, line, 'removed' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT rule, line, 'added' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
""")
def finding_multiset_diff(spark: SparkSession, sf: str) -> DataFrame:
    l = read_table(spark, sf, "labels")
    return identity.multiset_diff(l.select(F.col("quality").alias("rule"), F.col("toxic").alias("line")), l.select(F.col("toxic").alias("rule"), F.col("quality").alias("line")))


@register("manifest_compare", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def manifest_compare(spark: SparkSession, sf: str) -> DataFrame:
    return identity.set_compare(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"), "doc_id")


@register("running_cover", "SELECT conv_id, turn, role, CAST(max((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS INTEGER) AS covered FROM conversations")
def running_cover(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.max((F.col("role") == "system").cast("int")).over(w).alias("covered"))


@register("topk_per_group", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 20")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("value").desc_nulls_last(), "event_id")
    return read_table(spark, sf, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("user_id", "event_id", "rank")


EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as nodes of one graph: a supplier's number is a part's number, too."""
    return read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@register("impact_bfs", f"""
WITH RECURSIVE e AS ({EDGES}), b AS (SELECT s_suppkey AS target, s_suppkey AS dmc, 0 AS hops FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT b.target, e.src, b.hops + 1 FROM b JOIN e ON e.dst = b.dmc WHERE b.hops < 2),
m AS (SELECT target, dmc, min(hops) AS hops FROM b GROUP BY ALL HAVING min(hops) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY hops, dmc) AS rn, count(*) OVER (PARTITION BY target) AS n FROM m)
SELECT target, dmc, CAST(hops AS INTEGER) AS hops, n > 1000 AS truncated FROM n WHERE rn <= 1000
""")
def impact_bfs(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on every supplier whose number is divisible by 20, at most two hops away."""
    return graph.impact(_edges(spark, sf), read_table(spark, sf, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("target")), 2)


def _hop_sql(hop: int) -> str:
    """Two passes of a hop: outgoing, then incoming, each over what is not seen yet."""
    out = []
    for name, a, b in (("o", "src", "dst"), ("i", "dst", "src")):
        seen = " UNION ALL ".join(f"SELECT dmc FROM {x}" for x in ["z", *[f"{w}{k}" for k in range(1, hop) for w in "oi"], *([f"o{hop}"] if name == "i" else [])])
        front = "SELECT dmc FROM z" if hop == 1 else f"SELECT dmc FROM o{hop - 1} UNION SELECT dmc FROM i{hop - 1}"
        way = "out" if name == "o" else "in"
        out.append(f"{name}{hop} AS (SELECT n AS dmc, {hop} AS hop, '{way}' AS direction, min(s) AS via FROM (SELECT {a} AS s, {b} AS n, row_number() OVER (PARTITION BY {a} ORDER BY {b}) AS rn FROM e WHERE {a} IN ({front}) AND {b} NOT IN ({seen})) WHERE rn <= 20 GROUP BY n)")
    return ", ".join(out)


@register("neighborhood_bfs", f"""
WITH e AS ({EDGES}), z AS (SELECT s_suppkey AS dmc FROM supplier ORDER BY 1 LIMIT 2), {_hop_sql(1)}, {_hop_sql(2)},
f AS (SELECT *, row_number() OVER (ORDER BY hop, direction = 'in', via, dmc) AS rn, count(*) OVER () AS n FROM (FROM o1 UNION ALL FROM i1 UNION ALL FROM o2 UNION ALL FROM i2))
SELECT dmc, hop, direction, via, n > 100 AS truncated FROM f WHERE rn <= 100
""")
def neighborhood_bfs(spark: SparkSession, sf: str) -> DataFrame:
    seeds = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("dmc")).orderBy("dmc").limit(2)
    return graph.neighbourhood(_edges(spark, sf), seeds, 2)


@register("scc_cycles", f"""
WITH RECURSIVE e AS ({EDGES}), c AS (SELECT * FROM e WHERE src IN (SELECT dst FROM e)), r AS (SELECT src, dst FROM c UNION SELECT r.src, c.dst FROM r JOIN c ON r.dst = c.src),
m AS (SELECT x.src AS node, min(x.dst) AS carrier FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src)
SELECT carrier, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM m GROUP BY carrier
""")
def scc_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cycles(_edges(spark, sf)).select("carrier", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@register("graph_facts", f"""
WITH e AS ({EDGES}), u AS (SELECT DISTINCT l_partkey AS src, 'ICN-' || l_returnflag AS ident FROM lineitem),
n AS (SELECT src AS dmc FROM e UNION SELECT dst FROM e), o AS (SELECT src AS dmc, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS x FROM e GROUP BY 1),
i AS (SELECT dst AS dmc, string_agg(src::VARCHAR, ',' ORDER BY src) AS x FROM e GROUP BY 1), f AS (SELECT src AS dmc, string_agg(ident, ',' ORDER BY ident) AS x FROM u GROUP BY 1)
SELECT dmc, coalesce(o.x, '') AS references, coalesce(i.x, '') AS referenced_by, coalesce(f.x, '') AS icns FROM n LEFT JOIN o USING (dmc) LEFT JOIN i USING (dmc) LEFT JOIN f USING (dmc)
""")
def graph_facts(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    uses = read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.concat(F.lit("ICN-"), "l_returnflag").alias("ident")).distinct()
    nodes = e.select(F.col("src").alias("dmc")).union(e.select("dst")).distinct()
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return graph.facts(nodes, e, uses, nodes).select("dmc", *[told(c) for c in ("references", "referenced_by", "icns")])


@register("recursive_windows", None)
def recursive_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dmc"), "text", F.md5("text").alias("digest"))
    return chunking.recursive_chunks(d)


@register("quote_validation", r"""
WITH q AS (SELECT item_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS quote FROM benchmark),
d AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS body FROM documents)
SELECT item_id, doc_id FROM q JOIN d ON contains(body, quote) WHERE length(quote) >= 12
""")
def quote_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that quote an item; what is too short for a quote is none."""
    return holders(spark, sf, answer.SHORTEST_QUOTE)


def holders(spark: SparkSession, sf: str, shortest: int = 1) -> DataFrame:
    """Documents that hold a whole item of at least ``shortest`` characters, both in the form of quotes."""
    q = read_table(spark, sf, "benchmark").select("item_id", normal_quote(F.col("text")).alias("quote")).where(F.char_length("quote") >= shortest)
    return lexical.holders(q, read_table(spark, sf, "documents").select("doc_id", normal_quote(F.col("text")).alias("body")))


@register("repair_select", """
WITH c AS (SELECT l_orderkey AS finding, CAST(l_linenumber AS INTEGER) AS role_order, l_quantity / 50.0 AS d FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity / 50.0 <= 0.5)
SELECT finding, role_order, round(d, 6) AS deleted FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY d, role_order) AS rn FROM c) WHERE rn = 1
""")
def repair_select(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    cand = li.select(F.col("l_orderkey").alias("finding"), F.col("l_linenumber").cast("int").alias("role_order"), F.array_join(F.array_repeat(F.lit("-x"), F.col("l_quantity").cast("int")), "\n").alias("diff"), F.lit(50).alias("source_lines"), (F.col("l_returnflag") != "R").alias("verified"))
    return answer.select_repair(cand).select("finding", "role_order", F.round("deleted", 6).alias("deleted"))


@register("threshold_refusal", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, max(round(list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))), 6)) AS top1 FROM v q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id GROUP BY 1)
SELECT query_id, top1, top1 < 0.8 AS refused FROM s
""")
def threshold_refusal(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.vector import knn

    v = read_table(spark, sf, "embeddings")
    near = knn(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 2)  # one more than needed: a query finds itself
    return answer.threshold_gate(near.where("id <> query_id"), 0.8)


@register("severity_report", "SELECT o_orderstatus AS package, count(*) FILTER (o_totalprice > 100000) AS errors, count(*) FILTER (o_totalprice <= 100000) AS warnings FROM orders GROUP BY 1")
def severity_report(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.validation import report

    return report(read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("package"), F.when(F.col("o_totalprice") > 100000, "error").otherwise("warning").alias("severity")))


@register("consensus_vote", """
WITH r AS (SELECT user_id AS figure_id, event_type AS signature, event_id AS attempt, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
h AS (SELECT figure_id, arg_min(signature, attempt) AS signature, min(attempt) AS attempt FROM r WHERE n = 3 GROUP BY 1)
SELECT figure_id, signature, attempt FROM (SELECT DISTINCT user_id AS figure_id FROM events) LEFT JOIN h USING (figure_id)
""")
def consensus_vote(spark: SparkSession, sf: str) -> DataFrame:
    return answer.consensus(read_table(spark, sf, "events").select(F.col("user_id").alias("figure_id"), F.col("event_type").alias("signature"), F.col("event_id").alias("attempt")), 3)


@register("stream_extract", None)
def stream_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Answer text of each conversation's JSON reply, folded over its turns in order."""
    c = read_table(spark, sf, "conversations")
    body = c.groupBy("conv_id").agg(F.to_json(F.struct(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), "\n").alias("answer"))).alias("reply"))

    @F.pandas_udf("string")
    def prefix(replies):
        return replies.map(lambda r: streams.answer_prefix(r)[0])

    return body.select("conv_id", F.md5(prefix("reply")).alias("answer_md5"))


@register("extension_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def extension_windows(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(read_table(spark, sf, "events"))


@register("extension_sessions", """
WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS cut FROM events),
s AS (SELECT user_id, ts, sum(coalesce(cut, 0)) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def extension_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(read_table(spark, sf, "events"))
