"""Search, golden anchors, answers, figures, repair and evaluation on small corpora."""

import hashlib

import pytest
from pyspark.sql import functions as F

from techpub_spark.operators import answer, evaluation, figures, search

CHUNK = "chunk_id string, package string, dmc string, dm_title string, chunk_type string, source_path string, strategy string, text string, label string, asserts array<struct<property_ident:string,values:string>>, embedding array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    a = lambda v: [("serial", v)]
    rows = [
        ("c1", "p", "DMC-LX-A", "Pump — Remove the pump", "step", "/dmodule/content/procedure/mainProcedure/proceduralStep[1]", "structure", "remove the hydraulic pump bolts", "01", a("1~50"), [1.0, 0.0]),
        ("c2", "p", "DMC-LX-A", "Pump — Remove the pump", "step", "/dmodule/content/procedure/mainProcedure/proceduralStep[2]", "structure", "drain the reservoir before work", "01", a("60"), [0.8, 0.6]),
        ("c3", "p", "DMC-LX-B", "Valve — Test the valve", "step", "/dmodule/content/description", "structure", "hydraulic valve pressure test", "04", None, [0.0, 1.0]),
        ("c4", "p", "DMC-LX-C", "Seal — Parts", "ipd", "/dmodule/content/illustratedPartsCatalog", "structure", "seal LX-29-4711-9", "01", None, [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "hydraulic pump bolts", [1.0, 0.0]), (2, "order LX-29-4711-9 and remove the pump", [0.6, 0.8])], "query_id int, query string, embedding array<double>")


def test_modes(spark, corpus, asked):
    edges = spark.createDataFrame([("DMC-LX-A", "DMC-LX-B")], "src string, dst string")
    first = {}
    for mode in search.MODES:
        rows = search.search(asked, corpus, 3, mode, edges=edges, clearance="05").orderBy("query_id", "rank").collect()
        assert [r.rank for r in rows if r.query_id == 1] == list(range(1, 1 + sum(r.query_id == 1 for r in rows))), mode
        first[mode] = [next(r.id for r in rows if r.query_id == q) for q in (1, 2)]
    assert all(v[0] == "c1" for v in first.values()) and first["dense"][1] == "c4", first
    with pytest.raises(ValueError, match="unknown mode"):
        search.search(asked, corpus, 3, "magic")
    with pytest.raises(ValueError, match="edges"):
        search.search(asked, corpus, 3, "hybrid-graph", clearance="05")


def test_clearance_and_applicability(spark, corpus, asked):
    low = {r.id for r in search.search(asked, corpus, 10, "hybrid", clearance="01").collect()}
    assert low == {"c1", "c2", "c4"}
    fit = {r.id for r in search.search(asked, corpus, 10, "dense", context={"serial": "40"}, clearance="05").collect()}
    assert fit == {"c1", "c3", "c4"}
    assert {r.id for r in search.search(asked, corpus, 10, "bm25", context={"serial": "60"}, clearance="01").collect()} == {"c2", "c4"}
    with pytest.raises(Exception, match="not in this corpus"):
        search.own_rows(spark.createDataFrame([(1, 1, 0.0, "zz")], "query_id int, rank int, score double, id string"), corpus).count()


NODE = "package string, file string, node_id int, parent_id int, tag string, xpath string, text string, error string"


def test_golden_anchors(spark, corpus):
    base = "/dmodule/content/procedure/mainProcedure/proceduralStep"
    from techpub_spark.sources.xmlnodes import xml_nodes

    doc = "<dmodule><content><procedure><mainProcedure><proceduralStep><para>remove bolts</para> the hydraulic pump</proceduralStep><proceduralStep>drain</proceduralStep></mainProcedure></procedure></content></dmodule>"
    nodes = xml_nodes(spark.createDataFrame([("p", "f", len(doc), bytearray(doc.encode()))], "package string, file string, length long, content binary"))
    dms = spark.createDataFrame([("p", "f", "DMC-LX-A")], "package string, file string, dmc string")
    paths = [base + "[1]", base, base + "[1]/para[1]", "/dmodule/none", "count(//x)"]
    golden = spark.createDataFrame([(1, "bolts", [("DMC-LX-A", x) for x in paths]), (2, "nothing at all", [])], "query_id int, query string, relevant array<struct<dmc:string,source_path:string>>")
    anchors = search.golden_anchors(golden)
    got = search.resolve_anchors(anchors, nodes, dms)
    assert {r.path: r.canonical for r in got.collect()} == {paths[0]: base + "[1]", paths[2]: base + "[1]/para"}
    assert {r.path for r in search.unresolved(anchors, got).collect()} == {paths[1], paths[3], paths[4]}
    marks = {(r.anchor, r.id) for r in search.anchor_chunks(anchors, got, corpus).collect()}
    assert marks == {(0, "c1"), (1, None), (2, "c1"), (3, None), (4, None)}
    with pytest.raises(ValueError, match="without an element"):
        search.run_eval(golden, nodes, dms, {"structure": corpus})
    good = spark.createDataFrame([(1, "pump bolts", [("DMC-LX-A", paths[0])]), (2, "zzz", [])], golden.schema)
    r = search.run_eval(good, nodes, dms, {"structure": corpus}).first()
    assert (r.n, r.recall_1, r.n_unmapped, r.n_no_answer, r.zero_hit_rate) == (1, 1.0, 0, 1, 1.0)
    flat = corpus.withColumn("strategy", F.lit("recursive"))
    assert {(r.anchor, r.id) for r in search.anchor_chunks(anchors, got, flat).collect()} >= {(0, "c1"), (2, "c1")}


def test_corpus_build(spark, corpus):
    both = corpus.unionByName(corpus.withColumn("package", F.lit("a")))
    assert {r.package for r in search.build_corpus(both).collect()} == {"a"}
    with pytest.raises(Exception, match="two texts"):
        search.build_corpus(corpus.unionByName(corpus.withColumn("text", F.lit("x")))).count()
    from techpub_spark.sources.store import manifest

    kept = manifest(corpus, "structure", "hash")
    assert search.verify_corpus(corpus, kept, "structure", "hash").count() == 4
    with pytest.raises(ValueError, match="not of this corpus"):
        search.verify_corpus(corpus.where("chunk_id <> 'c1'"), kept, "structure", "hash")


def test_answer_questions(spark):
    ev = [(q, 1, f"e{q}", 0.9 if q != 2 else 0.1, "Tighten the bolt to 25 Nm", "D", "/x", "figure" if q == 6 else "step", ["ICN-A1"]) for q in range(1, 8)]
    evidence = spark.createDataFrame(ev, "query_id int, rank int, id string, score double, text string, dmc string, source_path string, chunk_type string, icn_refs array<string>")
    questions = spark.createDataFrame([(q, f"question {q}") for q in range(1, 9)], "query_id int, question string")

    def model(prompt):
        import json

        q = prompt.split("question ")[1][0]
        good = {"answerable": True, "answer": "25 Nm", "citations": [{"chunk_id": f"e{q}", "quote": "tighten the bolt"}]}
        return {"1": json.dumps(good), "3": "no json", "4": '{"answerable": false}', "5": json.dumps(good | {"citations": []}),
                "6": json.dumps(good | {"answer": "30 mm"}), "7": json.dumps(good | {"citations": [{"chunk_id": "e7", "quote": "loosen every bolt"}]})}.get(q, "boom")

    got = {r.query_id: r for r in answer.answer_questions(questions, evidence, model, 0.5).collect()}
    assert {q: r.gate for q, r in got.items()} == {1: None, 2: "threshold", 3: "llm-contract", 4: "llm", 5: "citation-validation", 6: "figure-out-of-description", 7: "citation-validation", 8: "threshold"}
    assert got[7].detail == "quote not in chunk" and got[6].detail == "not in the figures: 30 mm, mm" and got[1].detail is None
    from techpub_spark.operators import governance

    gaps_ = spark.createDataFrame([], "signature string, kind string, owner string, owner_reason string")
    routed = governance.route_refusals(questions.join(spark.createDataFrame([(q, r.gate) for q, r in got.items() if r.gate], "query_id int, gate string"), "query_id"), gaps_).collect()
    assert len(routed) == 7 and {r.resolution for r in routed} <= set(governance.RESOLUTIONS.values())
    assert got[1].answer == "25 Nm" and got[1].citations[0].id == "e1" and all(got[q].answer is None for q in got if q != 1)


def test_figures(spark):
    spots = [("2", "Bolt", "LX-2-9"), ("1", "Pump", "")]
    hot = spark.createDataFrame([("p", "D", "ICN-AB1", sorted(spots))], "package string, dmc string, icn string, hotspots array<struct<id:string,label:string,part:string>>")
    files = spark.createDataFrame([("p", "icn", "ICN-AB1.png", 3, b"abc"), ("p", "icn", "../x.png", 3, b"abc"), ("p", "up", "ICN-AB2.png", 3, b"abc"), ("p", "icn", "ICN-AB3.png", 5_000_000, b"abc")], "package string, folder string, name string, length int, content binary")
    pics = figures.images(files)
    assert [r.icn for r in pics.collect()] == ["ICN-AB1"]
    sha, lines = hashlib.sha256(b"abc").hexdigest(), ["1|Pump|", "2|Bolt|LX-2-9"]
    kinds = "dmc string, icn string, sha256 string, declared_hotspots array<string>, described_hotspots array<string>, declared_map array<string>, verified boolean"
    ok = ("D", "ICN-AB1", sha, ["1", "2"], ["1", "2"], lines, True)
    for k, v, n in ((2, "0", 0), (4, ["1"], 0), (5, ["1|Pump|"], 0), (6, False, 0), (0, "D", 1)):
        rec = spark.createDataFrame([tuple(v if i == k else x for i, x in enumerate(ok))], kinds)
        rows = figures.figure_chunks(rec, hot, pics).collect()
        assert len(rows) == n
    assert rows[0].text == "Figure ICN-AB1.\nHotspot 1: Pump.\nHotspot 2: Bolt — part LX-2-9." and rows[0].source_path == "figure/ICN-AB1"
    ref = lambda q: spark.range(1).select(figures.figure_ref(F.lit("figure"), F.lit("ICN-A"), F.lit(q)).alias("x")).first().x
    assert (ref("see hotspot 4"), ref("Hotspot 1 and Hotspot 2")) == ("[ICN-A, Hotspot 4]", "[ICN-A]")
    tokens = spark.range(1).select(figures.read_tokens(F.array(F.lit("(LX-1-2), A-10. 'x'"))).alias("x")).first().x
    assert sorted(tokens) == ["A-10", "LX-1-2", "x"]


def test_figure_claims(spark):
    text = "Figure ICN-AB1.\nHotspot 1: Pump — part LX-2-9. 25\n mm"
    for said, want in (
        ("Three hotspots are called out: the pump, part LX-2-9, 25 mm", []), ("the blue pump", ["blue"]), ("a steel bolt, LX-2-8", ["LX-2-8", "bolt", "steel"]), ("pump 30 mm", ["30 mm"]), ("", []),
    ):
        got = spark.range(1).select(F.array_sort(answer.figure_claims(F.lit(said), F.lit(text + " called out"))).alias("x")).first().x
        assert got == want, said


def test_figure_gates(spark):
    import json

    evidence = spark.createDataFrame([(q, 1, f"e{q}", 0.9, "Hotspot 1: Pump", "D", "/x", "figure", ["ICN-A1"]) for q in (1, 2, 3)], "query_id int, rank int, id string, score double, text string, dmc string, source_path string, chunk_type string, icn_refs array<string>")
    questions = spark.createDataFrame([(q, f"question {q}") for q in (1, 2, 3)], "query_id int, question string")
    replies = {"1": {"answerable": False}, "2": {"answerable": True, "answer": "pump", "citations": []}, "3": {"answerable": True, "answer": "the blue pump", "citations": [{"chunk_id": "e3", "quote": "Hotspot 1: Pump"}]}}
    got = {r.query_id: r for r in answer.answer_questions(questions, evidence, lambda p: json.dumps(replies[p.split("question ")[1][0]]), 0.5).collect()}
    assert {r.gate for r in got.values()} == {"figure-out-of-description"} and got[3].detail == "not in the figures: blue"


def test_figure_records(spark, tmp_path):
    from techpub_spark.sources import jsonl

    one = ("ICN-AB1", "D", "x.png", "ab" * 32, ["1"], ["1"], ["LX-2-9"], ["1|Pump|LX-2-9"], "s", [], True, True, True, "")
    rows = spark.createDataFrame([one, ("ICN-AB/2", *one[1:])], jsonl.FIGURE)
    path = str(tmp_path / "f")
    jsonl.write_figures(rows, path)
    jsonl.write_figures(rows.where("icn_id = 'ICN-AB1'").withColumn("summary", F.lit("new")), path)
    got = {r.icn_id: r for r in jsonl.figures(spark, path).collect()}
    assert got["ICN-AB1"].summary == "new" and got["ICN-AB/2"][1:] == one[1:] and len(got) == 2
    hot = spark.createDataFrame([("p", "D", "ICN-AB1", [("1", "Pump", "LX-2-9")])], "package string, dmc string, icn string, hotspots array<struct<id:string,label:string,part:string>>")
    pics = spark.createDataFrame([("p", "ICN-AB1", "ab" * 32)], "package string, icn string, sha256 string")
    assert figures.figure_chunks(jsonl.figures(spark, path), hot, pics).first().text.startswith("Figure ICN-AB1.")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"icn_id": "ICN-AB1", "extra": 1}')
    with pytest.raises(ValueError, match="extra"):
        jsonl.figures(spark, str(tmp_path / "bad"))
    (tmp_path / "bad" / "x.json").write_text('{"icn_id": "ICN-AB1"}')
    with pytest.raises(Exception, match="lacks source_dm"):
        jsonl.figures(spark, str(tmp_path / "bad")).collect()


def test_balanced_objects(spark):
    from techpub_spark.functions.text import balanced_objects

    for said, want in (
        ('a {"x": {"y": 1}} b {}', ['{"x": {"y": 1}}', "{}"]), ('{"x": "}"} }{', ['{"x": "}"}']), (r'{"x": "\"}"}', [r'{"x": "\"}"}']), (r'"{" {"a": "\\"}', [r'{"a": "\\"}']), ("é{é}😀{}", ["{é}", "{}"]), ("", []), ("{{", []), ('" {}', []),
    ):
        assert spark.range(1).select(balanced_objects(F.lit(said)).alias("x")).first().x == want, said


def test_last_verdict_with_its_nonce(spark):
    echo = '{"nonce": "n1", "verdict": "grounded|hallucinated"}'
    real = '{"nonce": "n1", "verdict": "hallucinated", "claims": [{"supported": {"supported": true}}, {"supported": true}, 7], "groundedness": true}'
    for said, want in (
        (f"I say {echo} then {real} done {{}}", ("hallucinated", 0.5, 1, 2)), (real.replace("n1", "n2"), None), (real + real.replace("n1", "n2"), ("hallucinated", 0.5, 1, 2)), (real + '{"nonce": "n1", "verdict": "grounded"}', ("grounded", None, 0, 0)),
        (echo, None), ('{"nonce": "n1", "verdict": "grounded", "claims": "x", "groundedness": 1}', ("grounded", 1.0, 0, 0)), (None, None), ("{broken " + real, None),
    ):
        got = spark.createDataFrame([(said,)], "r string").select(evaluation.verdict(F.col("r"), F.lit("n1")).alias("v")).first().v
        assert (got and tuple(got)) == want, said


def test_repair_report(spark):
    rows = spark.createDataFrame([(s,) for s in ("patched", "applied", "declined", "dry-run-only", "refused", "budget-exhausted")], "status string")
    assert tuple(evaluation.repair_report(rows).first()) == (2, 1, 2, False) and evaluation.repair_report(rows.limit(0)).first().all_resolved


def test_verdicts(spark):
    said = ['{"verdict": "grounded", "claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": "true"}]}', '{"verdict": "grounded", "groundedness": 0.25}', '{"verdict": "hallucinated", "groundedness": "1"}', '{"verdict": "yes"}', "no"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, r string").select("i", evaluation.verdict(F.col("r")).alias("v")).orderBy("i")
    assert [r.v and (r.v.verdict, r.v.groundedness, r.v.supported) for r in df.collect()] == [("grounded", 0.5, 1), ("grounded", 0.25, 0), ("hallucinated", None, 0), None, None]


def test_evaluation_vectors(spark):
    runs = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", False), (2, "b", False)], "run int, case_id string, passed boolean")
    rates, failed = evaluation.repeat_stats(runs)
    assert {r.run: (r.pass_rate, r.mean_pass_rate) for r in rates.collect()} == {1: (0.5, 0.25), 2: (0.0, 0.25)} and [(r.case_id, r.failures) for r in failed.collect()] == [("b", 2), ("a", 1)]
    golden = spark.createDataFrame([(i, [] if i % 4 == 0 else ["x"]) for i in range(100)], "query_id int, relevant array<string>")
    got = evaluation.sample(golden, 20, 42).collect()
    assert (len(got), sum(not r.relevant for r in got)) == (20, 4) and {r.query_id for r in got} == {r.query_id for r in evaluation.sample(golden, 20, 42).collect()}
    cases = spark.createDataFrame([(1, "refuse", True, "", [], False, [], None, []), (2, "present_both_or_refuse", False, "A-1 and A-2", [], False, ["a-1", "A-2"], None, []), (3, "answer_in_figure", False, "red", ["blue", "red"], True, [], "[ICN]", ["[ICN]"]), (4, "answer_in_figure", False, "red", ["red"], False, [], "[ICN]", [])],
                                  "i int, e string, r boolean, a string, c array<string>, y boolean, p array<string>, f string, z array<string>")
    passed = evaluation.figure_case_passed(*[F.col(c) for c in "eracypfz"])
    assert [r.x for r in cases.orderBy("i").select(passed.alias("x")).collect()] == [True, True, True, False]
    assert sorted(r.shard for r in evaluation.shards(spark.range(5), 3, "id").collect()) == [0, 0, 1, 1, 2]


def test_embedding_counts_words_once(spark, monkeypatch):
    """A text's places are computed once, not once for each of its 64 counts."""
    from techpub_spark.plans import retrieval

    rows = spark.createDataFrame([("a b a",), ("",), (None,), (" ".join(["w"] * 30000),)], "t string").select("t", retrieval._hashed(F.col("t")).alias("e"))
    got = {r.t: r.e for r in rows.collect()}
    assert sorted(x for x in got["a b a"] if x) in ([1.0, 2.0], [3.0]) and sum(got[""]) == sum(got[None]) == 0 and max(got[" ".join(["w"] * 30000)]) == 30000
    assert all(len(e) == 64 for e in got.values()) and "sequence" not in rows._jdf.queryExecution().optimizedPlan().toString()
