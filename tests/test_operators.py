"""Hand-worked vectors of the library's own operators."""

import pytest
from pyspark.sql import functions as F

from techpub_spark.functions import text
from techpub_spark.operators import answer, chunking, fusion, governance, graph, metrics
from techpub_spark.streaming.streams import answer_prefix


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_tokenize_keeps_identifiers(spark):
    got = one(spark, text.tokenize(F.lit("Set P/N LA-100-B, by-pass valve_2; über a/b")))
    assert got == ["set", "p", "n", "la-100-b", "by", "pass", "valve_2", "ber", "a", "b"]


def test_rrf_vector(spark):
    arms = [spark.createDataFrame([(1, r + 1, c) for r, c in enumerate(s)], "query_id int, rank int, id string") for s in ("xyz", "yzx")]
    assert [r.id for r in fusion.rrf(arms).orderBy("rank").collect()] == ["y", "x", "z"]


def test_metrics_vectors(spark):
    ranked = spark.createDataFrame([(1, 3, "c"), (2, 1, "a")], "query_id int, rank int, id string")
    anchors = spark.createDataFrame([(1, "A", "c"), (2, "A", "a"), (2, "B", None)], "query_id int, anchor string, id string")
    got = {r.query_id: r for r in metrics.per_query(ranked, anchors).collect()}
    assert (got[1].recall_1, got[1].recall_5, round(got[1].rr, 4)) == (0, 1, 0.3333)
    assert got[2].recall_5 == 0.5


def test_applicability(spark):
    m = lambda q, v: one(spark, governance.value_matches(F.lit(q), F.lit(v)))
    assert m("7", "0001~0050") and not m("A2", "A10~A20") and m("b", "a, b") and not m("c", "a, b")


def test_clearance_fails_closed(spark):
    df = spark.createDataFrame([("01",), ("05",), (None,), ("9",)], "cls string")
    ok, no = governance.partition(df, "cls", "02")
    assert ok.count() == 1 and no.count() == 3
    with pytest.raises(ValueError):
        governance.normal_clearance("7")
    with pytest.raises(Exception, match="withheld"):
        governance.assert_admissible(df, "cls", "02").count()


def test_affirmed(spark):
    a = lambda t: one(spark, text.affirmed(F.lit(t), F.lit("30 Nm")))
    assert not a("25 Nm, not 30 Nm") and a("not 25 Nm; it is 30 Nm")


@pytest.mark.parametrize("edges,want", [([(1, 2), (2, 3)], []), ([(1, 2), (2, 1)], [[1, 2]]), ([(4, 4)], [[4]]), ([(1, 2), (2, 3), (3, 1), (3, 9)], [[1, 2, 3]])])
def test_cycles(spark, edges, want):
    df = spark.createDataFrame(edges, "src int, dst int")
    assert sorted(r.members for r in graph.cycles(df).collect()) == want


def test_impact_and_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b"), ("c", "a")], "src string, dst string")
    got = {(r.dmc, r.hops) for r in graph.impact(e, spark.createDataFrame([("b",)], "target string"), 5).collect()}
    assert got == {("a", 1), ("d", 1), ("c", 2)}
    near = [(r.dmc, r.hop, r.direction) for r in graph.neighbourhood(e, spark.createDataFrame([("b",)], "dmc string"), 1).collect()]
    assert near == [("c", 1, "out"), ("a", 1, "in"), ("d", 1, "in")]


def test_windows(spark):
    got = one(spark, chunking.windows(F.lit("aa bb cc dd ee"), 8, 3))
    assert got == ["aa bb cc", "cc dd ee"]


def test_kappa_single_class(spark):
    r = metrics.kappa(spark.createDataFrame([(1, 1), (1, 0)], "a int, b int"), "a", "b").first()
    assert r.kappa is None and r.agreement == 0.5


def test_citation_gate(spark):
    replies = spark.createDataFrame([(1, '{"answerable": true, "answer": "x", "citations": [{"chunk_id": "a", "quote": "tighten the bolt"}, {"chunk_id": "b", "quote": "short"}, {"chunk_id": "z", "quote": "tighten the bolt"}]}')], "query_id int, r string").select("query_id", F.from_json("r", answer.REPLY).alias("reply"))
    ev = spark.createDataFrame([(1, "a", "Tighten  the BOLT now"), (1, "b", "other text")], "query_id int, id string, text string")
    assert [r.reason for r in answer.citation_gate(replies, ev).orderBy("pos").collect()] == [None, "quote too short", "not retrieved"]


def test_answer_prefix_at_every_cut():
    full = '<think>no {"answer": "bad"}</think>{"x": 1, "answer": "a\\n\\"q\\" \\ud83d\\ude00 end", "y": 2}'
    last = ""
    for n in range(len(full) + 1):
        got, done = answer_prefix(full[:n])
        assert got.startswith(last)
        last = got
    assert last == 'a\n"q" \U0001f600 end' and done


def test_package_validation(spark, tmp_path):
    from techpub_spark.operators.validation import presence_findings, validate
    from techpub_spark.sources.xmlnodes import package_files, xml_nodes

    code = 'modelIdentCode="LX" systemDiffCode="A" systemCode="29" subSystemCode="1" subSubSystemCode="0" assyCode="00" disassyCode="00" disassyCodeVariant="A" infoCode="520" infoCodeVariant="A" itemLocationCode="{0}"'

    def dm(loc, ref=None, warn=False):
        link = f'<dmRef><dmRefIdent><dmCode {code.format(ref)}/></dmRefIdent></dmRef>' if ref else ""
        w = "<warning>care</warning>" if warn else ""
        return f'<dmodule><identAndStatusSection><dmAddress><dmIdent><dmCode {code.format(loc)}/><issueInfo issueNumber="001" inWork="00"/></dmIdent><dmAddressItems><dmTitle><techName>T</techName></dmTitle></dmAddressItems></dmAddress><dmStatus><applic/></dmStatus></identAndStatusSection><content>{link}<procedure><mainProcedure><proceduralStep>{w}<para>high pressure line</para></proceduralStep></mainProcedure></procedure></content></dmodule>'

    pack = tmp_path / "pkg"
    pack.mkdir()
    for loc, ref, warn in (("A", "B", True), ("B", "A", True), ("C", "Z", False)):
        (pack / f"DMC-LX-A-29-10-00-00A-520A-{loc}_EN.xml").write_text(dm(loc, ref, warn))
    (pack / "DMC-BAD.xml").write_text("<!DOCTYPE x><x/>")
    nodes = xml_nodes(package_files(spark, str(pack)))
    icns = spark.createDataFrame([], "package string, ident string")
    assert sorted(r.rule_id for r in validate(nodes, icns, shape=presence_findings).collect()) == ["BREX-001", "PARSE-001", "XREF-001", "XREF-005"]


@pytest.mark.parametrize("said,want", [
    ("the torque isn't 30 Nm", False), ("it isn’t 30 Nm", False), ("it is wrong to use 30 Nm", False), ("instead of 30 Nm", False), ("25 Nm rather than 30 Nm", False),
    ("not 30 Nm or 30 Nm", False), ("without tools: 30 Nm", True), ("know 30 Nm", True), ("never 25; 30 Nm", True), ("", False),
])
def test_affirmed_negations(spark, said, want):
    assert one(spark, text.affirmed(F.lit(said), F.lit(" 30 NM "))) is want


def test_behaviour(spark):
    rows = [
        ("refuse", "refused", "", [], [], True, None), ("refuse", "answered", "x", [], [], False, "all gates"), ("answer", "refused", "", ["25"], [], False, None),
        ("answer", "answered", "it is 25 Nm", ["25 nm"], [], True, None), ("answer", "answered", "it is 30 Nm", ["25 Nm"], [], False, None), ("answer", "answered", "25 Nm; 30 Nm too", ["25 Nm"], ["30 Nm"], False, None),
        ("clarify", "answered", "25 Nm, not 30 Nm", ["25 Nm"], ["30 Nm"], True, None), ("clarify", "answered", "25 Nm; also 30 Nm", ["25 Nm"], ["30 Nm"], False, "all gates"), ("clarify", "refused", None, None, None, True, None),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "id int, expected string, outcome string, answer string, must_state array<string>, must_not_state array<string>")
    assert [(r.passed, r.slipped) for r in answer.behaviour(df).orderBy("id").collect()] == [r[5:] for r in rows]


@pytest.mark.parametrize("raw,want", [
    (r"a\uZZZZb", "a�b"), (r"x\ude00y", "x�y"), (r"x\ud83dyyyyyyy", "x�yyyyyyy"), (r"\ud83dA.", "�A."), (r"\ud83d\uXXXX.", "�."),
    (r"a <think>b</think> c", "a <think>b</think> c"), (r"\q\/\t", "q/\t"), ("line\nbreak", "line\nbreak"),
])
def test_answer_prefix_odd_escapes(raw, want):
    full = '  <think>"answer": "no"</think>\n{"answer" : "' + raw + '", "z": 1}'
    assert answer_prefix(full) == (want, True)
    parts = [answer_prefix(full[:n])[0] for n in range(len(full) + 1)]
    assert all(b.startswith(a) for a, b in zip(parts, parts[1:]))
    want.encode()


def test_duplicate_issues(spark):
    from techpub_spark.operators import identity

    rows = [("a", "001", "f1"), ("a", "001", "f2"), ("a", "002", "f3"), ("a", "x", "f0"), ("b", "003", "g1"), ("b", "003", "g2"), ("c", "001", "h1")]
    got = identity.duplicate_issues(spark.createDataFrame(rows, "dmc string, issue string, file string"), "dmc", "issue", "file")
    assert sorted((r.dmc, r.file, r.verdict) for r in got.collect()) == [("a", "f2", "XREF-006"), ("a", "f3", "XREF-007"), ("b", "g2", "XREF-006")]


def test_verify_sets(spark):
    from techpub_spark.operators import identity

    a, b = spark.range(5), spark.range(5)
    assert identity.verify_sets(a, b, "id").count() == 5
    with pytest.raises(Exception, match="left:4"):
        identity.verify_sets(a, spark.range(4), "id").count()


def test_cycles_against_closure(spark):
    import random

    rng = random.Random(2)
    for n, m in ((12, 18), (20, 40), (8, 8)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = set(edges)
        while len(more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) > len(reach):
            reach = more
        want = {tuple(sorted(y for y in range(n) if (x, y) in reach and (y, x) in reach)) for x in range(n) if (x, x) in reach}
        got = graph.cycles(spark.createDataFrame(sorted(edges), "src int, dst int")).collect()
        assert {tuple(r.members) for r in got} == want and all(r.carrier == r.members[0] for r in got)


def test_gaps_look_in_their_own_package(spark):
    declared = spark.createDataFrame([("p", True, "A"), ("p", True, "B"), ("r", False, "A"), ("r", False, "C")], "package string, owner_admitted boolean, dmc string")
    own = spark.createDataFrame([("q", "A"), ("q", "C"), ("r", "C")], "package string, dmc string")
    got = governance.gaps(declared, own, own.where("package = 'q'").select("dmc"))
    assert sorted((r.package, r.dmc, r.kind) for r in got.collect()) == [("p", "B", "declared, admitted"), ("r", "A", "declared, before admission")]


def test_entity_links(spark):
    from techpub_spark.operators import entity

    chunks = spark.createDataFrame([
        ("DMC-LX-A-29-10-00-00A-520A-A", "step", "Pump — Remove the pump", "x"), ("DMC-LX-B-29-10-00-00A-520A-A", "ipd", "Pump — Parts", "fits LX-29-4711-9 and AB-1 or TOOLONG-1-2"),
    ], "dmc string, chunk_type string, dm_title string, text string")
    parts, phrases = entity.part_lexicon(chunks), entity.phrase_lexicon(chunks)
    assert [r.part for r in parts.collect()] == ["LX-29-4711-9"] and [r.phrase for r in phrases.collect()] == ["remove the pump"]
    q = spark.createDataFrame([
        (1, "see dmc-lx-a-29-10-00-00a-520a-a now"), (2, "what is 29-10-00-00A-520A-A"), (3, "order lx-29-4711-9, then remove THE pump!"), (4, "DMC-LX-Z-29-10-00-00A-520A-A"), (5, None),
    ], "query_id int, query string")
    both = ["DMC-LX-A-29-10-00-00A-520A-A", "DMC-LX-B-29-10-00-00A-520A-A"]
    got = [(r.query_id, r.kind, r.surface, r.dmcs) for r in entity.link(q, chunks, parts, phrases).orderBy("query_id", "place").collect()]
    assert got == [(1, "dmc", both[0], [both[0]]), (2, "dmc", "29-10-00-00A-520A-A", both), (3, "part", "LX-29-4711-9", [both[1]]), (3, "task", "remove the pump", [both[0]]), (4, "dmc", "29-10-00-00A-520A-A", both)]


CODE = 'modelIdentCode="LX" systemDiffCode="A" systemCode="29" subSystemCode="1" subSubSystemCode="0" assyCode="00" disassyCode="00" disassyCodeVariant="A" infoCode="520" infoCodeVariant="A" itemLocationCode="{0}"'


def package(spark, folder, files):
    """A package of data modules: location -> (issue, inWork, status, content)."""
    from techpub_spark.sources.xmlnodes import package_files, xml_nodes

    folder.mkdir()
    for name, (loc, issue, work, status, content) in files.items():
        (folder / f"DMC-LX-A-29-10-00-00A-520A-{loc}_{name}.xml").write_text(
            f'<dmodule><identAndStatusSection><dmAddress><dmIdent><dmCode {CODE.format(loc)}/><issueInfo issueNumber="{issue}" inWork="{work}"/></dmIdent>'
            f"<dmAddressItems><dmTitle><techName>T</techName></dmTitle></dmAddressItems></dmAddress><dmStatus><applic/>{status}</dmStatus></identAndStatusSection><content>{content}</content></dmodule>")
    return xml_nodes(package_files(spark, str(folder)))


def test_business_rules(spark, tmp_path):
    from techpub_spark.operators import validation

    def proc(steps, before=""):
        return f"<procedure>{before}<mainProcedure>{steps}</mainProcedure></procedure>"

    hot = "<proceduralStep><para>release the <b>nitrogen</b> PRESSURE</para>{0}</proceduralStep>"
    warn = "<proceduralStep><warning>w</warning><para>x</para></proceduralStep>"
    dates = "<ownExtension><effectiveDate>{0}</effectiveDate><expiryDate>{1}</expiryDate></ownExtension>"
    nodes = package(spark, tmp_path / "p", {
        "1": ("A", "001", "00", "", proc(hot.format(""))),  # uncovered hazard
        "2": ("B", "001", "00", "", proc(warn + hot.format(""))),  # an earlier step warns
        "3": ("C", "001", "00", "", proc(hot.format("") + warn)),  # a later one does not count
        "4": ("D", "001", "00", "", proc(hot.format(""), "<preliminaryRqmts><reqSafety><safetyRqmts><caution>c</caution></safetyRqmts></reqSafety></preliminaryRqmts>")),
        "5": ("E", "001", "00", "", proc("<proceduralStep><para>x</para><proceduralStep><para>voltage</para><warning>w</warning></proceduralStep></proceduralStep>")),
        "6": ("F", "001", "00", "", "<procedure><closeRqmts/></procedure>"),
        "7": ("G", "001", "00", dates.format("2024-02-01", "2024-01-01"), "<description><para>x</para></description>"),
        "8": ("H", "001", "00", dates.format("2024-01-01", "2024-02-01"), "<description><para>x</para></description>"),
        "9": ("H", "001", "01", "", "<description><para>y</para></description>"),
        "10": ("H", "001", "01", "", "<description><para>z</para></description>"),
    })
    icns = spark.createDataFrame([], "package string, ident string")
    got = sorted((r.rule_id, r.file.split("-A_")[0][27:28] or r.file[27:28]) for r in validation.validate(nodes, icns, shape=validation.presence_findings).collect())
    assert got == [("BREX-001", "A"), ("BREX-001", "C"), ("BREX-003", "F"), ("BREX-005", "G"), ("XREF-006", "H"), ("XREF-007", "H")]
    seen = validation.inspect(nodes, icns).first()
    assert (seen.data_modules, seen.unreadable, seen.content_types) == (10, 0, {"description": 4, "procedure": 6})


def test_structure_chunks(spark, tmp_path):
    from techpub_spark.operators import validation

    link = f"<dmRef><dmRefIdent><dmCode {CODE.format('Z')}/></dmRefIdent></dmRef>"
    nodes = package(spark, tmp_path / "p", {
        "1": ("A", "001", "00", "", "<procedure><preliminaryRqmts><reqCondGroup>power off</reqCondGroup><reqSupportEquips>jack</reqSupportEquips><reqSafety><safetyRqmts><warning>hot</warning><caution>wet</caution></safetyRqmts></reqSafety></preliminaryRqmts>"
              f"<mainProcedure><proceduralStep><para>one {link}</para><proceduralStep><para>inner</para></proceduralStep></proceduralStep></mainProcedure><closeRqmts><reqCondGroup>close</reqCondGroup></closeRqmts></procedure>"),
        "2": ("B", "001", "00", "", "<faultIsolation><faultDescription>drips</faultDescription><isolationStep>look</isolationStep></faultIsolation>"),
        "3": ("C", "001", "00", "", "<description><para>flat</para></description>"),
        "4": ("D", "001", "00", "", '<illustratedPartsCatalog><figure><graphic infoEntityIdent="ICN-1"/></figure><item><partRef partNumberValue="LX-2-9"/></item><item>bolt<partRef partNumberValue="LX-1-8"/></item></illustratedPartsCatalog>'),
        "5": ("E", "001", "00", "", "<other>kept</other>"),
    })
    got = chunking.structure_chunks(nodes, validation.data_modules(nodes)).orderBy("file", "seq").collect()
    assert [(r.chunk_type, r.text) for r in got] == [
        ("precondition", "power off"), ("precondition", "jack"), ("warning", "hot"), ("caution", "wet"), ("step", "one inner"), ("step", "inner"), ("closeout", "close"),
        ("fault", "drips"), ("fault", "look"), ("description", "flat"), ("ipd", "bolt LX-2-9 LX-1-8"), ("dm", "kept")]
    assert got[4].dm_refs == ["DMC-LX-A-29-10-00-00A-520A-Z"] and got[5].dm_refs == [] and got[10].icn_refs == ["ICN-1"]
    assert {r.dmc: r.referrers for r in validation.inbound(nodes, validation.data_modules(nodes)).collect()}["DMC-LX-A-29-10-00-00A-520A-A"] == []


def test_route_refusals(spark):
    x, y, z = (f"DMC-LA100-A-{n}-10-00-00A-520A-A" for n in (29, 30, 31))
    asked = [(1, "threshold", "how?"), (2, "llm", f"see {z} then {x.lower()}"), (3, "llm", f"see {y}"), (4, "other", f"see {z}"), (5, "llm", f"{y} and {x}"), (6, "llm", None)]
    questions = spark.createDataFrame(asked, "query_id int, gate string, question string")
    rows = [(x, "declared, admitted", "anna", None), (x, "declared, before admission", "bert", None), (y, "declared, before admission", "bert", None)]
    gaps_ = spark.createDataFrame(rows, "signature string, kind string, owner string, owner_reason string")
    got = {r.query_id: r for r in governance.route_refusals(questions, gaps_).collect()}
    assert len(got) == 6 and [got[k].owner for k in range(1, 7)] == [None, "anna", None, None, "anna", None]
    assert got[2].code == x and got[2].owner_reason is None and got[3].code is None
    assert got[1].owner_reason == got[6].owner_reason == "the question names no module code"
    assert "not admitted" in got[3].owner_reason and got[4].owner_reason.endswith("is not a gap")
    assert got[1].resolution == governance.RESOLUTIONS["threshold"] and got[4].resolution.endswith("other")
    empty = governance.route_refusals(questions, gaps_.limit(0)).collect()
    assert len(empty) == 6 and all(r.owner is None for r in empty)
