"""Content models, rules that raise, modules that build no model, and the tables of publications and lists."""

import itertools
import re

import pytest
from test_repair import APPLIC, CODE, LINK, module, name

from techpub_spark.operators import graph, lists, structure, validation
from techpub_spark.sources.xmlnodes import xml_nodes


@pytest.mark.parametrize("line", ["a b? c*", "a+ b", "(a|b)* c+", "a? b? c?", "a b c", "(a|b) a*", "a* b* a?", "(a|b|c)+"])
def test_automaton_against_a_regular_expression(line):
    particles = [(tuple(m[1].strip("()").split("|")), m[2]) for p in line.split() if (m := re.fullmatch(r"(.+?)([?*+]?)", p))]
    moves, final = structure.automaton(particles)
    rule = re.compile("".join(f"(?:{'|'.join(names)}){occurs}" for names, occurs in particles))
    for n in range(5):
        for word in itertools.product("abc", repeat=n):
            state = 0
            for x in word:
                state = moves.get(f"{state} {x}") if state is not None else None
            assert (state in final) == bool(rule.fullmatch("".join(word))), (line, word)


def table(spark, docs):
    rows = [("p", f, len(d.encode()), bytearray(d.encode())) for f, d in docs.items()]
    return graph.cut(xml_nodes(spark.createDataFrame(rows, "package string, file string, length long, content binary")))


STEP = "<proceduralStep><para>x</para></proceduralStep>"
BODIES = {
    "sound": ("<procedure><preliminaryRqmts><reqSafety><safetyRqmts><noSafety/><warning><warningAndCautionPara>w</warningAndCautionPara></warning></safetyRqmts></reqSafety></preliminaryRqmts>"
              f"<mainProcedure>{STEP}{STEP}</mainProcedure><closeRqmts><reqCondGroup/></closeRqmts></procedure><figure><graphic infoEntityIdent='ICN-1'/><hotspot hotspotId='1'>a</hotspot></figure>", []),
    "order": (f"<procedure><closeRqmts><reqCondGroup/></closeRqmts><mainProcedure>{STEP}</mainProcedure></procedure>", ["closeRqmts is not expected; expected: mainProcedure, preliminaryRqmts"]),
    "missing": ("<procedure/>", ["procedure lacks a child; expected: mainProcedure, preliminaryRqmts"]),
    "nested": (f"<procedure><mainProcedure><proceduralStep><para>x</para>{STEP}<strange/></proceduralStep></mainProcedure></procedure>", ["proceduralStep is not expected; expected: para"]),
    "attributes": ("<illustratedPartsCatalog><figure><graphic odd='1'/><hotspot hotspotId='-'/></figure></illustratedPartsCatalog>", ["graphic has no attribute odd", "graphic lacks the attribute infoEntityIdent", "hotspot has a bad hotspotId: -"]),
    "text": ("<description>loose<levelledPara><para>fine</para></levelledPara></description>", ["description holds text"]),
    "two": (f"<procedure><mainProcedure><proceduralStep/>{STEP}<proceduralStep><bad/></proceduralStep></mainProcedure></procedure>", ["bad is not expected; expected: caution, para, warning", "proceduralStep lacks a child; expected: caution, para, warning"]),
    "both kinds": (f"<description><levelledPara><para>x</para></levelledPara></description><procedure><mainProcedure><wrong/></mainProcedure></procedure>", ["procedure is not expected; expected: figure"]),
}


def test_deviations(spark):
    docs = {f"DMC-{k}.xml": module("A", body) for k, (body, _) in BODIES.items()} | {"DMC-root.xml": "<other/>", "DMC-ext.xml": module("B", applic=APPLIC + "<someExtension><expiryDate>2024-01-01</expiryDate></someExtension>")}
    got = {}
    for r in structure.deviations(table(spark, docs)).collect():
        got.setdefault(r.file[4:-4], []).append(r.message)
        assert r.line == 1 and r.path.startswith("/")
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in BODIES.items() if want} | {"root": ["no root that is known: other"]}


def test_line_and_path(spark):
    doc = module("A").replace("<description>", "<description>\n\n<levelledPara><para>y</para></levelledPara>\n<odd/>")
    r = structure.deviations(table(spark, {"DMC-A.xml": doc})).first()
    assert (r.line, r.path) == (4, "/dmodule/content/description/odd")


def test_rules_that_raise(spark):
    bad = name("B")

    def picky(rows):
        if rows[0]["file"] == bad:
            raise KeyError("no such thing")
        return [(rows[0]["line"], f"{len(rows)} nodes")]

    broken = validation.Rule("OWN-2", lambda nodes, _: nodes.select("no_such_column"))
    rules = (*validation.RULES, validation.file_rule("OWN-1", "warning", picky), broken)
    nodes = table(spark, {name("A"): module("A", applic=""), name("B"): module("B"), "DMC-C.xml": module("C").replace("<dmCode", "<noCode"), "DMC-D.xml": module("D", "<wrong/>")})
    got = sorted((r.file, r.rule_id, r.layer) for r in validation.file_findings(nodes, rules=rules).collect())
    assert got == sorted([
        (name("A"), "BREX-004", "L2"), (name("A"), "OWN-1", "L2"), (name("A"), "BREX-999", "L2"), (name("B"), "BREX-999", "L2"), (name("B"), "BREX-999", "L2"),
        ("DMC-C.xml", "SCHEMA-001", "L1"), ("DMC-C.xml", "MODEL-001", "L1"), ("DMC-D.xml", "SCHEMA-001", "L1"),
    ])


def test_publications_and_lists(spark):
    ref = lambda loc, issue="": LINK.format(CODE.format(loc)).replace("</dmRefIdent>", f"{issue}</dmRefIdent>")
    issue = '<issueInfo issueNumber="002" inWork="00"/>'
    pm = (f'<pm><identAndStatusSection><pmAddress><pmIdent><pmCode modelIdentCode="LX" pmIssuer="I" pmNumber="7" pmVolume="00"/><language languageIsoCode="en" countryIsoCode="US"/><issueInfo issueNumber="001" inWork="00"/></pmIdent>'
          f'<pmAddressItems><issueDate year="2024" month="02" day="30"/><pmTitle>Manual</pmTitle></pmAddressItems></pmAddress><pmStatus><security securityClassification="01"/></pmStatus></identAndStatusSection>'
          f"<content><pmEntry><pmEntryTitle>One</pmEntryTitle>{ref('B')}{ref('A')}</pmEntry><pmEntry>{ref('Z', issue)}</pmEntry></content></pm>")
    dml = (f'<dml><identAndStatusSection><dmlAddress><dmlIdent><dmlCode modelIdentCode="LX" senderIdent="S" dmlType="p" yearOfDataIssue="2024" seqNumber="1"/><issueInfo issueNumber="001" inWork="00"/></dmlIdent>'
           f'<dmlAddressItems><issueDate year="2024" month="02" day="29"/></dmlAddressItems></dmlAddress></identAndStatusSection><dmlContent><dmlEntry>{ref("A", issue)}</dmlEntry><dmlEntry>{ref("B")}</dmlEntry></dmlContent></dml>')
    nodes = table(spark, {"PMC-1.xml": pm, "DML-1.xml": dml, name("A"): module("A"), name("B"): module("B", f"<description><levelledPara><para>{ref('A')}</para></levelledPara></description>")})
    assert structure.deviations(nodes).collect() == []
    code = lambda loc: f"DMC-LX-A-29-10-00-00A-520A-{loc}"
    p = lists.publications(nodes).first()
    assert (p.title, p.number, p.issue_number, p.issue_date) == ("Manual", "7", "001", None)
    assert [(r.entry, r.title, r.place, r.dmc, r.issue_number) for r in lists.publication_entries(nodes).orderBy("entry", "place").collect()] == [(1, "One", 1, code("B"), None), (1, "One", 2, code("A"), None), (2, None, 1, code("Z"), "002")]
    d = lists.module_lists(nodes).first()
    assert (d.sender, d.year, str(d.issue_date)) == ("S", "2024", "2024-02-29")
    assert [(r.place, r.dmc, r.issue_number) for r in lists.list_entries(nodes).orderBy("place").collect()] == [(1, code("A"), "002"), (2, code("B"), None)]
    icns = spark.createDataFrame([], "package string, ident string")
    found = validation.validate(nodes, icns)
    asked = spark.createDataFrame([("lx-a-29-10-00-00a-520a-a",), (code("B"),), ("DMC-NONE",)], "asked string")
    got = {r.asked: r for r in lists.lookup(nodes, found, asked).collect()}
    assert got["lx-a-29-10-00-00a-520a-a"].referrers == [code("B")] and got["lx-a-29-10-00-00a-520a-a"].findings == 1 and got["lx-a-29-10-00-00a-520a-a"].file == name("A")
    assert got[code("B")].referrers == [] and got["DMC-NONE"].file is None and got["DMC-NONE"].dmc == "DMC-NONE"
