"""Queries by path against a walk of the tree."""

import random
import xml.etree.ElementTree as ET

import pytest

from techpub_spark.operators import graph, paths

DOC = """<r a="0"><s id="1"><t k="x">one</t><t k="y">two <b>bold</b> tail</t></s><s id="2"><t>one</t><u><t k="x"/><s><t>deep</t></s></u></s>
<u n="03">x</u><!-- c --><t k="y">last</t></r>"""


def node_table(spark, docs):
    from techpub_spark.sources.xmlnodes import xml_nodes

    rows = [("p", f, len(d.encode()), bytearray(d.encode())) for f, d in docs.items()]
    return graph.cut(xml_nodes(spark.createDataFrame(rows, "package string, file string, length long, content binary")))


@pytest.fixture(scope="module")
def nodes(spark):
    return node_table(spark, {"a": DOC, "b": "<r><s/></r>", "bad": "<r>"})


def asked(spark, many, file="a"):
    return spark.createDataFrame([("p", file, p) for p in many], "package string, file string, path string")


#: path -> the selected elements' node ids: r0 s1 t2 t3 b4 s5 t6 u7 t8 s9 t10 u11 t12
ELEMENTS = {
    "/r": [0], "/r/s": [1, 5], "/r/s[2]": [5], "/r/s/t": [2, 3, 6], "/r/s/t[1]": [2, 6], "/r/s[last()]/t": [6], "s": [1, 5], "./s": [1, 5], "s/t[last()]": [3, 6],
    "//t": [2, 3, 6, 8, 10, 12], "//t[1]": [2, 6, 8, 10, 12], "//t[2]": [3], "//s//t": [2, 3, 6, 8, 10], "/r//s": [1, 5, 9], "//s[t='deep']": [9], "//*[@k]": [2, 3, 8, 12],
    "//t[@k='y']": [3, 12], "//t[not(@k)]": [6, 10], "//t[@k!='x']": [3, 12], "//t[.='one'][1]": [2, 6], "//t[@k='y' and .='last']": [12], "//u[@n=3]": [11], "//t[text()='two tail']": [3],
    "//b/..": [3], "//b/ancestor::*": [0, 1, 3], "//b/ancestor::*[1]": [3], "//b/ancestor-or-self::b": [4], "//u/preceding-sibling::*": [1, 5, 6], "//u/preceding-sibling::*[1]": [5, 6],
    "//u/following::t": [12], "//u/following-sibling::t": [12], "//b/preceding::*": [2], "//t[contains(., 'o')][2]": [3], "//t[starts-with(@k,'x')]": [2, 8], "//s[u]": [5], "//s[not(u)]": [1, 9],
    "//s[@id='2']/descendant::s/t": [10], "//s/descendant-or-self::s": [1, 5, 9], "/descendant::t[4]": [8], "//u/self::u[last()]": [7, 11], "/r/t[last()-0]": [12], "/r/node()": [1, 5, 11, 12],
    "//nothing": [], "/s": [], "/r/s[9]": [], "//t[position()=2]": [3], '//t[.="a and b"]': [], "//s[t and u]": [5], "/": [], "/r/s/.": [1, 5], "/..": [],
}


def test_elements(spark, nodes):
    good = [p for p in ELEMENTS if p not in ("/", "/..")]
    found, bad = paths.select_nodes(nodes, asked(spark, good))
    got = {}
    for r in found.collect():
        assert r.kind == "element" and r.value is None
        got.setdefault(r.path, []).append(r.node_id)
    assert bad.count() == 0 and {p: sorted(got.get(p, [])) for p in good} == {p: ELEMENTS[p] for p in good}


def test_values_and_errors(spark, nodes):
    found, bad = paths.select_nodes(nodes, asked(spark, ["//s/@id", "//t/attribute::k", "//t/text()", "//s[1]/@none", "count(//t)", "string(//t)", "//x:y", "//t[", "", "1+1", "//t[foo()]", "//t/comment()", "//t[@k='x' or @k='y']", "/r/@a/..", "x" * 2001, "/r/bogus::t", "//t[1 and @k]"]))
    got = {}
    for r in found.collect():
        got.setdefault((r.path, r.kind), []).append((r.node_id, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {
        ("//s/@id", "attribute"): [(1, "1"), (5, "2")], ("//t/attribute::k", "attribute"): [(2, "x"), (3, "y"), (8, "x"), (12, "y")],
        ("//t/text()", "text"): [(2, "one"), (3, "two tail"), (6, "one"), (10, "deep"), (12, "last")],
    }
    assert {r.path[:30] for r in bad.collect()} == {"count(//t)", "string(//t)", "//x:y", "//t[", "", "1+1", "//t[foo()]", "//t/comment()", "//t[@k='x' or @k='y']", "/r/@a/..", "x" * 30, "/r/bogus::t", "//t[1 and @k]"}


def test_against_a_tree_walk(spark):
    r = random.Random(7)

    def tree(depth):
        e = ET.Element(r.choice("abc"))
        if r.random() < 0.4:
            e.set("k", r.choice("xy"))
        if r.random() < 0.5:
            e.text = r.choice(["one", "two"])
        if depth:
            e.extend([tree(depth - 1) for _ in range(r.randrange(4))])
        return e

    roots = {f"f{i}": tree(4) for i in range(6)}
    table = node_table(spark, {f: ET.tostring(e, encoding="unicode") for f, e in roots.items()})
    steps = ["a", "b", "*", "c[1]", "a[2]", "a[@k]", "*[@k='x']", "b[last()]", "*[a]"]
    many = {"." + "".join(r.choice(["/", "//"]) + r.choice(steps) for _ in range(r.randrange(1, 4))) for _ in range(40)}
    wanted = spark.createDataFrame([("p", f, p) for f in roots for p in many], "package string, file string, path string")
    got = {}
    for x in paths.select_nodes(table, wanted)[0].collect():
        got.setdefault((x.file, x.path), set()).add(x.node_id)
    for f, root in roots.items():
        place = {e: i for i, e in enumerate(root.iter())}
        for p in many:
            assert got.get((f, p), set()) == {place[e] for e in root.findall(p)}, (f, p)


def test_tool(spark, nodes):
    rows = [(1, "p", "a", "//t[@k='y']"), (2, "p", "none", "//t"), (3, "p", "a", "count(//t)"), (4, "p", "a", "//zz"), (5, "p", "a", "//s/@id"), (6, "p", "bad", "//r"), (7, "p", "a", None)]
    got = {r.request: r for r in paths.query_xml(nodes, spark.createDataFrame(rows, "request int, package string, file string, path string")).collect()}
    assert len(got) == 7 and got[1].n == 2 and [(m.tag, m.attrs, m.text, m.value) for m in got[1].matches] == [("t", {"k": "y"}, "two", None), ("t", {"k": "y"}, "last", None)]
    assert got[2].error == "no such file" and got[3].error == "not a selector of nodes" and (got[4].error, got[4].n) == (None, 0)
    assert [m.value for m in got[5].matches] == ["1", "2"] and got[6].error.startswith("PARSE-001") and got[7].error


def test_tool_shows_the_first(spark):
    table = node_table(spark, {"w": "<r>" + "<t/>" * 50 + "</r>"})
    got = paths.query_xml(table, spark.createDataFrame([(1, "p", "w", "//t")], "request int, package string, file string, path string")).first()
    assert got.n == 50 and len(got.matches) == paths.MOST_SHOWN


def test_anchors(spark, tmp_path):
    from techpub_spark.operators import search

    table = node_table(spark, {"a": DOC, "b": DOC.replace("last", "newer")})
    dms = spark.createDataFrame([("p", "a", "D"), ("p", "b", "D"), ("p", "b", "E")], "package string, file string, dmc string")
    want = [("D", "/r/t"), ("D", "/r/s"), ("D", "//t[.='last']"), ("D", "//s/@id"), ("E", "/r/t[1]"), ("E", "count(//t)"), ("X", "/r")]
    anchors = spark.createDataFrame(want, "dmc string, path string")
    got = search.resolve_anchors(anchors, table, dms)
    assert sorted(map(tuple, got.collect())) == [("D", "//t[.='last']", "/r/t", "last"), ("D", "/r/t", "/r/t", "newer"), ("E", "/r/t[1]", "/r/t", "newer")]
    assert search.unresolved(anchors, got).count() == 4
