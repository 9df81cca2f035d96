"""Edits that change their own bytes only, verification of many candidates at once, rounds, the apply gate, swaps."""

import hashlib

import pytest

from techpub_spark.operators import repair, validation
from techpub_spark.sources import folders
from techpub_spark.sources.xmlnodes import xml_nodes

DOC = """<?xml version="1.0" encoding="UTF-8"?>
<!-- head --><a xmlns:x="u:x"  x:href='#1'>
 <b k='1' l = "a>b">x<!-- in -->y</b> tail <c/><?pi z?><d><![CDATA[1 < 2]]>é</d>
</a>""".encode()


def one(node, **e):
    return repair.spliced(DOC, node, e)


def test_an_edit_changes_its_own_bytes():
    assert one(1, op="set_attr", attr="k", value="2'&<") == DOC.replace(b"k='1'", b"k='2&apos;&amp;&lt;'")
    assert one(1, op="set_attr", attr="l", value='"') == DOC.replace(b'"a>b"', b'"&quot;"')
    assert one(2, op="set_attr", attr="n", value="a\nb") == DOC.replace(b"<c/>", b'<c n="a&#10;b"/>')
    assert one(1, op="set_text", value="<z>") == DOC.replace(b">x<!--", b">&lt;z&gt;<!--")
    assert one(2, op="set_text", value="z") == DOC.replace(b"<c/>", b"<c>z</c>")
    assert one(2, op="set_text", value="") == DOC
    assert one(3, op="set_text", value="2") == DOC.replace("<![CDATA[1 < 2]]>é".encode(), b"2")
    assert one(1, op="remove_element") == DOC.replace(b"""<b k='1' l = "a>b">x<!-- in -->y</b> tail """, b"")
    assert one(2, op="remove_element") == DOC.replace(b"<c/>", b"")
    assert one(2, op="insert_element", xml=" <n><m/></n><!-- gone -->") == DOC.replace(b"<c/>", b"<n><m/></n><c/>")
    assert one(1, op="insert_element", xml="<n/>", position="after") == DOC.replace(b" tail <c/>", b" tail <n/><c/>")
    assert one(2, op="insert_element", xml="<n/>", position="append-child") == DOC.replace(b"<c/>", b"<c><n/></c>")
    assert one(0, op="insert_element", xml="<n/>", position="append-child") == DOC.replace(b"</a>", b"<n/></a>")


@pytest.mark.parametrize("node,e", [
    (1, {"op": "set_attr", "attr": "k"}), (1, {"op": "set_attr", "value": "v"}), (1, {"op": "set_text"}), (1, {"op": "insert_element"}), (0, {"op": "remove_element"}),
    (1, {"op": "insert_element", "xml": "<n"}), (1, {"op": "insert_element", "xml": "<q:n/>"}), (1, {"op": "insert_element", "xml": "<n/>", "position": "inside"}), (0, {"op": "insert_element", "xml": "<n/>"}),
    (1, {"op": "burn"}), (1, {"op": "set_attr", "attr": "a b", "value": "v"}), (1, {"op": "set_text", "value": "\0"}), (1, {"op": "insert_element", "xml": "<!DOCTYPE n><n/>"}),
])
def test_edits_that_are_refused(node, e):
    with pytest.raises(ValueError):
        one(node, **e)


def test_encodings_stay():
    for code, mark in (("utf-16-le", b"\xff\xfe"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b"")):
        doc = mark + "<a><b>é</b></a>".encode(code)
        assert repair.spliced(doc, 1, {"op": "set_text", "value": "ü€"}) == mark + "<a><b>ü€</b></a>".encode(code)
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><a b=''>é</a>".encode("latin-1")
    assert repair.spliced(latin, 0, {"op": "set_attr", "attr": "b", "value": "ü€"}) == "<?xml version='1.0' encoding='ISO-8859-1'?><a b='ü&#8364;'>é</a>".encode("latin-1")
    with pytest.raises(ValueError):
        repair.spliced(b"<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", 0, {"op": "set_text", "value": "z"})


def edits_of(spark, rows, first="package string, file string"):
    return spark.createDataFrame([(*k, n, e["op"], e["xpath"], e.get("attr"), e.get("value"), e.get("xml"), e.get("position")) for k, n, e in rows], f"{first}, {repair.EDITS}")


def test_edits_of_many_files(spark):
    doc = b"<a><b>x</b><b>y</b><c/></a>"
    files = spark.createDataFrame([("p", f, bytearray(doc)) for f in "fghi"] + [("p", "bad", bytearray(b"<a"))], "package string, file string, content binary")
    insert = {"op": "insert_element", "xpath": "/a/c", "xml": "<b>z</b>"}
    rows = [
        (("p", "f"), 1, insert), (("p", "f"), 7, {"op": "set_text", "xpath": "//b[3]", "value": "w"}),  # the path is that of the edited file
        (("p", "g"), 1, insert), (("p", "g"), 2, {"op": "set_text", "xpath": "/a/b", "value": "w"}),  # selects three by then
        (("p", "h"), 1, {"op": "set_text", "xpath": "count(//b)", "value": "w"}), (("p", "none"), 1, insert), (("p", "bad"), 1, insert),
    ]
    got = {r.file: (bytes(r.content) if r.content is not None else None, r.error) for r in repair.apply_edits(files, edits_of(spark, rows)).collect()}
    assert got["f"] == (b"<a><b>x</b><b>y</b><b>w</b><c/></a>", None) and got["i"] == (doc, None) and len(got) == 6
    assert got["g"][0] == got["h"][0] == doc and "selects 3" in got["g"][1] and "not a selector" in got["h"][1] and got["none"] == (None, "no such file") and got["bad"][1].count("PARSE-001")


CODE = 'modelIdentCode="LX" systemDiffCode="A" systemCode="29" subSystemCode="1" subSubSystemCode="0" assyCode="00" disassyCode="00" disassyCodeVariant="A" infoCode="520" infoCodeVariant="A" itemLocationCode="{0}"'


APPLIC = "<applic><displayText><simplePara>All</simplePara></displayText></applic>"


def module(loc, body="<description><levelledPara><para>x</para></levelledPara></description>", applic=APPLIC):
    return (f'<dmodule><identAndStatusSection><dmAddress><dmIdent><dmCode {CODE.format(loc)}/><language languageIsoCode="en" countryIsoCode="US"/><issueInfo issueNumber="001" inWork="00"/></dmIdent>'
            f'<dmAddressItems><issueDate year="2024" month="01" day="01"/><dmTitle><techName>T</techName></dmTitle></dmAddressItems></dmAddress><dmStatus><security securityClassification="01"/>{applic}</dmStatus></identAndStatusSection><content>{body}</content></dmodule>')


def name(loc):
    return f"DMC-LX-A-29-10-00-00A-520A-{loc}_EN.xml"


LINK = "<dmRef><dmRefIdent><dmCode {0}/></dmRefIdent></dmRef>"


@pytest.fixture(scope="module")
def pack(spark):
    """A dangling reference in A, a missing applicability in B, a sound C and its copy, in two equal packages."""
    docs = {name("A"): module("A", f"<description><levelledPara><para>see {LINK.format(CODE.format('Z'))}</para></levelledPara></description>"), name("B"): module("B", applic=""), name("C"): module("C"), "DMC-LX-COPY.xml": module("C")}
    rows = [(p, f, len(d), bytearray(d.encode())) for p in ("p", "q") for f, d in docs.items()]
    return spark.createDataFrame(rows, "package string, file string, length long, content binary"), spark.createDataFrame([], "package string, ident string")


def test_candidates(spark, pack):
    files, icns = pack
    base = repair.baseline(files, icns)
    keys = {(r.package, r.key.split("@")[0]): r.key for r in base[2].collect()}
    assert sorted(keys) == [(p, x) for p in "pq" for x in ("BREX-004", "XREF-001")]  # the copy of C does not count
    to = {"op": "set_attr", "xpath": "//dmRef/dmRefIdent/dmCode", "attr": "itemLocationCode", "value": "C"}
    applic = {"op": "insert_element", "xpath": "//dmStatus", "xml": APPLIC, "position": "append-child"}
    cands = {
        "good": ("p", "XREF-001", [(name("A"), to)]), "wrong target": ("p", "BREX-004", [(name("A"), to)]), "new finding": ("p", "BREX-004", [(name("B"), applic), (name("B"), {"op": "set_attr", "xpath": "//dmCode", "attr": "infoCode", "value": "x"})]),
        "other package": ("q", "BREX-004", [(name("B"), applic)]), "broken path": ("p", "XREF-001", [(name("A"), to | {"xpath": "//nothing"})]), "no edits": ("p", "XREF-001", []), "two files": ("p", None, [(name("A"), to), (name("B"), applic)]),
        "copy": ("p", None, [("DMC-LX-COPY.xml", {"op": "set_text", "xpath": "//para", "value": "y"})]), "no file": ("p", None, [("DMC-none.xml", applic)]), "bad structure": ("p", "BREX-004", [(name("B"), applic | {"xml": "<applic/>"})]),
    }
    candidates = spark.createDataFrame([(c, p, keys.get((p, t))) for c, (p, t, _) in cands.items()], "candidate string, package string, target string")
    edits = edits_of(spark, [((c, f), n, e) for c, (_, _, es) in cands.items() for n, (f, e) in enumerate(es)], "candidate string, file string")
    got = {r.candidate: r for r in repair.verify_candidates(files, icns, candidates, edits, base=base).collect()}
    assert {c for c, r in got.items() if r.accepted} == {"good", "other package", "two files"} and len(got) == len(cands)
    assert got["good"].cleared == [keys["p", "XREF-001"]] and (got["good"].before, got["good"].after) == (2, 1) and got["good"].introduced == []
    assert "\n-<dmodule" in got["good"].diff and 'itemLocationCode="C"' in got["good"].diff and got["good"].source_lines == 1
    assert got["wrong target"].introduced == [] and got["new finding"].cleared == [keys["p", "BREX-004"]] and len(got["new finding"].introduced) >= 1
    assert [k.split("@")[0] for k in got["bad structure"].introduced] == ["SCHEMA-001"]
    assert any(k.startswith("BREX-002") for k in got["copy"].introduced)  # no copy any more
    assert "selects 0" in got["broken path"].error and got["no edits"].error == "no edits" and got["no file"].error == "no such file"
    # each candidate alone, through the whole package, gives the same
    for c in ("copy",):
        p, _, _ = cands[c]
        own = repair.apply_edits(files.where(f"package = '{p}'").select("package", "file", "content"), edits.where(f"candidate = '{c}'").withColumn("package", repair.F.lit(p)).drop("candidate"))
        whole = own.select("package", "file", repair.F.length("content").cast("long").alias("length"), "content")
        after = sorted(r.key for r in repair._keys(validation.validate(xml_nodes(whole), icns)).collect())
        before = sorted(k for (q, _), k in keys.items() if q == p)
        assert (got[c].cleared, got[c].introduced) == (sorted(set(before) - set(after)), sorted(set(after) - set(before))) and got[c].after == len(after)


def test_rounds_gate_and_swap(spark, pack, tmp_path):
    files, icns = pack
    files = files.where("package = 'p'")
    findings = validation.validate(xml_nodes(files), icns)

    def act(finding, said):
        if finding["rule_id"] == "XREF-001":
            return {"edits": [{"file": finding["file"], "op": "set_attr", "xpath": "//dmRef//dmCode", "attr": "itemLocationCode", "value": "C"}], "rationale": "to C", "tokens": 10}
        return {"edits": [{"file": "DMC-other.xml", "op": "burn", "xpath": "/"}], "tokens": 10}

    findings = repair.graph.cut(findings)
    base = repair.baseline(files, icns)
    made = repair.graph.cut(repair.repair_rounds(files, icns, findings, act, no_progress=2, base=base))
    got = {r.rule_id: r for r in made.collect()}
    assert got["XREF-001"].status == "patched" and got["XREF-001"].iterations == 1 and got["XREF-001"].tokens_used == 10 and got["XREF-001"].rationale == "to C" and got["XREF-001"].cleared == [got["XREF-001"].key]
    assert got["BREX-004"].status == "refused" and got["BREX-004"].iterations == 2 and set(got["BREX-004"].said) == {"a patch may only touch its finding's own file"} and got["BREX-004"].edits is None
    poor = repair.repair_rounds(files, icns, findings.where("rule_id = 'BREX-004'"), act, tokens=5).first()
    assert (poor.status, poor.diff, poor.iterations) == ("budget-exhausted", None, 1)

    written, fate = repair.apply_gate(files, icns, made, made.select("package", "key"), base)
    assert {r.rule_id: r.status for r in fate.collect()} == {"XREF-001": "applied", "BREX-004": "refused"}
    assert {r.status for r in repair.apply_gate(files, icns, made, made.select("package", "key").limit(0))[1].collect()} == {"declined", "refused"}
    for r in files.collect():
        (tmp_path / r.file).write_bytes(r.content)
    folder = folders.Folder(spark, f"file://{tmp_path}")
    rows = repair.graph.cut(written.select("file", "digest", "content"))
    assert folders.swap_files(folder, rows) == [name("A")] and sorted(folder.names()) == sorted(r.file for r in files.collect())
    assert b'itemLocationCode="C"/></dmRefIdent>' in (tmp_path / name("A")).read_bytes()
    with pytest.raises(OSError, match="verified"):
        folders.swap_files(folder, rows)  # the file has changed since


def test_recovery(spark, tmp_path):
    folder = folders.Folder(spark, f"file://{tmp_path}")
    assert folders.recover(folder) == []
    for f, x in (("a.xml", "new"), ("a.xml.bak", "old"), ("b.xml.new", "new"), ("b.xml", "old"), ("c.xml.bak", "stray"), (folders.JOURNAL, "a.xml\nb.xml")):
        (tmp_path / f).write_text(x)
    assert folders.recover(folder) == ["a.xml"]
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"a.xml": "old", "b.xml": "old", "c.xml.bak": "stray"}
    rows = spark.createDataFrame([("a.xml", hashlib.md5(b"old").hexdigest(), bytearray(b"1")), ("../b.xml", "", bytearray(b"2"))], "file string, digest string, content binary")
    with pytest.raises(OSError):
        folders.swap_files(folder, rows)
    assert (tmp_path / "a.xml").read_text() == "old"
    folder.replace("pointer", b"1")
    folder.replace("pointer", b"2")
    assert folder.read("pointer") == b"2"
