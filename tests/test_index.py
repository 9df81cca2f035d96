"""Versions of tables, the index over them, remembered model answers, and staged ingest."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from techpub_spark.operators import graph, index, infer, search, validation
from techpub_spark.sources.versions import Versions
from techpub_spark.streaming import streams

CHUNK = "chunk_id string, package string, dmc string, dm_title string, chunk_type string, source_path string, strategy string, text string, icn_refs array<string>, dm_refs array<string>, embedding array<double>"


def chunk(i, package, text, refs=()):
    return (f"c{i}", package, f"D{i}", "T", "step", f"/x{i}", "structure", text, [], list(refs), infer.hashed_vectors().call([text])[0])


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/index")


def test_versions(spark, store, tmp_path):
    assert store.current() is None and store.manifest() == {}
    with pytest.raises(ValueError, match="no table"):
        store.table("t")
    with pytest.raises(ValueError, match="nothing is published"):
        store.verify()
    store.publish({"t": spark.range(5), "u": spark.createDataFrame([("a", 1)], "k string, v int")}, {"n": 1}, "v1", by={"u": ["k"]})
    before = store.table("t")
    store.publish({"t": spark.range(3)}, {"n": 2}, "v2")
    assert (before.count(), store.table("t").count(), store.current(), store.manifest()["facts"]) == (5, 3, "v2", {"n": 2})  # a reader keeps its version
    assert store.table("u", "v1").first().asDict() == {"k": "a", "v": 1} and store.manifest("v1")["tables"]["t"]["rows"] == 5
    store.publish({"t": spark.range(9)}, {"n": 3}, "v2")  # the same version again
    assert store.table("t").count() == 3
    store.verify()

    class Ended(Exception):
        pass

    real, store.folder.replace = store.folder.replace, lambda *_: (_ for _ in ()).throw(Ended())
    with pytest.raises(Ended):
        store.publish({"t": spark.range(7)}, {}, "v3")
    store.folder.replace = real
    assert store.table("t").count() == 3 and store.current() == "v2"  # nobody sees what was not named
    assert store.prune(keep=0) == ["v1", "v3"] and store.table("t").count() == 3
    part = next(f for f in os.listdir(tmp_path / "index/versions/v2/t") if f.endswith(".parquet"))
    (tmp_path / "index/versions/v2/t" / part).unlink()
    with pytest.raises(ValueError, match="not those that were published"):
        store.verify()
    with pytest.raises(ValueError, match="version name"):
        store.publish({}, {}, "../x")


def test_index(spark, store, tmp_path):
    model, memo = infer.hashed_vectors(), f"file://{tmp_path}/memo"
    rows = [chunk(1, "p", "remove the pump", ["D2"]), chunk(2, "p", "fit the valve"), chunk(3, "q", "drain the tank", ["D1", "D2"])]
    chunks = spark.createDataFrame(rows, CHUNK)
    edges = chunks.select(F.col("dmc").alias("src"), F.explode("dm_refs").alias("dst"))
    assert index.publish(store, chunks.unionByName(chunks), edges, {"strategy": "structure", "provider": model.name, "revision": "1"}) == "v00000001"
    facts = store.manifest()["facts"]
    assert facts["packages"] == ["p", "q"] and facts["graph"] == {"nodes": 3, "edges": 3} and index.count(store) == 3
    assert [r.chunk_id for r in index.list_ids(store).collect()] == ["c1", "c2", "c3"]
    asked = spark.createDataFrame([(1, "drain the tank")], "query_id int, query string")
    assert index.search_index(asked, store, model, memo, 1, "dense").first().id == "c3"
    assert index.search_index(asked, store, model, memo, 1, "bm25").first().id == "c3"
    with pytest.raises(ValueError, match="the index is of"):
        index.search_index(asked, store, model._replace(revision="2"), memo)
    index.delete(store, spark.createDataFrame([("c3",)], "chunk_id string"))
    assert index.count(store) == 2 and store.manifest()["facts"]["graph"] == {"nodes": 2, "edges": 1} and store.current() == "v00000002"
    index.replace(store, spark.createDataFrame([chunk(4, "p", "new text")], CHUNK))
    assert [r.chunk_id for r in index.list_ids(store).collect()] == ["c4"] and store.table("chunks", "v00000002").count() == 2
    index.clear(store)
    assert index.count(store) == 0 and store.manifest()["facts"]["provider"] == model.name
    with pytest.raises(ValueError, match="two packages"):
        index.publish(store, spark.createDataFrame([chunk(1, "p", "a"), chunk(1, "q", "a")], CHUNK), edges, {})
    with pytest.raises(Exception, match="bad package name"):
        index.publish(store, spark.createDataFrame([chunk(1, "../p", "a")], CHUNK), edges, {})
    assert index.count(store) == 0
    assert index.file_digest([("b", b"2"), ("a", b"1")]) == hashlib.sha256(b"a1b2").hexdigest()[:16]


def test_attempts_and_deadline():
    said = iter([["", "b"], ["a"]])
    model = infer.Model("m", "1", lambda texts: next(said), "string", bool)
    assert infer.answered(model, ["x", "y"]) == [("a", None), ("b", None)]  # only the one that failed is asked again
    never = model._replace(call=lambda texts: [""] * len(texts))
    assert infer.answered(never, ["x"]) == [(None, "an answer that does not count")]
    short = model._replace(call=lambda texts: [])
    assert infer.answered(short, ["x"])[0][1].startswith("ValueError: 0 answers")
    ticks = iter([0.0, 0.0, 61.0])
    assert infer.answered(never, ["x"], lambda: next(ticks)) == [(None, "the deadline has passed")]


def test_answers_are_remembered(spark, tmp_path):
    root, log = f"file://{tmp_path}/memo", tmp_path / "log"
    path = str(log)

    def call(texts):
        with open(path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [None if t == "bad" else t.upper() for t in texts]

    model = infer.Model("up/per", "r1", call, "string", attempts=1)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "i int, t string")
    got = sorted((r.i, r.answer, r.why) for r in infer.inferred(rows, "t", model, root).collect())
    assert got == [(1, "A", None), (2, "B", None), (3, "A", None), (4, None, None), (5, None, "an answer that does not count")]
    assert sorted(log.read_text().split()) == ["a", "b", "bad"]  # each text once
    log.unlink()
    more = rows.unionByName(spark.createDataFrame([(6, "c")], rows.schema))
    assert {r.i: r.answer for r in infer.inferred(more, "t", model, root).collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: "C"}
    assert sorted(log.read_text().split()) == ["bad", "c"]  # what is known is not asked again, what failed is
    log.unlink()
    infer.inferred(rows, "t", model._replace(revision="r2"), root).collect()
    assert sorted(log.read_text().split()) == ["a", "b", "bad"]
    vectors = infer.inferred(rows.where("t = 'a'"), "t", infer.hashed_vectors(8), root).collect()
    assert len(vectors) == 2 and len(vectors[0].answer) == 8 and abs(sum(x * x for x in vectors[0].answer) - 1) < 1e-9


def test_staged_ingest(spark, store, tmp_path):
    inbox, refused = tmp_path / "inbox", f"file://{tmp_path}/refused"

    def check(nodes, icns):  # a short stand-in for the rules: a file that can't be read, or holds a bad element
        bad = nodes.where("error is not null or tag = 'bad'").select("package", "file", F.lit(None).cast("int").alias("line"))
        return validation.finding(bad.distinct(), "OWN-1", "L2", "error", F.lit("bad"))

    def upload(package, file, text):
        (inbox / package).mkdir(parents=True, exist_ok=True)
        (inbox / package / file).write_text(text)

    def run():
        streams.ingest(spark, f"file://{inbox}", f"file://{tmp_path}/checkpoint", store, refused, check=check).awaitTermination()
        return {(r.package, r.file): bytes(r.content).decode() for r in store.table("files").collect()} if store.current() else {}

    upload("p", "DMC-1.xml", "<a/>")
    upload("q", "DMC-1.xml", "<bad/>")
    upload("p", "notes.xml", "<bad/>")  # no file of a package
    assert run() == {("p", "DMC-1.xml"): "<a/>"}
    first = store.current()
    upload("p", "DMC-2.xml", "<a><bad/></a>")
    upload("p", "DMC-3.xml", "<a/>")
    assert run() == {("p", "DMC-1.xml"): "<a/>"} and store.current() == first  # refused whole, and nothing was published
    upload("p", "DMC-4.xml", "<a>4</a>")
    upload("q", "DMC-2.xml", "<c/>")
    files = run()
    assert files == {("p", "DMC-1.xml"): "<a/>", ("p", "DMC-4.xml"): "<a>4</a>", ("q", "DMC-2.xml"): "<c/>"} and store.current() > first
    assert sorted((r.package, r.file) for r in spark.read.parquet(refused).collect()) == [("p", "DMC-2.xml"), ("q", "DMC-1.xml")]
    again = spark.createDataFrame([("p", "DMC-9.xml", 4, bytearray(b"<z/>"))], "package string, file string, length long, content binary")
    now = store.manifest()["facts"]["batch"]
    assert streams.stage_batch(store, again, now, check=check).count() == 0 and store.table("files").count() == 3  # a batch that was played already
    over = spark.createDataFrame([("p", "DMC-1.xml", 4, bytearray(b"<n/>"))], again.schema)
    streams.stage_batch(store, over, now + 1, check=check)
    assert {r.file for r in store.table("files").where("cast(content as string) = '<n/>'").collect()} == {"DMC-1.xml"} and store.table("files").count() == 3


def test_build_from_packages(spark, store, tmp_path):
    from test_repair import module, name

    from techpub_spark.sources.xmlnodes import xml_nodes

    docs = {name("A"): module("A"), name("B"): module("B")}
    nodes = graph.cut(xml_nodes(spark.createDataFrame([("p", f, len(d), bytearray(d.encode())) for f, d in docs.items()], "package string, file string, length long, content binary")))
    model = infer.hashed_vectors()
    index.index_packages(nodes, validation.data_modules(nodes), store, model, f"file://{tmp_path}/memo")
    facts = store.manifest()["facts"]
    assert facts["packages"] == ["p"] and facts["provider"] == "hash-64" and index.count(store) == 2
    with pytest.raises(ValueError, match="without a vector"):
        index.index_packages(nodes, validation.data_modules(nodes), store, model._replace(revision="2", call=lambda t: [None] * len(t)), f"file://{tmp_path}/memo")
    assert index.count(store) == 2 and search.MODES
