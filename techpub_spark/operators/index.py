"""The index as versions: built from packages, searched only where it still is what was published, changed by whole versions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import PACKAGE
from ..sources.versions import Versions
from . import graph, infer, search

CHUNKS, IDS, EDGES = "chunks", "ids", "edges"


def _checked(chunks: DataFrame) -> DataFrame:
    """``chunks``; reading fails at a package name that makes no folder, a missing vector, or an id of two packages."""
    lone = chunks.groupBy("chunk_id").agg(F.min("package").alias("lo"), F.max("package").alias("hi")).where("lo <> hi").limit(3).collect()
    if lone:
        raise ValueError(f"chunks of two packages, which can't share an index: {[tuple(r) for r in lone]}")
    bad = ~F.coalesce(F.col("package").rlike(PACKAGE), F.lit(False))
    if "embedding" in chunks.columns:
        bad = bad | F.col("embedding").isNull()
    return chunks.where(F.when(bad, F.raise_error(F.concat(F.lit("bad package name or missing vector: "), F.col("chunk_id")))).otherwise(F.lit(True)))


def publish(store: Versions, chunks: DataFrame, edges: DataFrame, facts: dict, version: str | None = None) -> str:
    """Publish chunks, their sorted ids and the edges between modules as one version; its name."""
    one = graph.cut(_checked(chunks).dropDuplicates(["chunk_id"]))
    ids = one.select("chunk_id").orderBy("chunk_id")
    pairs = edges.select("src", "dst").distinct()
    last = store.current()
    name = version or f"v{int(last[1:]) + 1 if last and last[1:].isdigit() else 1:08d}"
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("n")).distinct().count()
    facts = facts | {"packages": [r.package for r in one.select("package").distinct().orderBy("package").collect()], "graph": {"nodes": nodes, "edges": pairs.count()}}
    return store.publish({CHUNKS: one, IDS: ids, EDGES: pairs}, facts, name, by={CHUNKS: ["package"]})


def index_packages(nodes: DataFrame, dms: DataFrame, store: Versions, model: infer.Model, memo: str, figures: DataFrame | None = None, skip_bad: bool = False, strategy: str = "structure") -> str:
    """Chunks of packages with their vectors and references, published as a version; its name.

    A file that can't be read stops the build unless ``skip_bad``; a text without a vector stops it always.
    """
    corpus = search.build_corpus(search.chunk_packages(nodes, dms, skip_bad), figures)
    vectors = infer.inferred(corpus, "text", model, memo)
    lost = vectors.where("answer is null").select("chunk_id", "why").limit(3).collect()
    if lost:
        raise ValueError(f"chunks without a vector: {[tuple(r) for r in lost]}")
    edges = corpus.where(F.size(F.coalesce("dm_refs", F.array().cast("array<string>"))) > 0).select(F.col("dmc").alias("src"), F.explode("dm_refs").alias("dst"))
    facts = {"strategy": strategy, "provider": model.name, "revision": model.revision}
    return publish(store, vectors.withColumnRenamed("answer", "embedding").drop("why"), edges, facts)


def _next(store: Versions, chunks: DataFrame, dropped: DataFrame | None) -> str:
    """The version after the current one, with other chunks and the edges that they still have."""
    edges = store.table(EDGES)
    if dropped is not None:
        edges = edges.join(dropped.select(F.col("dmc").alias("src")).distinct(), "src", "left_anti")
    facts = {k: v for k, v in store.manifest()["facts"].items() if k not in ("packages", "graph")}
    return publish(store, chunks, edges.select("src", "dst"), facts)


def delete(store: Versions, ids: DataFrame) -> str:
    """A version without the chunks in ``ids`` (chunk_id); modules that lose all their chunks lose their edges."""
    now = store.table(CHUNKS)
    left = graph.cut(now.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti").select(*now.columns))
    gone = now.select("dmc").distinct().join(left.select("dmc").distinct(), "dmc", "left_anti")
    return _next(store, left, gone)


def replace(store: Versions, chunks: DataFrame) -> str:
    """A version in which the packages that ``chunks`` holds are those of ``chunks``."""
    now = store.table(CHUNKS)
    packages = chunks.select("package").distinct()
    rest = now.join(packages, "package", "left_anti").select(*now.columns)
    return _next(store, graph.cut(rest.unionByName(chunks.select(*now.columns))), None)


def clear(store: Versions) -> str:
    """A version without chunks and edges."""
    return _next(store, store.table(CHUNKS).limit(0), store.table(CHUNKS))


def count(store: Versions) -> int:
    """Number of chunks, from the manifest."""
    return store.manifest()["tables"][CHUNKS]["rows"]


def list_ids(store: Versions) -> DataFrame:
    """All chunk ids in order, as they were published."""
    return store.table(IDS)


def search_index(queries: DataFrame, store: Versions, model: infer.Model, memo: str, k: int = 10, mode: str = "hybrid", **how) -> DataFrame:
    """``search.search`` over the current version, with query vectors by the model that made the index.

    Refused if the files are not those that were published or the index is of another model or revision.
    """
    version = store.current()
    store.verify(version)
    facts = store.manifest(version)["facts"]
    if (facts.get("provider"), facts.get("revision")) != (model.name, model.revision):
        raise ValueError(f"the index is of {facts.get('provider')} {facts.get('revision')}, not of {model.name} {model.revision}")
    asked = infer.inferred(queries, "query", model, memo)
    asked = search._fail(asked, F.col("answer").isNull() & F.col("query").isNotNull(), F.concat(F.lit("no vector: "), F.coalesce("why", F.lit("")))).withColumnRenamed("answer", "embedding").drop("why")
    return search.search(graph.cut(asked), store.table(CHUNKS, version), k, mode, edges=store.table(EDGES, version), **how)


def file_digest(parts: list[tuple[str, bytes]]) -> str:
    """First 16 hex digits of SHA-256 over sorted (relative path, bytes): identity of a small folder of definitions."""
    h = hashlib.sha256()
    for name, content in sorted(parts):
        h.update(name.encode())
        h.update(content)
    return h.hexdigest()[:16]
