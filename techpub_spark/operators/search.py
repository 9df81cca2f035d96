"""Search over a corpus of chunks: modes, guards, golden anchors, evaluation and the corpus build.

``chunks``: chunk_id, package, dmc, dm_title, chunk_type, source_path, strategy, text, and where used icn_refs, dm_refs
(arrays), ``label`` (classification), ``asserts`` (applicability), ``embedding``.  ``queries``: query_id, query, and
``embedding`` for the dense arm.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize, xpath_related
from . import chunking, entity, fusion, governance, graph, lexical, metrics, paths, vector

#: The modes of a search.
MODES = ("bm25", "dense", "hybrid", "hybrid-rerank", "hybrid-graph", "hybrid-graph-rerank")
OVERLAP, LEAST_SHARED = 0.6, 2
#: Ids that are sent to all tasks at most.
MOST_SENT = 1 << 19


def _fail(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """``df``; reading it fails at the first row for which ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(message)).otherwise(F.lit(True)))


def own_rows(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ranked``; reading it fails if a row is not of this corpus (a stale or foreign index)."""
    known = chunks.select(F.col("chunk_id").alias("id")).distinct().withColumn("known", F.lit(True))
    return _fail(ranked.join(known, "id", "left"), F.col("known").isNull(), F.concat(F.lit("not in this corpus: "), F.col("id").cast("string"))).drop("known")


def discover(links: DataFrame, edges: DataFrame, depth: int = 2, fan_out: int = 20, cap: int = 100) -> DataFrame:
    """(query_id, pos, dmc, hop, direction): linked modules, then their neighbours, outgoing before incoming.

    Per query the first discovery wins; a module passes on at most ``fan_out`` new neighbours a hop and way.
    What a pass finds is stored, as all later ones read it.
    """
    first = links.select("query_id", "place", F.explode("dmcs").alias("dmc")).groupBy("query_id", "dmc").agg(F.min("place").alias("via"))
    seen = graph.cut(first.select("query_id", "dmc", F.lit(0).alias("hop"), F.lit("seed").alias("direction"), F.col("via").cast("string").alias("via")))
    front = seen
    ways = (("out", edges.select(F.col("src").alias("s"), F.col("dst").alias("n"))), ("in", edges.select(F.col("dst").alias("s"), F.col("src").alias("n"))))
    for hop in range(1, depth + 1):
        new = []
        for name, way in ways:
            step = front.select("query_id", F.col("dmc").alias("s")).distinct().join(way.distinct(), "s")
            step = step.join(seen.select("query_id", F.col("dmc").alias("n")), ["query_id", "n"], "left_anti")
            few = step.withColumn("rn", F.row_number().over(Window.partitionBy("query_id", "s").orderBy("n"))).where(F.col("rn") <= fan_out)
            found = graph.cut(few.groupBy("query_id", "n").agg(F.min("s").alias("via")).select("query_id", F.col("n").alias("dmc"), F.lit(hop).alias("hop"), F.lit(name).alias("direction"), "via"))
            seen = seen.unionByName(found)
            new.append(found)
        front = new[0].unionByName(new[1])
    w = Window.partitionBy("query_id").orderBy("hop", F.when(F.col("direction") == "in", 1).otherwise(0), "via", "dmc")
    return seen.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("query_id", "pos", "dmc", "hop", "direction")


def _text(chunks: DataFrame) -> DataFrame:
    """chunk_id and what the lexical index reads."""
    none = F.array().cast("array<string>")
    refs = [F.coalesce(F.col(c), none) if c in chunks.columns else none for c in ("icn_refs", "dm_refs")]
    return chunks.select("chunk_id", chunking.indexed_text(F.col("text"), F.col("dmc"), *refs).alias("text"))


def _needed(mode: str) -> tuple[str, ...]:
    """The arms of a mode; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {MODES}")
    return {"bm25": ("lexical",), "dense": ("near",)}.get(mode, ("graph", "lexical", "near") if "graph" in mode else ("lexical", "near"))


def _arm(name: str, queries: DataFrame, chunks: DataFrame, depth: int, edges: DataFrame | None) -> DataFrame:
    if name == "lexical":
        out = lexical.bm25(queries, _text(chunks), "chunk_id", "text", depth)
    elif name == "near":
        out = vector.knn(queries, chunks, depth, "chunk_id")
    elif edges is None:
        raise ValueError("the graph arm needs edges")
    else:
        links = entity.link(queries, chunks, entity.part_lexicon(chunks), entity.phrase_lexicon(chunks))
        return entity.graph_arm(discover(links, edges), chunks, depth).select("query_id", "rank", F.lit(0.0).alias("score"), "id", "hop", "direction")
    return out.select("query_id", "rank", "score", "id")


def _combined(mode: str, made: dict[str, DataFrame], queries: DataFrame, chunks: DataFrame, k: int, depth: int, scorer: Callable) -> DataFrame:
    parts = [made[x] for x in _needed(mode)]
    if len(parts) == 1:
        return parts[0].where(F.col("rank") <= k)
    fused = fusion.rrf(parts, depth).select("query_id", "rank", "score", "id")
    way = made["graph"].select("query_id", "id", "hop", "direction") if "graph" in _needed(mode) else None
    known = lambda out: out if way is None else out.join(way, ["query_id", "id"], "left").select("query_id", "rank", "score", "id", "hop", "direction")
    if not mode.endswith("rerank"):
        return known(fused)
    cand = fused.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "rank", "id")
    return known(fusion.rerank(cand, chunks.select(F.col("chunk_id").alias("id"), "text"), scorer, k))


def arms(queries: DataFrame, chunks: DataFrame, mode: str, k: int, edges: DataFrame | None = None, scorer: Callable = fusion.overlap_scorer) -> DataFrame:
    """(query_id, rank, score, id) of a mode, and with a graph arm the hop and direction by which it found a chunk (null: it
    did not).  The graph arm comes first, so that it goes first among equal sums.  Arms that are fused go ``max(k, ARM_DEPTH)`` deep."""
    names = _needed(mode)
    depth = max(k, fusion.ARM_DEPTH) if len(names) > 1 else k
    return _combined(mode, {x: _arm(x, queries, chunks, depth, edges) for x in names}, queries, chunks, k, depth, scorer)


def search(queries: DataFrame, chunks: DataFrame, k: int = 10, mode: str = "bm25", context: dict[str, str] | None = None, clearance: str | None = None, edges: DataFrame | None = None, scorer: Callable = fusion.overlap_scorer) -> DataFrame:
    """Top ``k`` per query under clearance and applicability: query_id, rank, score, id (and hop, direction, see ``arms``).

    What the clearance withholds leaves the corpus before any statistic, index or candidate is made.  The
    applicability ``context`` filters before scoring in mode bm25, so that its statistics are those of the
    applicable corpus; elsewhere after retrieval, which then has to reach the whole corpus: a corpus over
    the vector search's bound is refused rather than filtered in part.  Scores of fused modes mean nothing
    and are 0.  Reading the result fails if a row is foreign to the corpus or should have been withheld.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {MODES}")
    labelled = "label" in chunks.columns
    if clearance is not None and not labelled:
        raise ValueError("a clearance needs labelled chunks")
    admitted = governance.partition(chunks, "label", clearance)[0] if labelled else chunks
    if mode == "bm25":
        scope = admitted.where(governance.applies(F.col("asserts"), context)) if context else admitted
        return arms(queries, scope, mode, k)
    deep = k
    if context:
        deep = max(k, admitted.count())
        if deep > vector.MOST_K:
            raise ValueError(f"a filter after retrieval needs {deep} places, over {vector.MOST_K}")
    ranked = own_rows(arms(queries, admitted, mode, deep, edges, scorer), admitted)
    if context or labelled:
        extra = [c for c in ("label", "asserts") if c in chunks.columns]
        ranked = ranked.join(chunks.select(F.col("chunk_id").alias("id"), *extra), "id")
        if labelled:
            # the message names a column of the ranked side, so that the test can't move below the join
            bad = governance.withheld_reason(F.col("label"), clearance).isNotNull()
            ranked = _fail(ranked, bad, F.concat(F.lit("withheld row in an admitted set: rank "), F.col("rank").cast("string")))
        if context:
            ranked = ranked.where(governance.applies(F.col("asserts"), context))
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.lit(0.0).alias("score"), "id", *[c for c in ("hop", "direction") if c in ranked.columns])


def golden_anchors(golden: DataFrame) -> DataFrame:
    """(query_id, anchor, dmc, path) of ``golden``: query_id, query, relevant (array of dmc, source_path)."""
    return golden.select("query_id", F.posexplode("relevant").alias("anchor", "r")).select("query_id", "anchor", "r.dmc", F.col("r.source_path").alias("path"))


def resolve_anchors(anchors: DataFrame, nodes: DataFrame, dms: DataFrame) -> DataFrame:
    """(dmc, path, canonical, text): anchors that select exactly one element of a module.

    ``paths`` says which paths there are.  Where a module has several files, the last by package and name in
    which the path selects exactly one element counts.  A path that can't be used, and one that selects
    attributes, texts, a number, none or several elements, is not resolved.
    """
    wanted = anchors.select("dmc", "path").distinct().join(dms.select("package", "file", "dmc").distinct(), "dmc")
    found, _ = paths.select_nodes(nodes, wanted)
    one = found.groupBy("package", "file", "path").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.min("xpath").alias("canonical"), F.min("text").alias("text"))
    one = wanted.join(one.where("n = 1 and kind = 'element'"), ["package", "file", "path"])
    return one.groupBy("dmc", "path").agg(F.max_by(F.struct("canonical", "text"), F.struct("package", "file")).alias("r")).select("dmc", "path", "r.canonical", "r.text")


def unresolved(anchors: DataFrame, resolved: DataFrame) -> DataFrame:
    """Anchors (dmc, path) that no element answers to: the golden set has drifted from the corpus."""
    return anchors.select("dmc", "path").distinct().join(resolved.select("dmc", "path"), ["dmc", "path"], "left_anti")


def anchor_chunks(anchors: DataFrame, resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, anchor, id): chunks that cover each anchor; id is null where none does.

    A structure chunk covers an anchor of its module if one of their paths contains the other.  Chunks
    without a path cover it if they share ``OVERLAP`` of its words, two at least.
    """
    a = anchors.join(resolved, ["dmc", "path"], "left").select("query_id", "anchor", "dmc", "canonical", F.array_distinct(tokenize(F.col("text"))).alias("words"))
    c = chunks.select("dmc", F.col("chunk_id").alias("id"), "source_path", "strategy", F.array_distinct(tokenize(F.col("text"))).alias("own"))
    shared = F.size(F.array_intersect("words", "own"))
    by_text = (F.size("words") >= LEAST_SHARED) & (shared >= LEAST_SHARED) & (shared / F.size("words") >= OVERLAP)
    covers = F.when(F.col("strategy").isin("recursive", "semantic"), by_text).otherwise(xpath_related(F.col("source_path"), F.col("canonical")))
    hit = a.join(c, "dmc").where(F.col("canonical").isNotNull() & covers).select("query_id", "anchor", "id")
    return a.select("query_id", "anchor").distinct().join(hit, ["query_id", "anchor"], "left")


def run_eval(golden: DataFrame, nodes: DataFrame, dms: DataFrame, strategies: dict[str, DataFrame], k: int = 10, mode: str = "bm25", edges: DataFrame | None = None) -> DataFrame:
    """Metrics per chunking strategy on golden anchors; fails if an anchor is not resolved.

    ``strategies``: name -> chunks.  Queries without anchors count as traps: their share without a hit.
    """
    anchors = golden_anchors(golden)
    resolved = resolve_anchors(anchors, nodes, dms)
    lost = unresolved(anchors, resolved).limit(3).collect()
    if lost:
        raise ValueError(f"golden anchors without an element: {[tuple(r) for r in lost]}")
    traps = golden.where(F.size("relevant") == 0).select("query_id")
    out = []
    for name, chunks in strategies.items():
        ranked = arms(golden, chunks, mode, k, edges).select("query_id", "rank", "id")
        marks = anchor_chunks(anchors, resolved, chunks)
        lost = marks.groupBy("query_id", "anchor").agg(F.count("id").alias("n")).agg(F.count_if(F.col("n") == 0).alias("n_unmapped"))
        trap = metrics.zero_hit_rate(traps, ranked).select(F.col("n").alias("n_no_answer"), "zero_hit_rate")
        one = metrics.summary(metrics.per_query(ranked, marks)).crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(trap))  # one row each
        out.append(one.withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def ablation(golden: DataFrame, marks: DataFrame, chunks: DataFrame, modes: tuple[str, ...] = MODES, k: int = 10, edges: DataFrame | None = None, scorer: Callable = fusion.overlap_scorer, vectors: DataFrame | None = None) -> DataFrame:
    """Metrics per mode on the same queries, chunks and anchors (``marks``: query_id, anchor, id); an arm is searched once.
    ``vectors``: chunk_id and embedding, where they are stored apart from the chunks."""
    depth = max(k, fusion.ARM_DEPTH)
    names = sorted({x for m in modes for x in _needed(m)})
    golden, marks = graph.cut(golden), graph.cut(marks)
    made = {x: graph.cut(_arm(x, golden, vectors if x == "near" and vectors is not None else chunks, depth, edges)) for x in names}
    ids = graph.cut(reduce(DataFrame.unionAll, [a.select(F.col("id").alias("chunk_id")) for a in made.values()]).distinct())
    ids = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    found = graph.cut(chunks.select("chunk_id", "text").join(ids, "chunk_id", "left_semi"))  # what a mode can rerank, once for all
    # a mode's queries are queries of their own, so that all modes are measured at once
    every = [_combined(m, made, golden, found, k, depth, scorer).select(F.struct(F.lit(m).alias("mode"), "query_id").alias("query_id"), "rank", "id") for m in modes]
    own = marks.select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), "*").select(F.struct("mode", "query_id").alias("query_id"), "anchor", "id")
    per = metrics.per_query(graph.cut(reduce(DataFrame.unionByName, every)), own)
    out = metrics.summary(per.withColumn("mode", F.col("query_id.mode")).groupBy("mode"))
    names = golden.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    return names.join(out, "mode", "left").withColumn("n", F.coalesce("n", F.lit(0))).select(*[c for c in out.columns if c != "mode"], "mode")


def chunk_packages(nodes: DataFrame, dms: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Structure chunks of all sound modules; files that could not be read are an error unless ``skip_bad``."""
    if not skip_bad:
        bad = [r.file for r in nodes.where("error is not null").select("file").distinct().orderBy("file").limit(5).collect()]
        if bad:
            raise ValueError(f"unreadable files: {bad}")
    return chunking.structure_chunks(nodes.where("error is null"), dms)


def build_corpus(chunks: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """What is indexed: text chunks and figure chunks as one bag, one row per chunk id, owned by one package (the first by name).

    Reading fails if two packages hold different texts under one id.
    """
    every = chunks if figures is None else chunks.unionByName(figures, allowMissingColumns=True)
    w = Window.partitionBy("chunk_id")
    marked = every.withColumn("__texts", F.size(F.collect_set(F.md5("text")).over(w))).withColumn("__rn", F.row_number().over(w.orderBy("package", "source_path")))
    return _fail(marked, F.col("__texts") > 1, F.concat(F.lit("two texts of one id: "), "chunk_id")).where("__rn = 1").drop("__texts", "__rn")


def verify_corpus(corpus: DataFrame, manifest: DataFrame, strategy: str, provider: str) -> DataFrame:
    """``corpus``, or an error if its manifest differs from the stored one in any field (fail closed)."""
    from ..sources.store import manifest as of

    now, then = of(corpus, strategy, provider).first(), manifest.first()
    for field in now.asDict():
        if then is None or now[field] != then[field]:
            raise ValueError(f"the index is not of this corpus: {field} is {now[field]!r}, indexed {None if then is None else then[field]!r}")
    return corpus
