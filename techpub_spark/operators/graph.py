"""Dependency graph: impact, neighbourhood, cycles, facts, sync.  Edges: ``src``, ``dst``.

Loops run on the driver, one hop a round; frontiers and visited sets stay distributed and are written to
the session's checkpoint folder, so that lineage doesn't grow and lost executors don't matter.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task of a search takes on average.
TASK_ROWS = 1 << 19


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder; only a local session may do without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="techpub-ck-"))
    return df.checkpoint(eager=True)


def impact(edges: DataFrame, targets: DataFrame, depth: int, cap: int = 1000) -> DataFrame:
    """Who depends on each target, by reverse breadth-first search: target, dmc, hops, truncated.

    ``targets``: one column ``target``.  A node is reported at its smallest hop, the target itself never;
    at most ``cap`` rows a target in the order (hops, dmc), with a flag if there were more.  So no more than
    ``cap`` + 1 of them are kept, nor is a target followed further that has them: later hops only come after.
    """
    back = cut(edges.select(F.col("dst").alias("to"), F.col("src").alias("dmc")).distinct())
    degree = back.groupBy("to").agg(F.count("*").alias("n"))
    seen = cut(targets.select("target", F.col("target").alias("dmc"), F.lit(0).alias("hops")).distinct())
    w = Window.partitionBy("target").orderBy("hops", "dmc")
    for hop in range(1, depth + 1):
        full = seen.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") > cap + 1).select("target")
        front = seen.where(F.col("hops") == hop - 1).join(full, "target", "left_anti").select("target", F.col("dmc").alias("to"))
        rows = front.join(degree, "to").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not rows:
            break
        step = front.join(back, "to").select("target", "dmc", F.lit(hop).alias("hops"))
        every = seen.unionByName(step).repartition(-(-rows // TASK_ROWS) + 1, "target")  # many small tasks, each with whole targets
        least = every.groupBy("target", "dmc").agg(F.min("hops").alias("hops"))
        seen = cut(least.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap + 2).drop("rn"))
    n = seen.where("hops > 0").withColumn("rn", F.row_number().over(w))
    more = n.where(F.col("rn") == cap + 1).select("target", F.lit(True).alias("truncated"))
    return n.where(F.col("rn") <= cap).join(more, "target", "left").select("target", "dmc", "hops", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, fan_out: int = 20, cap: int = 100, most_seeds: int = 25) -> DataFrame:
    """Both directions from the seeds: dmc, hop, direction, via, truncated; outgoing before incoming in each hop.

    What the outgoing pass of a hop finds counts as visited in its incoming pass.  Each node passes on at
    most ``fan_out`` new neighbours (smallest first); the first discovery in (via, dmc) order wins.
    """
    if seeds.limit(most_seeds + 1).count() > most_seeds:
        raise ValueError(f"more than {most_seeds} seeds")
    kind = edges.schema["src"].dataType.simpleString()
    seen = cut(seeds.select(F.col("dmc"), F.lit(0).alias("hop"), F.lit("seed").alias("direction"), F.lit(None).cast(kind).alias("via")).distinct())
    front = seen
    ways = (("out", edges.select(F.col("src").alias("s"), F.col("dst").alias("n"))), ("in", edges.select(F.col("dst").alias("s"), F.col("src").alias("n"))))
    for hop in range(1, depth + 1):
        new = []
        for name, way in ways:
            step = front.select(F.col("dmc").alias("s")).distinct().join(way.distinct(), "s").join(seen.select(F.col("dmc").alias("n")), "n", "left_anti")
            few = step.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("n"))).where(F.col("rn") <= fan_out)
            found = cut(few.groupBy("n").agg(F.min("s").alias("via")).select(F.col("n").alias("dmc"), F.lit(hop).alias("hop"), F.lit(name).alias("direction"), "via"))
            seen = seen.unionByName(found)
            new.append(found)
        front = new[0].unionByName(new[1])
        if front.isEmpty():
            break
    order = F.struct("hop", F.when(F.col("direction") == "out", 0).otherwise(1), "via", "dmc")
    first = seen.where("hop > 0").withColumn("o", order).orderBy("o").limit(cap + 1)  # a bounded number of rows from here on
    placed = first.withColumn("rn", F.row_number().over(Window.orderBy("o"))).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > cap)
    return placed.where(F.col("rn") <= cap).orderBy("rn").select("dmc", "hop", "direction", "via", "truncated")


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without nodes that lack an incoming or outgoing edge, round by round: they can't be in a cycle."""
    size = edges.count()
    while size:
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        size, before = edges.count(), size
        if size == before:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, or with a loop: carrier, members.

    Forward-backward colouring: the smallest node that reaches a node is its colour; what reaches back to
    that node inside the colour is its component, and leaves the graph.  A round moves each edge once;
    nothing is closed transitively.
    """
    left = _trimmed(cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct()))
    found = []
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour, changed = cut(nodes.withColumn("c", F.col("node"))), 1
        while changed:
            seen = left.join(colour, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("c").alias("m"))
            after = cut(colour.join(seen, F.col("node") == F.col("dst"), "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            changed, colour = after.where("moved").count(), after.select("node", "c")
        paint = colour.toDF("p", "pc")
        inner = left.join(colour, F.col("src") == F.col("node")).join(paint, F.col("dst") == F.col("p")).where("c = pc").select("src", "dst", "c")
        front = part = cut(colour.where("node = c"))
        inner = cut(inner)
        while not front.isEmpty():
            back = inner.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c").distinct()
            front = cut(back.join(part.select("node"), "node", "left_anti"))
            part = cut(part.unionByName(front))
        found.append(part)
        gone = part.select("node")
        left = _trimmed(cut(left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")))
    if not found:
        return edges.where(F.lit(False)).groupBy(F.col("src").alias("carrier")).agg(F.sort_array(F.collect_set("src")).alias("members"))
    every = reduce(DataFrame.unionByName, found)
    loops = edges.where("src = dst").select(F.col("src").alias("carrier")).distinct().withColumn("loop", F.lit(True))
    group = every.groupBy(F.col("c").alias("carrier")).agg(F.sort_array(F.collect_set("node")).alias("members"))
    return group.join(loops, "carrier", "left").where((F.size("members") > 1) | F.col("loop")).select("carrier", "members")


def facts(nodes: DataFrame, refs: DataFrame, uses: DataFrame, asked: DataFrame) -> DataFrame:
    """Per known node asked for: sorted distinct outgoing and incoming neighbours and figures.

    Each side is aggregated before its join, so that they don't multiply.
    """
    want = asked.select("dmc").distinct().join(nodes.select("dmc").distinct(), "dmc", "left_semi")
    out = refs.groupBy(F.col("src").alias("dmc")).agg(F.sort_array(F.collect_set("dst")).alias("references"))
    into = refs.groupBy(F.col("dst").alias("dmc")).agg(F.sort_array(F.collect_set("src")).alias("referenced_by"))
    icn = uses.groupBy(F.col("src").alias("dmc")).agg(F.sort_array(F.collect_set("ident")).alias("icns"))
    none = lambda c: F.array().cast(f"array<{c}>")
    kind = refs.schema["src"].dataType.simpleString()
    return want.join(out, "dmc", "left").join(into, "dmc", "left").join(icn, "dmc", "left").select("dmc", *[F.coalesce(c, none(kind)).alias(c) for c in ("references", "referenced_by")], F.coalesce("icns", none("string")).alias("icns"))


def sync(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, refs, uses_icn) recomputed from chunks: what is gone from the corpus is gone from the graph.

    ``chunks``: dmc, dm_title, package, outbound_dm_refs, icn_refs.  A dangling target is a node without package.
    """
    own = chunks.groupBy("dmc").agg(F.min("dm_title").alias("title"), F.min("package").alias("package"))
    refs = chunks.select(F.col("dmc").alias("src"), F.explode("outbound_dm_refs").alias("dst")).distinct()
    uses = chunks.select(F.col("dmc").alias("src"), F.explode("icn_refs").alias("ident")).distinct()
    bare = refs.select(F.col("dst").alias("dmc")).distinct().join(own, "dmc", "left_anti").select("dmc", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("package"))
    return own.unionByName(bare), refs, uses


def stats(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: nodes of the corpus and edges."""
    return nodes.agg(F.count_if(F.col("package").isNotNull()).alias("dm_nodes")).crossJoin(F.broadcast(refs.agg(F.count("*").alias("edges"))))
