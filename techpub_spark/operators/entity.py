"""Entity lexicons and linking, and the graph arm of retrieval."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BARE_CODE, FULL_CODE, HYPHEN_TOKEN, PART_SHAPE, normal_phrase


def part_lexicon(chunks: DataFrame) -> DataFrame:
    """(part, dmcs): part numbers of parts-data chunks; a part has a digit and is no document code."""
    parts = chunks.where("chunk_type = 'ipd'").select("dmc", F.explode(F.regexp_extract_all("text", F.lit(PART_SHAPE), F.lit(0))).alias("part"))
    return parts.where(F.col("part").rlike("[0-9]") & ~F.col("part").startswith("DMC-")).groupBy("part").agg(F.sort_array(F.collect_set("dmc")).alias("dmcs"))


def phrase_lexicon(chunks: DataFrame) -> DataFrame:
    """(phrase, dmcs): normal forms, of two words or more, of the parts of titles around the dash."""
    raw = chunks.select("dmc", F.explode(F.split("dm_title", "—")).alias("t"))
    return raw.select("dmc", normal_phrase(F.col("t")).alias("phrase")).where(F.size(F.split("phrase", " ")) >= 2).groupBy("phrase").agg(F.sort_array(F.collect_set("dmc")).alias("dmcs"))


_SHAPES = [re.compile(p, re.ASCII) for p in (FULL_CODE, BARE_CODE, HYPHEN_TOKEN)]


def _code_places(query: pd.Series) -> pd.Series:
    """Places of full codes, bare codes and joined tokens in upper-cased queries, per query in that order."""
    out = []
    for text in query.fillna("").str.upper():
        out.append([(k, m.start(), m.end(), m[0]) for k, shape in enumerate(_SHAPES) for m in shape.finditer(text)])
    return pd.Series(out)


def link(queries: DataFrame, dmcs: DataFrame, parts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, kind, surface, dmcs, place): codes (``dmc``, full or bare), parts and tasks that a query names.

    A code that the corpus does not hold links nothing.  A bare code inside a linked full one, and a part
    inside a linked code, are left out.  Tasks: candidates come from a join on the first word, then the
    longest wins and consumes its span, per query.  ``place`` orders a query's entities.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    found = F.pandas_udf(_code_places, "array<struct<k:int,s:int,e:int,surface:string>>")(F.col("query"))
    at = queries.select("query_id", F.explode(found).alias("p")).select("query_id", "p.*")
    known = dmcs.select("dmc").distinct()
    full = at.where("k = 0").join(known, F.col("surface") == F.col("dmc")).select("query_id", "k", "s", "e", "surface", F.array("dmc").alias("dmcs"))
    # a bare code is a fixed number of trailing groups of a full one, so that the join is an equi-join
    tail = known.select("dmc", F.concat_ws("-", F.slice(F.split("dmc", "-"), -6, 6)).alias("t")).where(F.size(F.split("dmc", "-")) > 6)
    bare = at.where("k = 1").join(tail, F.col("surface") == F.col("t")).groupBy("query_id", "k", "s", "e", "surface").agg(F.sort_array(F.collect_set("dmc")).alias("dmcs"))
    part = at.where("k = 2").join(parts.select("part", "dmcs"), F.col("surface") == F.col("part")).select("query_id", "k", "s", "e", "surface", "dmcs")
    hits = full.unionByName(bare).unionByName(part).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("k", "s", "e", "surface", "dmcs"))).alias("h"))
    inside = lambda x: F.exists("h", lambda y: (y["k"] < x["k"]) & (y["s"] <= x["s"]) & (x["e"] <= y["e"]))
    codes = hits.select("query_id", F.explode(F.filter("h", lambda x: ~inside(x))).alias("x"))
    codes = codes.select("query_id", F.when(F.col("x.k") < 2, "dmc").otherwise("part").alias("kind"), "x.surface", "x.dmcs", (F.col("x.k") * F.lit(1 << 20) + F.col("x.s")).alias("place"))
    q = queries.select("query_id", normal_phrase(F.col("query")).alias("norm"))
    words = q.select("query_id", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("w"))
    cand = words.join(phrases.withColumn("w", F.get(F.split("phrase", " "), 0)), "w").where(F.contains(F.concat(F.lit(" "), "norm", F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" "))))

    def longest(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        text, taken, out = f" {rows['norm'].iloc[0]} ", [], []
        for r in sorted(rows.drop_duplicates("phrase").itertuples(), key=lambda r: (-len(r.phrase), r.phrase)):
            at = text.find(f" {r.phrase} ")
            while at >= 0 and any(s < at + len(r.phrase) + 1 and at < e for s, e in taken):
                at = text.find(f" {r.phrase} ", at + 1)
            if at >= 0:
                taken.append((at, at + len(r.phrase) + 1))
                out.append((key[0], "task", r.phrase, list(r.dmcs), (3 << 20) + len(out)))
        return pd.DataFrame(out, columns=["query_id", "kind", "surface", "dmcs", "place"])

    chosen = cand.select("query_id", "norm", "phrase", "dmcs").groupBy("query_id").applyInPandas(longest, f"query_id {kind}, kind string, surface string, dmcs array<string>, place int")
    return codes.unionByName(chosen)


def graph_arm(discovered: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Chunks of discovered modules in discovery order: query_id, rank, id, hop, direction.

    ``discovered``: query_id, pos, dmc, hop, direction; within a module chunks go by source_path, and only its
    first ``k`` meet the queries.
    """
    w = Window.partitionBy("query_id").orderBy("pos", "source_path", "chunk_id")
    own = Window.partitionBy("dmc").orderBy("source_path", "chunk_id")
    first = chunks.select("dmc", "chunk_id", "source_path", F.row_number().over(own).alias("rn")).where(F.col("rn") <= k).drop("rn")
    return discovered.join(first, "dmc").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("chunk_id").alias("id"), "hop", "direction")
