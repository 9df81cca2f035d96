"""Source divergence audit: how far the term distributions of sources of one language lie apart.

1. Each task counts, for every (lang, term), the documents that hold it in a count-min sketch of a fixed
   size whose cells stop at ``least``; sketches are added up in blocks.  A cell never says too little.
2. A second scan leaves out every term with a cell under ``least``: it can't be in ``least`` documents.  Only
   occurrences of the rest are shuffled, summed within each task before; they are counted exactly, and what
   the sketch let through wrongly goes.
3. Distances of all sources of a language need no dense table.  A term that neither source has adds
   |b - b'| (their shares of a term without occurrence); closed sums and a join of the few different
   shares correct that for terms of one of them, and a join on the term for those of both.

Shares are integers: 1 + floor(1000000000 (count + 5) / (N + 5 V)), in decimals where 64 bits could
overflow.  Style: Arrow batches with numpy for the two scans, DataFrame joins for the rest.

Defined results: a null text, lang or source is ''; a group without kept terms has count 0 for each; a
language without kept terms has distance 0 between its sources; every row counts as a document of its own,
also where doc_ids repeat; ties go by the item's bytes; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, stored
from .terms import LETTERS, pieces, split_terms

LEAST, RANKS = 30, 50
#: Cells in a row of the sketch (a byte each) and rows: fixed sizes, whatever the data.  Too few cost shuffled rows, not results.
WIDTH, DEPTH = 1 << 22, 3
#: Cells in a block of the sketch.
BLOCK = 1 << 14


def cells(lang: str, terms: list[str], width: int, depth: int) -> np.ndarray:
    """(depth, terms) places in the flat sketch."""
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    h = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed) for t in terms], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((h + np.uint64(k) * step) % np.uint64(width)).astype(np.int64) + k * width for k in range(depth)])


def _groups(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Number of each row's group, and the groups."""
    keys = list(zip(*[batch.column(n).to_pylist() for n in names], strict=True))
    known = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    return np.array([known[k] for k in keys], np.int64), list(known)


def _counted(part: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.Array, np.ndarray, np.ndarray]]:
    """For each group: its different terms, their occurrences and documents."""
    group, keys = _groups(part, names)
    terms, row = split_terms(part.column("text"), LETTERS)
    if not len(terms):
        return
    coded = terms.dictionary_encode()
    n = len(coded.dictionary)
    pair, times = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
    key = group[pair // n] * n + pair % n
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    found, docs, occur = key[order][starts], np.diff(np.append(starts, len(key))), np.add.reduceat(times[order], starts)
    bounds = np.searchsorted(found, np.arange(len(keys) + 1) * n)
    for g, k in enumerate(keys):
        if (lo := bounds[g]) < (hi := bounds[g + 1]):
            yield k, coded.dictionary.take(pa.array(found[lo:hi] % n)), occur[lo:hi], docs[lo:hi]


def _sketched(least: int, width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * depth, np.uint32)
        for batch in batches:
            for part in pieces(batch, "text"):
                for (lang,), terms, _, docs in _counted(part, ["lang"]):
                    for at in cells(lang, terms.to_pylist(), width, depth):
                        np.add.at(total, at, docs.astype(np.uint32))
            np.minimum(total, least, out=total)
        yield from _blocks(total.astype(np.uint8))

    return run


def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    full = np.flatnonzero(np.maximum.reduceat(total, np.arange(0, len(total), BLOCK)))
    for at in range(0, len(full), 64):
        some = full[at : at + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in some], pa.binary())], names=["block", "cells"])


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(raw, np.uint8).astype(np.uint16)
                total[b] = np.minimum(total[b] + new, least) if b in total else new
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.uint8).tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])

    return run


def document_sketch(docs: DataFrame, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """Merged count-min sketch (flat, ``depth`` x ``width`` bytes) of the documents that hold each (lang, term), up to ``least``.

    ``docs``: ``text``, ``lang``.  ``least`` is at most 255.  The driver gets the sketch, which has a fixed size.
    """
    if not 0 < least < 256 or width % BLOCK:
        raise ValueError(f"least must be 1 to 255 and width a multiple of {BLOCK}")
    parts = docs.select("text", "lang").mapInArrow(_sketched(least, width, depth), "block long, cells binary")
    found = parts.repartition("block").mapInArrow(_merged(least), "block long, cells binary").toArrow()
    out = np.zeros(width * depth, np.uint8)
    for b, raw in zip(found["block"].to_pylist(), found["cells"].to_pylist(), strict=True):
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(raw, np.uint8)
    return out


def _survivors(sketch, least: int, width: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = list(_counted(part, ["lang", "source"]))
                likely = {}
                for lang in dict.fromkeys(k[0] for k, *_ in found):
                    terms = pa.chunked_array([t for k, t, *_ in found if k[0] == lang]).unique()
                    able = (sketch.value[cells(lang, terms.to_pylist(), width, depth)] >= least).all(axis=0)
                    likely[lang] = terms.filter(pa.array(able))
                for (lang, source), terms, n, docs in found:
                    able = pc.is_in(terms, likely[lang])
                    few = np.flatnonzero(able.to_numpy(zero_copy_only=False))
                    if len(few):
                        names = [pa.array([x] * len(few), pa.string()) for x in (lang, source)]
                        yield pa.RecordBatch.from_arrays([*names, terms.filter(able).cast(pa.string()), pa.array(n[few]), pa.array(docs[few])], names=["lang", "source", "term", "n", "d"])

    return run


def term_counts(docs: DataFrame, least: int = LEAST, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, term, n (occurrences there), total (in the language) of the terms in at least ``least`` documents of a language."""
    work = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    sketch = work.sparkSession.sparkContext.broadcast(document_sketch(work, least, width, depth))
    found = work.mapInArrow(_survivors(sketch, least, width, depth), "lang string, source string, term string, n long, d long")
    counts = stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "counts", heavy=True)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("d").alias("d")).where(F.col("d") >= least).drop("d")
    out = stored(counts.drop("d").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept", heavy=True)
    dropped(counts)
    return out


def share(count: str, whole: str, terms: str) -> Column:
    """1 + floor(1000000000 (count + 5) / (whole + 5 terms)), exactly; null without terms."""
    return F.expr(
        f"if({terms} > 0, 1L + (cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) div cast({whole} + 5 * {terms} as decimal(20,0)), null)"
    )


def group_shares(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Each (lang, source) of the documents: n (occurrences of kept terms), v and ln (kept terms of the language and their occurrences), b (share of a term without occurrence)."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    langs = kept.select("lang", "term", "total").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("ln"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    out = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "ln", "n"])
    return out.withColumn("b", F.coalesce(share("0L", "n", "v"), F.lit(0)))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Distance of every two sources s1 < s2 of a language."""
    above = rows.groupBy("lang", "source").agg(F.sum(F.col("p") - F.col("b")).alias("a"))
    known = groups.join(above, ["lang", "source"], "left").na.fill(0, ["a"])
    side = lambda k: known.select("lang", F.col("source").alias(f"s{k}"), F.col("b").alias(f"b{k}"), F.col("a").alias(f"a{k}"), F.col("v").alias(f"v{k}"))
    every = side(1).join(side(2), "lang").where("s1 < s2").selectExpr("lang", "s1", "s2", "v1 * abs(b1 - b2) + a1 + a2 as value")
    # a source whose share of nothing is above another's: some terms of that other lie below it
    shares = rows.groupBy("lang", "source", "p", "b").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("o"), F.col("b").alias("bo"))
    below = shares.join(other, (shares["lang"] == other["lang"]) & (F.col("bo") > F.col("b")) & (F.col("o") != F.col("source"))).select(
        shares["lang"], F.least("source", "o").alias("s1"), F.greatest("source", "o").alias("s2"), F.expr("-2 * m * least(p - b, bo - b)").alias("value")
    )
    left, right = (rows.select("lang", "term", F.col("source").alias(f"s{k}"), F.col("p").alias(f"p{k}"), F.col("b").alias(f"b{k}")) for k in (1, 2))
    both = left.join(right, ["lang", "term"]).where("s1 < s2").selectExpr("lang", "s1", "s2", "abs(p1 - p2) - abs(p1 - b2) - abs(p2 - b1) + abs(b1 - b2) as value")
    both = both.groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))
    return every.unionByName(below).unionByName(both).groupBy("lang", "s1", "s2").agg(F.sum("value").alias("value"))


def audit_divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """lang, source, part, item, value, rank: distances to other sources (``pair``) and the terms that stand out (``term``)."""
    kept = term_counts(docs, least, width, depth)
    groups = stored(group_shares(docs, kept), "groups")
    named = kept.join(groups.withColumnRenamed("n", "whole"), ["lang", "source"])
    rows = named.select("lang", "source", "term", "b", share("n", "whole", "v").alias("p"), share("total", "ln", "v").alias("q"))
    rows = stored(rows, "shares", heavy=True)
    dropped(kept)
    pairs = _pairs(rows, groups)
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    terms = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("p - q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    out = stored(pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank"), "audit", heavy=True)
    dropped(rows, groups)
    return out
