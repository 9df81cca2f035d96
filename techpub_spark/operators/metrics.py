"""Evaluation: retrieval metrics, agreement, rates and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ideal(depth: int) -> Column:
    """The gain of ``total`` anchors in the first places, down to ``depth``."""
    return F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(depth)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 1))


def per_query(ranked: DataFrame, anchors: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query with anchors: recall at each k, reciprocal rank, nDCG at the largest k.

    ``ranked``: query_id, rank, id; ``anchors``: query_id, anchor, id (null where the anchor maps to no
    chunk; it stays in the denominator).  Recall counts anchors covered.  nDCG walks the ranks; each
    position credits at most one anchor that no earlier one credited, the lowest first.
    """
    depth = max(ks)
    total = anchors.groupBy("query_id").agg(F.count_distinct("anchor").alias("total"))
    hits = ranked.where(F.col("rank") <= max(depth, 10)).join(anchors.where("id is not null"), ["query_id", "id"]).select("query_id", "rank", "anchor")
    best = hits.groupBy("query_id", "anchor").agg(F.min("rank").alias("rank"))
    cover = best.groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"covered_{k}") for k in ks])
    walk = hits.where(F.col("rank") <= depth).groupBy("query_id", "rank").agg(F.collect_set("anchor").alias("anchors")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "anchors"))).alias("walk"))
    kind = f"array<{anchors.schema['anchor'].dataType.simpleString()}>"
    start = F.struct(F.array().cast(kind).alias("seen"), F.lit(0.0).alias("dcg"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array_min(F.array_except(x["anchors"], acc["seen"]))
        return F.when(new.isNull(), acc).otherwise(F.struct(F.array_append(acc["seen"], new).cast(kind).alias("seen"), (acc["dcg"] + 1 / F.log2(x["rank"].cast("double") + 1)).alias("dcg")))

    joined = total.join(cover, "query_id", "left").join(walk, "query_id", "left")
    return joined.select(
        "query_id", *[(F.coalesce(f"covered_{k}", F.lit(0)) / F.col("total")).alias(f"recall_{k}") for k in ks],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.coalesce(F.aggregate("walk", start, step, lambda a: a["dcg"]), F.lit(0.0)) / _ideal(depth)).alias("ndcg"),
    )


def per_query_of_rows(ranked: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """As ``per_query``, where every anchor is one row of the corpus: then its number and the hits are enough.

    ``ranked``: query_id, rank, relevant (whether the row is an anchor); ``totals``: query_id, total (anchors).  What is
    grouped is the ranked rows; the anchors, which may be a share of the corpus for each query, are never listed.
    """
    depth = max(ks)
    place = F.col("rank").cast("double")
    hits = ranked.where("relevant").where(F.col("rank") <= max(depth, 10)).groupBy("query_id").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= depth, 1 / F.log2(place + 1))).alias("dcg"), *[F.count_if(F.col("rank") <= k).alias(f"covered_{k}") for k in ks])
    return totals.where("total > 0").join(hits, "query_id", "left").select(
        "query_id", *[(F.coalesce(f"covered_{k}", F.lit(0)) / F.col("total")).alias(f"recall_{k}") for k in ks],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / _ideal(depth)).alias("ndcg"))


def summary(per: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means over answerable queries, rounded to 4 places; the denominator is every query with anchors."""
    return per.agg(F.count("*").alias("n"), *[F.round(F.avg(f"recall_{k}"), 4).alias(f"recall_{k}") for k in ks], F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"))


def zero_hit_rate(traps: DataFrame, ranked: DataFrame) -> DataFrame:
    """Share of no-answer queries for which nothing was found."""
    found = ranked.select("query_id").distinct().withColumn("hit", F.lit(1))
    return traps.join(found, "query_id", "left").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("hit").isNull()) / F.greatest(F.count("*"), F.lit(1)), 4).alias("zero_hit_rate"))


def upper_median(value: Column) -> Column:
    """The element at n div 2 of the sorted values, by rank and not by interpolation: rank (n div 2) + 1."""
    return F.element_at(F.sort_array(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and agreement of two 0/1 columns; null where a side has one class only."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    c = both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    flat = F.col("pa").isin(0.0, 1.0) | F.col("pb").isin(0.0, 1.0)
    return c.select("n", F.round("po", 4).alias("agreement"), F.when(~flat, F.round((F.col("po") - pe) / (1 - pe), 4)).alias("kappa"))


def votes(rows: DataFrame, judges: list[str]) -> DataFrame:
    """Per-judge groundedness (an error counts as not grounded), intersection over judged rows, disagreement."""
    usable = F.array(*[F.when(F.col(j).isin("grounded", "hallucinated"), F.col(j)) for j in judges])
    every = F.when(F.size(F.array_compact(F.array(*[F.col(j) for j in judges]))) > 0, F.forall(F.array_compact(F.array(*[F.col(j) for j in judges])), lambda v: v == "grounded"))
    return rows.agg(
        *[F.round(F.avg((F.col(j) == "grounded").cast("double")), 4).alias(f"grounded_{j}") for j in judges], *[F.count_if(F.col(j) == "error").alias(f"errors_{j}") for j in judges],
        F.round(F.avg(every.cast("double")), 4).alias("intersection"), F.count_if(F.size(F.array_distinct(F.array_compact(usable))) > 1).alias("disagreements"),
    )
