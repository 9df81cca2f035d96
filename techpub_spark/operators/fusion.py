"""Rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, ARM_DEPTH = 60, 20


def rrf(arms: list[DataFrame], k: int | None = None, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``arms`` (query_id, rank, id): sum of weight / (constant + rank), equal weights.

    Ties go to what appears first in arm order; a row's first arm and rank there survive.
    """
    weight = 1.0 / len(arms)
    rows = reduce(DataFrame.unionByName, [a.select("query_id", "id", F.lit(i).alias("arm"), F.col("rank").cast("int").alias("rank")) for i, a in enumerate(arms)])
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(weight) / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("arm", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first.arm", "first.rank", "id")
    out = fused.withColumn("rank", F.row_number().over(w))
    return (out.where(F.col("rank") <= k) if k is not None else out).select("query_id", "rank", "score", "id", F.col("first.arm").alias("arm"))


def rerank(candidates: DataFrame, texts: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], k: int = 5) -> DataFrame:
    """Score (query, text) pairs by a pluggable model; top ``k`` by score, stable on candidate order.

    ``candidates``: query_id, query, rank, id; ``texts``: id, text.
    """
    pairs = candidates.join(texts, "id").select("query_id", "query", "rank", "id", "text")
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "id")}

    def run(batches):
        for pdf in batches:
            pdf["score"] = [float(s) for s in scorer(list(zip(pdf["query"], pdf["text"], strict=True)))]
            yield pd.DataFrame(pdf[["query_id", "rank", "id", "score"]])

    scored = pairs.mapInPandas(run, f"query_id {kinds['query_id']}, rank int, id {kinds['id']}, score double").withColumnRenamed("rank", "was")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "was")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "score", "id")


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """Deterministic stand-in for a cross-encoder: share of the query's words in the text."""
    out = []
    for q, t in pairs:
        a, b = set((q or "").lower().split()), set((t or "").lower().split())
        out.append(len(a & b) / max(1, len(a)))
    return out
