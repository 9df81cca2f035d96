"""Chunk store: idempotent feed, delete, count, ids and manifest over partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = "^[A-Za-z0-9._-]+$"


def feed(chunks: DataFrame, path: str) -> None:
    """Replace the packages that ``chunks`` holds; equal ids are one row; a bad name or missing vector is refused."""
    bad = ~F.coalesce(F.col("package").rlike(PACKAGE), F.lit(False))
    if "embedding" in chunks.columns:
        bad = bad | F.col("embedding").isNull()
    checked = chunks.where(F.when(bad, F.raise_error(F.lit("bad package name or missing vector"))).otherwise(F.lit(True)))
    checked.dropDuplicates(["chunk_id"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").parquet(path)


def load(spark: SparkSession, path: str, package: str | None = None, strategy: str | None = None) -> DataFrame:
    """Stored chunks; the package prunes partitions and the strategy is pushed to the scan."""
    df = spark.read.parquet(path)
    df = df.where(F.col("package") == package) if package else df
    return df.where(F.col("strategy") == strategy) if strategy else df


def delete(spark: SparkSession, path: str, ids: DataFrame, to: str) -> None:
    """Write what is left without ``ids`` (chunk_id) to a new folder; the caller swaps folders."""
    spark.read.parquet(path).join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti").write.mode("overwrite").partitionBy("package").parquet(to)


def manifest(chunks: DataFrame, strategy: str, provider: str) -> DataFrame:
    """One row: packages, strategy, provider, number of chunks and an order-free digest of the ids."""
    bits = F.conv(F.substring(F.sha2("chunk_id", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return chunks.agg(F.sort_array(F.collect_set("package")).alias("packages"), F.count_distinct("chunk_id").alias("n_chunks"), F.sum(bits).alias("ids_digest")).select("packages", F.lit(strategy).alias("strategy"), F.lit(provider).alias("provider"), "n_chunks", "ids_digest")


def schema_digest(df: DataFrame) -> str:
    """First 16 hex digits over the schema."""
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]
