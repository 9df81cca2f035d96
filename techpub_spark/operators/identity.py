"""Identity and set operations: byte-equal copies, duplicate issues, conflicts, multiset differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_copies(rows: DataFrame, digest: Column, order_col: str) -> DataFrame:
    """One row per digest: the smallest ``order_col``.  An aggregate, so a digest with very many rows is pre-aggregated."""
    cols = [c for c in rows.columns if c != order_col]
    packed = rows.withColumn("__d", digest).groupBy("__d").agg(F.min(order_col).alias(order_col), F.min_by(F.struct(*cols), order_col).alias("__r") if cols else F.lit(None).alias("__r"))
    return packed.select(order_col, *[F.col(f"__r.{c}").alias(c) for c in cols], F.col("__d").alias("digest"))


def duplicate_issues(rows: DataFrame, key: str, issue: str, order_col: str) -> DataFrame:
    """Findings on copies of a key (key, issue, order_col, verdict): a copy whose issue equals that of the copy
    before it in issue order conflicts (XREF-006); the newest copy, if strictly newer than the oldest, supersedes
    the others (XREF-007, once a key).  Non-numeric issues sort before numeric ones.
    """
    place = F.struct(F.coalesce(F.expr(f"try_cast({issue} as int)"), F.lit(-1)).alias("n"), F.col(issue).cast("string").alias("s"))
    cols = rows.select(key, issue, order_col, place.alias("place"))
    again = cols.withColumn("before", F.lag("place").over(Window.partitionBy(key).orderBy("place", order_col))).where("before = place")
    ends = cols.groupBy(key).agg(F.min("place").alias("oldest"), F.max(F.struct("place", order_col, issue)).alias("newest"))
    newer = ends.where(F.col("newest.place") > F.col("oldest")).select(key, f"newest.{issue}", f"newest.{order_col}", F.lit("XREF-007").alias("verdict"))
    return again.select(key, issue, order_col, F.lit("XREF-006").alias("verdict")).unionByName(newer)


def newest(rows: DataFrame, key: str, issue: str, order_col: str) -> DataFrame:
    """The copy that enters the index: the last in issue order."""
    number = F.coalesce(F.expr(f"try_cast({issue} as int)"), F.lit(-1))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(number, F.col(issue).cast("string"), F.col(order_col))).alias("r")).select(key, "r.*")


def conflicts(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Keys with more than one distinct id."""
    return rows.groupBy(*keys).agg(F.count_distinct(id_col).alias("n_ids"), F.min(id_col).alias("first_id")).where("n_ids > 1")


def multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed and rows added, with multiplicity."""
    gone = before.exceptAll(after).withColumn("side", F.lit("removed"))
    return gone.unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def set_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Symmetric difference of two key sets: key, side."""
    a, b = left.select(F.col(key).alias("a")).distinct(), right.select(F.col(key).alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a is null or b is null").select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def verify_sets(local: DataFrame, engine: DataFrame, key: str) -> DataFrame:
    """``local``, or an error when it is read if the two key sets differ (fail closed).  The error names the first five."""
    bad = set_compare(local, engine, key).select(F.concat_ws(":", "side", F.col(key).cast("string")).alias("some"))
    few = bad.orderBy("some").limit(5).agg(F.array_join(F.sort_array(F.collect_list("some")), ", ").alias("some"))  # one row
    return local.crossJoin(F.broadcast(few)).where(F.when(F.col("some") != "", F.raise_error(F.concat(F.lit("corpus differs: "), "some"))).otherwise(F.lit(True))).drop("some")
