"""JSON sources and sinks: golden queries, adversarial cases, owner maps, figure records, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "query_id string, query string, category string, relevant array<struct<dmc:string,source_path:string>>"
CASE = "id string, category string, question string, expected_behavior string, anchor struct<must_cite_dmc:array<string>,must_state:array<string>,must_not_state:array<string>>"
#: Fields of a figure record; all but the last must be there.
FIGURE = "icn_id string, source_dm string, png_path string, sha256 string, declared_hotspots array<string>, described_hotspots array<string>, part_numbers array<string>, declared_map array<string>, summary string, safety_warnings array<string>, hotspots_matched boolean, corroborated boolean, verified boolean, degraded_reason string"
TRACE_VERSIONS = (1, 2)


def _lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...]) -> DataFrame:
    """Strict JSON lines: blank lines and ``#`` comments are skipped, a malformed line or missing key fails the read."""
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    bad = F.lit(False)
    for key in required:
        bad = bad | F.col(f"r.{key}").isNull()
    return text.select("value", row.alias("r")).where(F.when(F.col("r").isNull() | bad, F.raise_error(F.concat(F.lit("malformed line: "), F.substring("value", 1, 80)))).otherwise(F.lit(True))).select("r.*")


def golden(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, GOLDEN, ("query_id", "query", "relevant"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, CASE, ("id", "question", "expected_behavior"))


def owner_map(spark: SparkSession, text: str | None) -> tuple[DataFrame, str]:
    """(system, owner) and a state: ``present``, ``missing`` or ``unreadable``; never raises."""
    one = spark.createDataFrame([(text,)], "v string").select(F.from_json("v", "by_system map<string,string>").alias("m"))
    rows = one.select(F.explode("m.by_system").alias("system", "owner"))
    state = "missing" if text is None else "present" if one.where("m.by_system is not null").count() else "unreadable"
    return rows, state


def figures(spark: SparkSession, path: str) -> DataFrame:
    """Figure records, one JSON document a file; an unknown field is refused, and reading fails where a field is missing."""
    names = [f.split()[0] for f in FIGURE.split(", ")]
    files = lambda: spark.read.option("multiLine", "true").option("recursiveFileLookup", "true")
    seen = set(files().json(path).columns)
    if extra := seen - set(names) - {"_corrupt_record"}:
        raise ValueError(f"unknown fields: {sorted(extra)}")
    rows = files().schema(FIGURE).option("mode", "FAILFAST").json(path)
    lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names[:-1]]))
    whole = rows.where(F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("a figure record lacks "), F.array_join(lacking, ", ")))).otherwise(F.lit(True)))
    return whole.fillna("", ["degraded_reason"])


def write_figures(records: DataFrame, path: str) -> None:
    """Figure records as one JSON document each, in a folder per figure; the records that are there are replaced."""
    folder = F.concat(F.regexp_replace("icn_id", r"[^A-Za-z0-9._-]", "_"), F.lit("@"), F.substring(F.sha2("source_dm", 256), 1, 8))
    out = records.select(*[f.split()[0] for f in FIGURE.split(", ")], folder.alias("record"))
    out.repartition("record").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1).partitionBy("record").json(path)


def write_partitioned_json(df: DataFrame, path: str, by: str) -> None:
    """One folder per value of ``by``; names are made path-safe first."""
    df.withColumn(by, F.regexp_replace(by, r"[^A-Za-z0-9._-]", "_")).write.mode("overwrite").partitionBy(by).json(path)


def write_traces(df: DataFrame, path: str, version: int = TRACE_VERSIONS[-1]) -> None:
    df.select(F.lit(version).alias("version"), F.struct(*df.columns).alias("trace")).write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Traces of known versions; an unknown version fails the read."""
    raw = spark.read.schema(f"version int, trace struct<{schema}>").json(path)
    return raw.where(F.when(~F.coalesce(F.col("version").isin(*TRACE_VERSIONS), F.lit(False)), F.raise_error(F.lit("unknown trace version"))).otherwise(F.lit(True))).select("version", "trace.*")
