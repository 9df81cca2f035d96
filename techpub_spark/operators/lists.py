"""Publication modules and data module lists as tables of their own, with their entries in order, and the lookup of a module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import validation

KEY = ["package", "file"]


def _date(attrs: Column) -> Column:
    """A date from year, month and day; null where they are none."""
    part = lambda k: F.element_at(attrs, k).try_cast("int").cast("string")
    return F.try_to_date(F.concat_ws("-", F.lpad(part("year"), 4, "0"), F.lpad(part("month"), 2, "0"), F.lpad(part("day"), 2, "0")), "yyyy-MM-dd")


def _heads(nodes: DataFrame, prefix: str, root: str, code: str, names: dict[str, str]) -> DataFrame:
    """One row per file of a kind: the attributes of its code, issue, and date."""
    own = nodes.where("error is null").where(F.upper("file").startswith(prefix))
    base = f"/{root}/identAndStatusSection/{root}Address/{root}"
    at = lambda path, value: F.max(F.when(F.col("xpath") == base + path, value))
    attr = lambda path, name: at(path, F.element_at("attrs", name))
    return own.groupBy(*KEY).agg(
        *[F.coalesce(attr(f"Ident/{code}", a), F.lit("")).alias(n) for n, a in names.items()],
        attr("Ident/issueInfo", "issueNumber").alias("issue_number"), attr("Ident/issueInfo", "inWork").alias("in_work"),
        at("AddressItems/issueDate", _date(F.col("attrs"))).alias("issue_date"), F.coalesce(at(f"AddressItems/{root}Title", F.col("text")), F.lit("")).alias("title"),
    )


def publications(nodes: DataFrame) -> DataFrame:
    """package, file, model, issuer, number, volume, issue_number, in_work, issue_date (null if it is none), title of each PMC file."""
    return _heads(nodes, "PMC-", "pm", "pmCode", {"model": "modelIdentCode", "issuer": "pmIssuer", "number": "pmNumber", "volume": "pmVolume"})


def module_lists(nodes: DataFrame) -> DataFrame:
    """package, file, model, sender, type, year, seq, issue_number, in_work, issue_date of each DML file."""
    return _heads(nodes, "DML-", "dml", "dmlCode", {"model": "modelIdentCode", "sender": "senderIdent", "type": "dmlType", "year": "yearOfDataIssue", "seq": "seqNumber"}).drop("title")


def publication_entries(nodes: DataFrame) -> DataFrame:
    """References of publications in order: package, file, entry (from 1; 0 outside any), title, depth, place, dmc, issue_number, line.

    An entry may hold others; a reference belongs to the innermost one around it, and ``place`` counts there.
    """
    own = nodes.where("error is null").where(F.upper("file").startswith("PMC-"))
    entry = own.where("tag = 'pmEntry'").select(*KEY, F.col("node_id").alias("e"), F.col("last_id").alias("to"), "depth")
    entry = entry.withColumn("entry", F.row_number().over(Window.partitionBy(*KEY).orderBy("e")))
    title = own.where("tag = 'pmEntryTitle'").groupBy(*KEY, F.col("parent_id").alias("e")).agg(F.min_by("text", "node_id").alias("title"))
    entry = entry.join(title, [*KEY, "e"], "left")
    refs = validation.references(own)
    inside = refs.alias("r").join(entry.alias("e"), (F.col("r.package") == F.col("e.package")) & (F.col("r.file") == F.col("e.file")) & (F.col("ref") > F.col("e")) & (F.col("ref") <= F.col("to")), "left")
    inner = inside.groupBy("r.package", "r.file", "ref", "r.dmc", "r.issue_number", "r.line").agg(F.max(F.struct("depth", "entry", "title")).alias("at"))
    w = Window.partitionBy(*KEY, "entry").orderBy("ref")
    out = inner.select(*KEY, "ref", F.coalesce("at.entry", F.lit(0)).alias("entry"), "at.title", "at.depth", "dmc", "issue_number", "line")
    return out.withColumn("place", F.row_number().over(w)).select(*KEY, "entry", "title", "depth", "place", "dmc", "issue_number", "line")


def list_entries(nodes: DataFrame) -> DataFrame:
    """References of data module lists in order: package, file, place (from 1), dmc, issue_number, line."""
    refs = validation.references(nodes.where("error is null").where(F.upper("file").startswith("DML-")))
    return refs.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy("ref"))).select(*KEY, "place", "dmc", "issue_number", "line")


def normal_code(asked: Column) -> Column:
    """Upper case, with the prefix that a user may leave out."""
    wanted = F.upper(F.trim(asked))
    return F.when(wanted.startswith("DMC-"), wanted).otherwise(F.concat(F.lit("DMC-"), wanted))


def lookup(nodes: DataFrame, findings: DataFrame, asked: DataFrame) -> DataFrame:
    """Modules by their codes as users write them (``asked``): asked, dmc, package, file, dm_title, issue_number, content_type, referrers, findings.

    A code that no module has gives one row without a file; one that several files have gives a row for each.
    """
    dms = validation.data_modules(nodes.where("error is null"))
    n = findings.groupBy(*KEY).agg(F.count("*").alias("findings"))
    full = dms.join(validation.inbound(nodes.where("error is null"), dms).drop("n"), ["package", "dmc"]).join(n, KEY, "left")
    out = asked.select("asked", normal_code(F.col("asked")).alias("dmc")).distinct().join(full, "dmc", "left")
    return out.select("asked", "dmc", "package", "file", "dm_title", "issue_number", "content_type", "referrers", F.when(F.col("file").isNotNull(), F.coalesce("findings", F.lit(0))).alias("findings"))
