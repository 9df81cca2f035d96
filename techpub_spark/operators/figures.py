"""Figures: declared hotspots, committed records, drift filter and figure chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id

#: Shape of a figure's identifier, cap of an image's bytes, and signs around a read token.
ICN_SHAPE, MOST_BYTES = "^ICN-[A-Z0-9][A-Z0-9-]{2,60}$", 4_000_000
TOKEN_SIGNS = r"^[.,;:()\[\]\"']+|[.,;:()\[\]\"']+$"


def declared(nodes: DataFrame, dms: DataFrame) -> DataFrame:
    """(package, dmc, icn, hotspots): per figure of a module its hotspots (id, label, part), sorted by id."""
    key = ["package", "file", "figure"]
    spots = nodes.where("tag = 'hotspot' and attrs['hotspotId'] <> ''").select(
        "package", "file", F.regexp_extract("xpath", r"^(.*/figure(?:\[[0-9]+\])?)/", 1).alias("figure"), F.col("attrs")["hotspotId"].alias("id"),
        F.trim("own_text").alias("label"), F.coalesce(F.col("attrs")["partNumberValue"], F.lit("")).alias("part")).where("figure <> ''")
    graphic = nodes.where("tag = 'graphic'").select("package", "file", F.regexp_extract("xpath", r"^(.*/figure(?:\[[0-9]+\])?)/graphic(?:\[[0-9]+\])?$", 1).alias("figure"), "node_id", F.coalesce(F.col("attrs")["infoEntityIdent"], F.lit("")).alias("icn"))
    graphic = graphic.where("figure <> ''").groupBy(*key).agg(F.min_by("icn", "node_id").alias("icn"))
    own = spots.join(graphic, key).where("icn <> ''").join(dms.select("package", "file", "dmc"), ["package", "file"])
    return own.groupBy("package", "dmc", "icn").agg(F.sort_array(F.collect_list(F.struct("id", "label", "part"))).alias("hotspots"))


def read_tokens(texts: Column) -> Column:
    """Whitespace tokens of an array of texts, commas as blanks, signs around a token stripped; a set."""
    raw = F.split(F.replace(F.array_join(texts, " "), F.lit(","), F.lit(" ")), r"\s+")
    return F.array_distinct(F.filter(F.transform(raw, lambda t: F.regexp_replace(t, TOKEN_SIGNS, "")), lambda t: t != ""))


def declared_map(hotspots: Column) -> Column:
    """Sorted ``id|label|part`` strings."""
    return F.array_sort(F.transform(hotspots, lambda h: F.concat_ws("|", h["id"], h["label"], h["part"])))


def map_digest(lines: Column) -> Column:
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def figure_text(icn: Column, hotspots: Column) -> Column:
    """Text of a figure from what is declared: one line, then one per hotspot by id."""
    def line(h: Column) -> Column:
        label = F.when(h["label"] != "", F.concat(F.lit(": "), h["label"])).otherwise("")
        part = F.when(h["part"] != "", F.concat(F.lit(" — part "), h["part"])).otherwise("")
        return F.concat(F.lit("Hotspot "), h["id"], label, part, F.lit("."))

    head = F.array(F.concat(F.lit("Figure "), icn, F.lit(".")))
    return F.array_join(F.concat(head, F.transform(F.sort_array(hotspots), line)), "\n")


def images(files: DataFrame) -> DataFrame:
    """(package, icn, sha256) of figure images; ``files``: package, folder, name, length, content.

    Only files named by a figure identifier, directly in the folder ``icn`` and under the size cap, are read.
    """
    icn = F.regexp_replace("name", r"\.png$", "")
    ok = files.where((F.col("folder") == "icn") & F.col("name").endswith(".png") & icn.rlike(ICN_SHAPE) & (F.col("length") <= MOST_BYTES))
    return ok.select("package", icn.alias("icn"), F.sha2("content", 256).alias("sha256"))


def figure_chunks(records: DataFrame, hotspots: DataFrame, pictures: DataFrame, strategy: str = "structure") -> DataFrame:
    """Chunks of verified records that still agree with module and image; any drift withholds the figure.

    ``records``: as ``sources.jsonl.figures`` reads them (or dmc and icn for source_dm and icn_id): sha256, declared_hotspots, described_hotspots, declared_map (arrays), verified;
    ``hotspots``: as ``declared`` gives them; ``pictures``: as ``images``.  If several packages hold the
    figure, the first by name counts.
    """
    records = records.withColumnsRenamed({"source_dm": "dmc", "icn_id": "icn"})
    now = records.where("verified").join(hotspots, ["dmc", "icn"]).join(pictures.withColumnRenamed("sha256", "now_sha"), ["package", "icn"])
    ids = F.array_sort(F.array_distinct(F.transform("hotspots", lambda h: h["id"])))
    lines = declared_map(F.col("hotspots"))
    same = (F.col("now_sha") == F.col("sha256")) & (ids == F.col("declared_hotspots")) & (ids == F.col("described_hotspots")) & (lines == F.col("declared_map"))
    first = now.where(same).withColumn("rn", F.row_number().over(Window.partitionBy("dmc", "icn").orderBy("package"))).where("rn = 1")
    path = F.concat(F.lit("figure/"), "icn")
    bound = F.concat(F.substring("sha256", 1, 8), F.substring(map_digest(lines), 1, 8))
    return first.select(
        chunk_id(F.col("dmc"), path, F.lit(strategy), bound).alias("chunk_id"), "package", "dmc", F.lit("figure").alias("chunk_type"), path.alias("source_path"), F.lit(strategy).alias("strategy"),
        figure_text(F.col("icn"), F.col("hotspots")).alias("text"), F.array("icn").alias("icn_refs"))


def figure_ref(chunk_type: Column, icn: Column, quote: Column) -> Column:
    """``[ICN-…, Hotspot n]`` if the quote names exactly one hotspot, else ``[ICN-…]``; null for other chunks."""
    ids = F.regexp_extract_all(quote, F.lit(r"(?i)\bHotspot\s+([A-Za-z0-9-]+)"), F.lit(1))
    named = F.when(F.size(ids) == 1, F.concat(F.lit("["), icn, F.lit(", Hotspot "), F.get(ids, 0), F.lit("]"))).otherwise(F.concat(F.lit("["), icn, F.lit("]")))
    return F.when((chunk_type == "figure") & icn.isNotNull(), named)
