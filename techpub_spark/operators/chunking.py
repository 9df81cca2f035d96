"""Chunking: fixed windows, semantic cuts, and structure chunks from the node table."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, sentences, squeeze
from .validation import references

SIZE, OVERLAP = 800, 100


def packed(text: str, size: int, overlap: int) -> list[str]:
    """Windows of a squeezed text, each found by two searches in the places of its words."""
    words = [w[i : i + size] for w in text.split(" ") if w for i in range(0, len(w), size)]
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))  # a word's first place is the end of the one before
    joined, out, first, last = " ".join(words), [], 0, 0
    while last < len(words):
        last = bisect_right(ends, ends[first] + size + 1, last + 1) - 1
        out.append(joined[ends[first] : ends[last] - 1])
        if last < len(words):
            room = min(overlap, size - len(words[last]) - 1)
            first = min(bisect_left(ends, ends[last] - 1 - room, first), last)
    return out


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of whole words: greedy packing to ``size`` characters; the next window starts with the trailing
    words of the last that total at most ``overlap``.  A word longer than a window is cut."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else packed(t, size, overlap) for t in (x.as_py() for x in texts)], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # types, not their names
    return F.arrow_udf(run, "array<string>")(squeeze(text))


def recursive_chunks(dms: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(dmc, chunk_id, source_path, text, seq) for ``dms``: dmc, text, digest."""
    each = dms.select("dmc", "digest", F.posexplode(windows(F.col("text"), size, overlap)).alias("seq", "text"))
    path = F.concat(F.lit("#win"), F.col("seq").cast("string"))
    return each.select("dmc", chunk_id(F.col("dmc"), path, F.lit("recursive"), F.col("digest")).alias("chunk_id"), path.alias("source_path"), "text", "seq")


def semantic_chunks(units: DataFrame, p: float = 0.95) -> DataFrame:
    """Cut where the distance to the next sentence reaches the document's ``p`` percentile.

    ``units``: dmc, pos, sentence, vec (normalised).  Fewer than four sentences make one chunk.
    """
    from ..functions.text import dot

    w = Window.partitionBy("dmc").orderBy("pos")
    gap = units.withColumn("next", F.lead("vec").over(w)).withColumn("distance", F.when(F.col("next").isNotNull(), 1 - dot(F.col("vec"), F.col("next"))))
    cut = gap.groupBy("dmc").agg(F.percentile("distance", p).alias("limit"), F.count("*").alias("n"))
    marked = gap.join(cut, "dmc").withColumn("cut", ((F.col("n") >= 4) & (F.col("distance") >= F.col("limit"))).cast("int"))
    part = marked.withColumn("seq", F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.groupBy("dmc", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def sentence_units(dms: DataFrame) -> DataFrame:
    return dms.select("dmc", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


_AT = r"(\[[0-9]+\])?"
_PROCEDURE = "/dmodule/content/procedure/"
#: Chunk type and path of the elements that make a chunk.
BOUNDARIES = (
    ("precondition", rf"^{_PROCEDURE}preliminaryRqmts{_AT}/(reqCondGroup|reqSupportEquips){_AT}$"),
    ("warning", rf"^{_PROCEDURE}preliminaryRqmts{_AT}/reqSafety{_AT}/safetyRqmts{_AT}/warning{_AT}$"),
    ("caution", rf"^{_PROCEDURE}preliminaryRqmts{_AT}/reqSafety{_AT}/safetyRqmts{_AT}/caution{_AT}$"),
    ("step", rf"^{_PROCEDURE}mainProcedure{_AT}/(.*/)?proceduralStep{_AT}$"),
    ("closeout", rf"^{_PROCEDURE}closeRqmts{_AT}/reqCondGroup{_AT}$"),
    ("fault", rf"^/dmodule/content/(.*/)?(faultIsolation{_AT}/faultDescription|isolationStep){_AT}$"),
    ("description", rf"^/dmodule/content/description/levelledPara{_AT}$"),
    ("ipd", r"^/dmodule/content/illustratedPartsCatalog$"),
)


def structure_chunks(nodes: DataFrame, dms: DataFrame) -> DataFrame:
    """Chunks at element boundaries; a description without paragraphs is one chunk, and so is the content of a
    module of another kind.  The text of parts data ends with its part numbers, which stand in attributes.

    ``nodes``: the node table; ``dms``: package, file, dmc, dm_title, digest.  Adds the figures (``icn_refs``) and
    modules (``dm_refs``) that an element names.
    """
    key = ["package", "file"]
    body = nodes.where("xpath like '/dmodule/content%'")
    kind = F.coalesce(*[F.when(F.col("xpath").rlike(p), F.lit(k)) for k, p in BOUNDARIES])
    hit = body.withColumn("chunk_type", kind).where("chunk_type is not null")
    flat = body.where("xpath = '/dmodule/content/description'").join(hit.where("chunk_type = 'description'").select(*key), key, "left_anti").withColumn("chunk_type", F.lit("description"))
    hit = hit.unionByName(flat)
    whole = body.where("xpath = '/dmodule/content'").join(hit.select(*key), key, "left_anti").withColumn("chunk_type", F.lit("dm"))
    hit = hit.unionByName(whole).select(*key, "chunk_type", F.col("xpath").alias("source_path"), "text", F.col("node_id").alias("seq"))
    # an attribute belongs to every chunk whose element is one of its ancestors: an equi-join on the ancestors' paths
    steps = F.filter(F.split("xpath", "/"), lambda x: x != "")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))
    refs = references(body).select(*key, "ref", "dmc").withColumnRenamed("ref", "node_id")
    named = body.where("tag = 'dmRefIdent'").join(refs, [*key, "node_id"]).select(*key, "node_id", F.explode(up).alias("source_path"), F.col("dmc").alias("dm"), F.lit(None).cast("string").alias("icn"), F.lit(None).cast("string").alias("part"))
    marks = body.where("(tag = 'graphic' and attrs['infoEntityIdent'] <> '') or (tag = 'partRef' and attrs['partNumberValue'] <> '')").select(
        *key, "node_id", F.explode(up).alias("source_path"), F.lit(None).cast("string").alias("dm"),
        F.when(F.col("tag") == "graphic", F.col("attrs")["infoEntityIdent"]).alias("icn"), F.when(F.col("tag") == "partRef", F.col("attrs")["partNumberValue"]).alias("part"))
    per = named.unionByName(marks).join(hit.select(*key, "source_path"), [*key, "source_path"], "left_semi").groupBy(*key, "source_path").agg(
        F.sort_array(F.collect_set("dm")).alias("dm_refs"), _in_order("icn").alias("icn_refs"), _in_order("part").alias("parts"))
    none = F.array().cast("array<string>")
    own = hit.join(per, [*key, "source_path"], "left").join(dms.select(*key, "dmc", "dm_title", "digest"), key)
    folded = F.when((F.col("chunk_type") == "ipd") & (F.size(F.coalesce("parts", none)) > 0), F.concat_ws(" ", "text", F.array_join("parts", " "))).otherwise(F.col("text"))
    out = own.select(*key, "dmc", "dm_title", "digest", "chunk_type", "source_path", folded.alias("text"), F.coalesce("icn_refs", none).alias("icn_refs"), F.coalesce("dm_refs", none).alias("dm_refs"), "seq")
    return out.withColumn("strategy", F.lit("structure")).withColumn("chunk_id", chunk_id(F.col("dmc"), F.col("source_path"), F.col("strategy"), F.col("digest")))


def _in_order(col: str) -> Column:
    """The values of ``col`` in document order."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("node_id", col)))), lambda x: x[col])


def indexed_text(text: Column, dmc: Column, icn_refs: Column, dm_refs: Column) -> Column:
    """What the lexical index reads: a chunk's text and the identifiers that belong to it."""
    return F.concat_ws(" ", text, dmc, F.array_join(icn_refs, " "), F.array_join(dm_refs, " "))


def dedupe(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id; reading fails if one (dmc, source_path) has two ids."""
    one = chunks.groupBy("chunk_id").agg(*[F.min_by(c, F.struct("seq", "package") if "package" in chunks.columns else F.col("seq")).alias(c) for c in chunks.columns if c != "chunk_id"])
    n = F.count("*").over(Window.partitionBy("dmc", "source_path", "strategy"))
    return one.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two chunks at "), "source_path"))).otherwise(F.lit(True))).drop("__n")
