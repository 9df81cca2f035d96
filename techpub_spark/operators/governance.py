"""Governance predicates: applicability, clearance, gaps, owners, citation status, refusal routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DMC_PATTERN, sns_system

#: The closed vocabulary of classifications, lowest first.
LADDER = ("01", "02", "03", "04", "05")


def value_matches(asked: Column, values: Column) -> Column:
    """``values``: comma list of exact values and inclusive integer ranges ``lo~hi``; a non-numeric range never matches."""
    whole = lambda c: F.when(F.trim(c).rlike("^[+-]?[0-9]+$"), F.trim(c).try_cast("long"))

    def hit(t: Column) -> Column:
        lo, hi = F.get(F.split(t, "~"), 0), F.get(F.split(t, "~"), 1)
        inside = (whole(asked) >= whole(lo)) & (whole(asked) <= whole(hi))
        return F.when(F.contains(t, F.lit("~")), F.coalesce(inside, F.lit(False))).otherwise(t == F.trim(asked))

    return F.coalesce(F.exists(F.transform(F.split(values, ","), lambda t: F.trim(t)), hit), F.lit(False))


def applies(asserts: Column, context: dict[str, str]) -> Column:
    """``asserts``: array of structs (property_ident, values).  Each context key must match if the row asserts it."""
    ok = F.lit(True)
    for prop, value in context.items():
        mine = _of(asserts, prop)
        ok = ok & (asserts.isNull() | (F.size(mine) == 0) | F.exists(mine, _matcher(value)))
    return ok


def _of(asserts: Column, prop: str) -> Column:
    return F.filter(asserts, lambda a: a["property_ident"] == prop)


def _matcher(value: str):
    return lambda a: value_matches(F.lit(value), a["values"])


def normal_clearance(clearance: str | None) -> str | None:
    """A clearance of the ladder, or an error."""
    if clearance is None:
        return None
    c = clearance.strip()
    if c not in LADDER:
        raise ValueError(f"unknown clearance {clearance!r}")
    return c


def withheld_reason(label: Column, clearance: str | None) -> Column:
    """Null if a row may be shown; without a clearance nothing is withheld and nothing is claimed."""
    c = normal_clearance(clearance)
    if c is None:
        return F.lit(None).cast("string")
    l = F.trim(F.coalesce(label, F.lit("")))
    return F.when(l == "", "unlabelled").when(~l.isin(*LADDER), "unknown label").when(l > c, "above clearance")


def partition(chunks: DataFrame, label_col: str, clearance: str | None) -> tuple[DataFrame, DataFrame]:
    """(admitted, withheld with ``reason``)."""
    marked = chunks.withColumn("reason", withheld_reason(F.col(label_col), clearance))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def assert_uniform(chunks: DataFrame, label_col: str, clearance: str | None) -> DataFrame:
    """``chunks``; reading it fails if labels are mixed and no clearance scopes the request."""
    if clearance is not None:
        return chunks
    n = chunks.agg(F.count_distinct(F.trim(F.coalesce(F.col(label_col), F.lit("")))).alias("__labels"))
    return chunks.crossJoin(F.broadcast(n)).where(F.when(F.col("__labels") > 1, F.raise_error(F.lit("mixed classifications need a clearance"))).otherwise(F.lit(True))).drop("__labels")


def assert_admissible(chunks: DataFrame, label_col: str, clearance: str | None) -> DataFrame:
    """``chunks``; reading it fails at the first row that should have been withheld."""
    bad = withheld_reason(F.col(label_col), clearance).isNotNull()
    return chunks.where(F.when(bad, F.raise_error(F.lit("withheld row in an admitted set"))).otherwise(F.lit(True)))


def redacted(neighbours: Column, admitted: Column) -> tuple[Column, Column]:
    """(admitted neighbours, number withheld): repeats and order are kept."""
    kept = F.filter(neighbours, lambda x: F.array_contains(admitted, x))
    return kept, F.size(neighbours) - F.size(kept)


def gaps(declared: DataFrame, own: DataFrame, admitted: DataFrame) -> DataFrame:
    """Declarations without a target, with the ``kind`` of gap.

    ``declared``: package, owner_admitted, dmc, ...; ``own``: package, dmc of every package; ``admitted``: dmc of the
    admitted ones.  A declaration is met by its own package, and an admitted one by any admitted package.
    """
    here = own.select("package", "dmc").distinct()
    left = declared.join(here, ["package", "dmc"], "left_anti")
    open_ = left.where("owner_admitted").join(admitted.select("dmc").distinct(), "dmc", "left_anti").select(*declared.columns, F.lit("declared, admitted").alias("kind"))
    shut = left.where(~F.col("owner_admitted")).select(*declared.columns, F.lit("declared, before admission").alias("kind"))
    return open_.unionByName(shut)


def with_owner(rows: DataFrame, owners: DataFrame, dmc_col: str = "dmc") -> DataFrame:
    """Owner of a code's system: owner, or the reason why there is none.  ``owners``: system, owner (one row each)."""
    o = owners.groupBy("system").agg(F.max("owner").alias("owner"))
    out = rows.withColumn("system", sns_system(F.col(dmc_col))).join(o, "system", "left")
    why = F.when(F.col("owner").isNotNull(), F.lit(None)).when(F.col("system").isNull(), "no system in code").otherwise("system has no owner")
    return out.withColumn("owner_reason", why)


def citation_status(cited: DataFrame, registry: DataFrame) -> DataFrame:
    """``cited``: dmc, issue; ``registry``: dmc, issue, seq (the last registration wins)."""
    last = registry.groupBy("dmc").agg(F.max_by("issue", "seq").alias("registered"), F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "unregistered").when(F.col("issue").isNull() | F.col("registered").isNull(), "unknown").when(F.col("issue") == F.col("registered"), "current").otherwise("superseded")
    return cited.join(last, "dmc", "left").select(*cited.columns, "registered", status.alias("status"))


#: What would resolve a refusal, by the gate that refused.
RESOLUTIONS = {
    "threshold": "add a data module on this topic and index again, or confirm that the publication does not cover it",
    "llm": "add a data module that states the answer and index again",
    "llm-contract": "a fault of the service, not of the corpus: look at the model endpoint and ask again",
    "citation-validation": "nothing for a subject expert; if it recurs, look at the prompt or the model",
    "figure-out-of-description": "describe the figure again, or state the detail in the text of a data module",
}


def route_refusals(questions: DataFrame, gaps_: DataFrame) -> DataFrame:
    """What would resolve each refusal, and who owns it.

    ``questions``: query_id, gate, question; ``gaps_``: signature, kind (as ``gaps`` names it), owner, owner_reason.
    The first code in the question that is a gap of an admitted package gives code, owner and owner_reason (of equal
    signatures, the smallest owner).  Otherwise the owner is null and owner_reason is one of three: no code is named,
    a named one is a gap before admission only (the smallest), or no named one is a gap (the first).
    """
    codes = questions.select("query_id", F.posexplode(F.regexp_extract_all(F.upper("question"), F.lit(DMC_PATTERN), F.lit(0))).alias("pos", "code"))
    known = gaps_.groupBy(F.upper("signature").alias("code")).agg(
        F.min(F.when(F.col("kind") == "declared, admitted", F.struct(F.col("owner").isNull(), "owner", "owner_reason", "signature"))).alias("admitted"),
        F.max((F.col("kind") == "declared, before admission").cast("int")).alias("shut"),
    )
    named = codes.join(known, "code", "left").groupBy("query_id").agg(
        F.min(F.when(F.col("admitted").isNotNull(), F.struct("pos", "admitted"))).alias("hit"),
        F.min(F.when(F.col("shut") == 1, F.col("code"))).alias("shut"),
        F.min_by("code", "pos").alias("first"),
    )
    hit = F.col("hit.admitted")
    why = (
        F.when(F.col("first").isNull(), "the question names no module code")
        .when(hit.isNotNull(), hit["owner_reason"])
        .when(F.col("shut").isNotNull(), F.concat(F.col("shut"), F.lit(" is a gap of a package that was not admitted, whose owners do not count")))
        .otherwise(F.concat(F.col("first"), F.lit(" is not a gap")))
    )
    resolution = F.coalesce(F.create_map(*[F.lit(x) for pair in RESOLUTIONS.items() for x in pair])[F.col("gate")], F.concat(F.lit("no resolution is known for gate "), F.col("gate")))
    return questions.join(named, "query_id", "left").select("query_id", "gate", resolution.alias("resolution"), hit["signature"].alias("code"), hit["owner"].alias("owner"), why.alias("owner_reason"))
