"""Structure of files: content models as finite automata, folded over each element's ordered children.

A model is a line ``element: particles``; particles stand in order, ``?`` ``*`` ``+`` say how often, ``(a|b)`` is a choice,
``@name`` an attribute (``!``: required), ``#`` allows text.  An element is known by the root of its file and its
name.  Every deviation is one finding with line and path: a child that is not expected (what follows it in its
parent and stands below it is not looked at), a missing child, a missing or unknown attribute, stray text, a
value of the wrong form.  The models are a few small rows beside the node table; the work is one aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CODE = "@modelIdentCode! @systemDiffCode! @systemCode! @subSystemCode! @subSubSystemCode! @assyCode! @disassyCode! @disassyCodeVariant! @infoCode! @infoCodeVariant! @itemLocationCode!"
_COMMON = f"""
dmCode: {_CODE}
issueInfo: @issueNumber! @inWork!
language: @languageIsoCode! @countryIsoCode!
issueDate: @year! @month! @day!
security: @securityClassification!
dmRef: dmRefIdent
dmRefIdent: dmCode issueInfo?
"""
#: Content models by the root of a file.
MODELS = {
    "dmodule": _COMMON + """
dmodule: identAndStatusSection content
identAndStatusSection: dmAddress dmStatus
dmAddress: dmIdent dmAddressItems
dmIdent: dmCode language issueInfo
dmAddressItems: issueDate dmTitle
dmTitle: techName infoName?
techName: #
infoName: #
dmStatus: security qualityAssurance? applic? *Extension? @issueType
qualityAssurance: firstVerification
firstVerification: @verificationType
applic: displayText assert*
displayText: simplePara+
simplePara: #
assert: @applicPropertyIdent! @applicPropertyType @applicPropertyValues!
*Extension: effectiveDate? expiryDate?
effectiveDate: #
expiryDate: #
content: (description|procedure|faultIsolation|illustratedPartsCatalog) figure*
description: levelledPara+
levelledPara: title? para+
title: #
para: # dmRef*
procedure: preliminaryRqmts? mainProcedure closeRqmts?
preliminaryRqmts: reqCondGroup? reqSupportEquips? reqSafety?
reqCondGroup: reqCond*
reqCond: # dmRef*
reqSupportEquips: supportEquipDescr+
supportEquipDescr: #
reqSafety: safetyRqmts
safetyRqmts: (warning|caution|noSafety)*
noSafety: any
warning: warningAndCautionPara+
caution: warningAndCautionPara+
warningAndCautionPara: # dmRef*
mainProcedure: proceduralStep*
proceduralStep: (warning|caution)* para+
closeRqmts: reqCondGroup
faultIsolation: faultDescription isolationProcedure
faultDescription: para+
isolationProcedure: isolationStep+
isolationStep: para+
illustratedPartsCatalog: figure* catalogSeqNumber*
figure: title? graphic hotspot*
graphic: @infoEntityIdent!
hotspot: # @hotspotId! @partNumberValue
catalogSeqNumber: itemSeqNumber+ @catalogSeqNumberValue
itemSeqNumber: quantityPerNextHigherAssy? partRef partSegment? @itemSeqNumberValue
quantityPerNextHigherAssy: #
partRef: @manufacturerCodeValue @partNumberValue
partSegment: itemIdentData
itemIdentData: descrForPart
descrForPart: #
""",
    "pm": _COMMON + """
pm: identAndStatusSection content
identAndStatusSection: pmAddress pmStatus
pmAddress: pmIdent pmAddressItems
pmIdent: pmCode language issueInfo
pmCode: @modelIdentCode! @pmIssuer @pmNumber @pmVolume
pmAddressItems: issueDate pmTitle
pmTitle: #
pmStatus: security @issueType
content: pmEntry+
pmEntry: pmEntryTitle? dmRef+
pmEntryTitle: #
""",
    "dml": _COMMON + """
dml: identAndStatusSection dmlContent
identAndStatusSection: dmlAddress
dmlAddress: dmlIdent dmlAddressItems
dmlIdent: dmlCode issueInfo
dmlCode: @modelIdentCode! @senderIdent @dmlType @yearOfDataIssue @seqNumber
dmlAddressItems: issueDate
dmlContent: dmlEntry+
dmlEntry: dmRef
""",
}
#: Forms of values, by element and attribute.
FORMS = {("hotspot", "hotspotId"): "^[A-Za-z0-9][A-Za-z0-9-]{0,15}$"}


def automaton(particles: list[tuple[tuple[str, ...], str]]) -> tuple[dict[str, int], list[int]]:
    """Moves (``state child`` -> state) and accepting states of a sequence of particles; 0 is where it starts.

    State 2 i + 1 (2 i) stands at particle i, which has (has not) occurred.
    """
    least = [occurs in ("", "+") for _, occurs in particles]
    moves: dict[str, int] = {}
    final = []
    for state in range(max(1, 2 * len(particles))):
        i, seen = divmod(state, 2)
        if all(not need or (j == i and seen) for j, need in enumerate(least) if j >= i):
            final.append(state)
        for j in range(i, len(particles)):
            names, occurs = particles[j]
            if j > i or not seen or occurs in ("*", "+"):
                for name in names:
                    moves.setdefault(f"{state} {name}", 2 * j + 1)
            if least[j] and not (j == i and seen):
                break
    return moves, final


def model_rows(models: dict[str, str] = MODELS) -> list[tuple]:
    """(root, kind, moves, final, required, allowed, mixed, open) of each element type."""
    out = []
    for root, text in models.items():
        for line in filter(None, map(str.strip, text.splitlines())):
            kind, _, body = line.partition(":")
            parts = body.split()
            attrs = [p[1:] for p in parts if p[0] == "@"]
            particles = [(tuple(m[1].strip("()").split("|")), m[2]) for p in parts if p[0] not in "@#" and p != "any" if (m := re.fullmatch(r"(.+?)([?*+]?)", p))]
            moves, final = automaton(particles)
            out.append((root, kind, moves, final, [a[:-1] for a in attrs if a.endswith("!")], [a.rstrip("!") for a in attrs], "#" in parts, "any" in parts))
    return out


ROWS = "root string, kind string, moves map<string,int>, final array<int>, required array<string>, allowed array<string>, mixed boolean, open boolean"


def _kind(tag: Column) -> Column:
    return F.when(tag.endswith("Extension"), F.lit("*Extension")).otherwise(tag)


def deviations(nodes: DataFrame, models: dict[str, str] = MODELS) -> DataFrame:
    """package, file, line, path, message: one row per deviation of a file from the models of its root."""
    spark: SparkSession = nodes.sparkSession
    known = F.broadcast(spark.createDataFrame(model_rows(models), ROWS))  # a row for each element of the models
    key = ["package", "file"]
    own = nodes.where("error is null")
    roots = own.where("parent_id is null").select(*key, F.col("tag").alias("root"))
    kids = own.where("parent_id is not null").select(*key, F.col("parent_id").alias("node_id"), F.struct(F.col("node_id").alias("id"), _kind(F.col("tag")).alias("kind"), "tag", "line", "xpath", "last_id").alias("kid"))
    each = own.select(*key, "node_id", "last_id", "line", "xpath", "tag", "attrs", "own_text", _kind(F.col("tag")).alias("kind")).join(roots, key)
    each = each.join(kids.groupBy(*key, "node_id").agg(F.sort_array(F.collect_list("kid")).alias("kids")), [*key, "node_id"], "left").join(known, ["root", "kind"], "left")
    start = F.struct(F.lit(0).alias("state"), F.lit(-1).alias("bad"), F.lit(0).alias("at"))

    def step(s: Column, kid: Column) -> Column:
        to = F.element_at(F.col("moves"), F.concat_ws(" ", s["state"].cast("string"), kid["kind"]))
        off = s["bad"] >= 0
        return F.struct(F.when(off | to.isNull(), s["state"]).otherwise(to).alias("state"), F.when(off, s["bad"]).when(to.isNull(), s["at"]).otherwise(-1).alias("bad"), (s["at"] + 1).alias("at"))

    run = F.aggregate(F.coalesce("kids", F.expr("cast(array() as array<struct<id:int,kind:string,tag:string,line:int,xpath:string,last_id:int>>)")), start, step)
    each = each.withColumn("run", F.when(~F.col("open"), run)).withColumn("kid", F.when(F.col("run.bad") >= 0, F.get("kids", F.col("run.bad"))))
    row = lambda line, path, message: F.struct(line.alias("line"), path.alias("path"), message.alias("message"))
    line, path = F.col("line"), F.col("xpath")
    next_names = F.array_sort(F.transform(F.filter(F.map_keys("moves"), lambda k: F.startswith(k, F.concat(F.col("run.state").cast("string"), F.lit(" ")))), lambda k: F.substring_index(k, " ", -1)))
    expected = F.when(F.size(next_names) > 0, F.concat(F.lit("; expected: "), F.array_join(next_names, ", "))).otherwise("")
    plain = F.filter(F.map_keys("attrs"), lambda a: (a != "xmlns") & ~F.startswith(a, F.lit("xmlns:")) & ~F.startswith(a, F.lit("xsi:")) & ~F.startswith(a, F.lit("xml:")))
    none = F.expr("cast(array() as array<struct<line:int,path:string,message:string>>)")
    wrong = [
        F.when((F.col("node_id") == 0) & F.col("moves").isNull(), F.array(row(line, path, F.concat(F.lit("no root that is known: "), F.col("tag"))))),
        F.when(F.col("kid").isNotNull(), F.array(row(F.col("kid.line"), F.col("kid.xpath"), F.concat(F.col("kid.tag"), F.lit(" is not expected"), expected)))),
        F.when((F.col("run.bad") < 0) & ~F.array_contains("final", F.col("run.state")), F.array(row(line, path, F.concat(F.col("tag"), F.lit(" lacks a child"), expected)))),
        F.when(~F.col("open"), F.transform(F.array_except("required", F.map_keys("attrs")), lambda a: row(line, path, F.concat(F.col("tag"), F.lit(" lacks the attribute "), a)))),
        F.when(~F.col("open"), F.transform(F.array_except(plain, "allowed"), lambda a: row(line, path, F.concat(F.col("tag"), F.lit(" has no attribute "), a)))),
        F.when(~F.col("mixed") & ~F.col("open") & (F.col("own_text") != ""), F.array(row(line, path, F.concat(F.col("tag"), F.lit(" holds text"))))),
        *[F.when((F.col("tag") == tag) & ~F.element_at("attrs", F.lit(a)).rlike(form), F.array(row(line, path, F.concat(F.lit(f"{tag} has a bad {a}: "), F.element_at("attrs", F.lit(a)))))) for (tag, a), form in FORMS.items()],
    ]
    found = each.select(*key, "node_id", F.flatten(F.array(*[F.coalesce(w, none) for w in wrong])).alias("found"), F.col("kid.id").alias("from"), "last_id").where(F.size("found") > 0)
    beyond = found.where(F.col("from").isNotNull()).select(*[F.col(k).alias(f"of_{k}") for k in key], "from", F.col("last_id").alias("to"))
    inside = (F.col("package") == F.col("of_package")) & (F.col("file") == F.col("of_file")) & (F.col("node_id") >= F.col("from")) & (F.col("node_id") <= F.col("to"))
    return found.drop("from", "last_id").join(beyond, inside, "left_anti").select(*key, F.explode("found").alias("d")).select(*key, "d.*")
