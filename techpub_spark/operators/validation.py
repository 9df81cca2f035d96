"""Layered package validation: L0 parse, L1 structure, L2 business rules, L3 cross-file.  Findings are rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dmc_string
from . import structure
from .graph import cycles

FINDING = ("package", "rule_id", "layer", "severity", "file", "line", "message")
#: Words of a step that call for a warning.
HAZARDS = ("pressur", "nitrogen", "discharge", "voltage", "high current", "flammable", "toxic")
#: Format of each code attribute.
CODE_FORMAT = {
    "modelIdentCode": "^[A-Z0-9]{2,14}$", "systemDiffCode": "^[A-Z0-9]{1,4}$", "systemCode": "^[0-9]{2}$", "subSystemCode": "^[0-9]$",
    "subSubSystemCode": "^[0-9]$", "assyCode": "^[0-9]{2}$", "disassyCode": "^[0-9]{2}$", "disassyCodeVariant": "^[A-Z]$",
    "infoCode": "^[0-9]{3}$", "infoCodeVariant": "^[A-Z]$", "itemLocationCode": "^[A-Z]$",
}


def finding(df: DataFrame, rule: str, layer: str, severity: str, message: Column) -> DataFrame:
    return df.select("package", F.lit(rule).alias("rule_id"), F.lit(layer).alias("layer"), F.lit(severity).alias("severity"), "file", F.col("line").cast("int").alias("line"), message.alias("message"))


def code_struct(attrs: Column) -> Column:
    at = lambda k: F.coalesce(F.element_at(attrs, k), F.lit("?"))
    names = {"model_ident_code": "modelIdentCode", "system_diff_code": "systemDiffCode", "system_code": "systemCode", "sub_system_code": "subSystemCode", "sub_sub_system_code": "subSubSystemCode", "assy_code": "assyCode", "disassy_code": "disassyCode", "disassy_code_variant": "disassyCodeVariant", "info_code": "infoCode", "info_code_variant": "infoCodeVariant", "item_location_code": "itemLocationCode"}
    return F.struct(*[at(v).alias(k) for k, v in names.items()])


def data_modules(nodes: DataFrame) -> DataFrame:
    """One row per data module file: package, file, digest, dmc, attrs, issue_number, in_work, dm_title, content_type, counters."""
    ident = nodes.where("xpath like '/dmodule/identAndStatusSection/dmAddress/dmIdent/%'")
    code = ident.where("tag = 'dmCode'").select("package", "file", "digest", "line", "attrs", dmc_string(code_struct(F.col("attrs"))).alias("dmc"))
    issue = ident.where("tag = 'issueInfo'").select("package", "file", F.coalesce(F.element_at("attrs", "issueNumber"), F.lit("?")).alias("issue_number"), F.coalesce(F.element_at("attrs", "inWork"), F.lit("?")).alias("in_work"))
    names = nodes.where("tag in ('techName', 'infoName') and xpath like '/dmodule/identAndStatusSection/dmAddress/%'").groupBy("package", "file").agg(F.max(F.when(F.col("tag") == "techName", F.col("text"))).alias("tech"), F.max(F.when(F.col("tag") == "infoName", F.col("text"))).alias("info"))
    kinds = F.when(F.col("tag") == "procedure", "procedure").when(F.col("tag") == "faultIsolation", "fault").when(F.col("tag") == "illustratedPartsCatalog", "ipd").when(F.col("tag") == "description", "description")
    content = nodes.groupBy("package", "file").agg(
        F.min_by(kinds, F.when(kinds.isNotNull(), F.col("node_id"))).alias("content_type"), F.count_if(F.col("tag").isin("proceduralStep", "isolationStep")).alias("steps"),
        F.count_if(F.col("tag") == "warning").alias("warnings"), F.count_if(F.col("tag") == "caution").alias("cautions"),
    )
    return code.join(issue, ["package", "file"], "left").join(names, ["package", "file"], "left").join(content, ["package", "file"], "left").withColumn("dm_title", F.concat_ws(" — ", F.nullif("tech", F.lit("")), F.nullif("info", F.lit("")))).drop("tech", "info")


def references(nodes: DataFrame) -> DataFrame:
    """Every dmRef that has a code: package, file, line, dmc, issue_number."""
    ref = nodes.where("tag = 'dmRefIdent'").select("package", "file", F.col("node_id").alias("ref"))
    code = nodes.where("tag = 'dmCode'").select("package", "file", F.col("parent_id").alias("ref"), "line", dmc_string(code_struct(F.col("attrs"))).alias("dmc"))
    issue = nodes.where("tag = 'issueInfo'").select("package", "file", F.col("parent_id").alias("ref"), F.element_at("attrs", "issueNumber").alias("issue_number"))
    return ref.join(code, ["package", "file", "ref"]).join(issue, ["package", "file", "ref"], "left")  # ref: node of the reference


def parse_findings(nodes: DataFrame) -> DataFrame:
    bad = nodes.where("error is not null")
    rule = F.regexp_extract("error", r"^(PARSE-\d+)", 1)
    return bad.select("package", rule.alias("rule_id"), F.lit("L0").alias("layer"), F.lit("error").alias("severity"), "file", F.lit(None).cast("int").alias("line"), F.col("error").alias("message"))


def hazard_steps(nodes: DataFrame) -> DataFrame:
    """BREX-001: a step whose own paragraphs name a hazard, with no warning or caution in it, in an earlier
    step, or in the safety section of the preliminary requirements."""
    inside = nodes.where("xpath like '/dmodule/content/procedure/%'")
    steps = inside.where("tag = 'proceduralStep'").select("package", "file", "node_id", "line")
    hazard = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(h)) for h in HAZARDS])
    told = inside.where("tag in ('warning', 'caution', 'para')").groupBy("package", "file", F.col("parent_id").alias("node_id")).agg(
        F.max(F.col("tag") != "para").alias("warned"), F.max((F.col("tag") == "para") & hazard).alias("hazard"))
    safe = inside.where(F.col("xpath").rlike(r"^/dmodule/content/procedure/preliminaryRqmts(\[1\])?/reqSafety(\[1\])?/safetyRqmts(\[1\])?/(warning|caution)(\[[0-9]+\])?$")).select("package", "file").distinct()
    w = Window.partitionBy("package", "file").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = steps.join(told, ["package", "file", "node_id"], "left").withColumn("covered", F.max(F.coalesce("warned", F.lit(False))).over(w))
    bare = each.where(F.coalesce("hazard", F.lit(False)) & ~F.col("covered")).join(safe, ["package", "file"], "left_anti")
    return finding(bare, "BREX-001", "L2", "error", F.lit("hazard without a warning before it"))


def code_format(dms: DataFrame) -> DataFrame:
    """BREX-002: every attribute of the code in its format, and the file named after the code."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.element_at("attrs", k), F.lit("?")).rlike(p.replace("$", r"\n?$")), F.lit(k)) for k, p in CODE_FORMAT.items()]))
    named = dms.withColumn("bad", bad)
    return finding(named.where((F.size("bad") > 0) | ~F.startswith("file", F.col("dmc"))), "BREX-002", "L2", "error", F.when(F.size("bad") > 0, F.concat(F.lit("bad code attributes: "), F.array_join("bad", ", "))).otherwise("file name differs from the code"))


def procedure_has_steps(nodes: DataFrame) -> DataFrame:
    """BREX-003: a procedure has a main procedure with a step as direct child."""
    key = ["package", "file"]
    procedure = nodes.where("tag = 'procedure' and xpath = '/dmodule/content/procedure'").select(*key, "line")
    main = nodes.where("tag = 'mainProcedure' and xpath like '/dmodule/content/procedure/mainProcedure%'").select(*key, F.col("node_id").alias("p"))
    good = main.join(nodes.where("tag = 'proceduralStep'").select(*key, F.col("parent_id").alias("p")), [*key, "p"], "left_semi").select(*key)
    return finding(procedure.join(good, key, "left_anti"), "BREX-003", "L2", "error", F.lit("procedure without steps"))


def extension_dates(nodes: DataFrame) -> DataFrame:
    """BREX-005: of a status extension's two dates, the effective one comes first."""
    dates = nodes.where("tag in ('effectiveDate', 'expiryDate')").select("package", "file", F.col("parent_id").alias("node_id"), "tag", F.try_to_date("text", "yyyy-MM-dd").alias("day"))
    both = dates.groupBy("package", "file", "node_id").agg(F.min(F.when(F.col("tag") == "effectiveDate", F.col("day"))).alias("since"), F.min(F.when(F.col("tag") == "expiryDate", F.col("day"))).alias("until"))
    status = nodes.where("tag = 'dmStatus'").select("package", "file", F.col("node_id").alias("parent_id"))
    own = nodes.where("tag like '%Extension'").select("package", "file", "node_id", "parent_id", "line").join(status, ["package", "file", "parent_id"], "left_semi")
    late = own.join(both.where("since >= until"), ["package", "file", "node_id"])
    return finding(late, "BREX-005", "L2", "warning", F.concat(F.lit("effective "), F.col("since").cast("string"), F.lit(" is not before expiry "), F.col("until").cast("string")))


def applicability_present(nodes: DataFrame) -> DataFrame:
    """BREX-004: the status section states an applicability."""
    status = nodes.where("tag = 'dmStatus'").select("package", "file", "line", F.col("node_id").alias("p"))
    return finding(status.join(nodes.where("tag = 'applic'").select("package", "file", F.col("parent_id").alias("p")), ["package", "file", "p"], "left_anti"), "BREX-004", "L2", "warning", F.lit("no applicability"))


def structure_findings(nodes: DataFrame) -> DataFrame:
    """SCHEMA-001: one finding per deviation from the content models, with its line and path."""
    found = structure.deviations(nodes)
    return finding(found, "SCHEMA-001", "L1", "error", F.concat(F.col("path"), F.lit(": "), F.col("message")))


def presence_findings(nodes: DataFrame) -> DataFrame:
    """SCHEMA-001 for packages that follow no content model: a data module needs its code, title and content."""
    need = {"dmCode": "/dmodule/identAndStatusSection/dmAddress/dmIdent/dmCode", "techName": "/dmodule/identAndStatusSection/dmAddress/dmAddressItems/dmTitle/techName", "content": "/dmodule/content"}
    roots = nodes.where("tag = 'dmodule' and depth = 0").select("package", "file", "line")
    return reduce(DataFrame.unionByName, [finding(roots.join(nodes.where(F.col("xpath") == x).select("package", "file").distinct(), ["package", "file"], "left_anti"), "SCHEMA-001", "L1", "error", F.lit(f"missing {k}")) for k, x in need.items()])


def model_findings(nodes: DataFrame) -> DataFrame:
    """MODEL-001: a data module without a code can't be built, enters no index, and no rule is tried on it."""
    code = nodes.where("xpath rlike '^/[^/]+/identAndStatusSection/dmAddress/dmIdent/dmCode(.1.)?$'").select("package", "file").distinct()
    lost = nodes.where("node_id = 0 and upper(file) like 'DMC-%'").join(code, ["package", "file"], "left_anti")
    return finding(lost.withColumn("line", F.lit(None).cast("int")), "MODEL-001", "L1", "error", F.lit("no dmIdent/dmCode"))


class Rule(NamedTuple):
    """A business rule: ``check`` maps (node table, data modules) of sound files to findings."""

    rule_id: str
    check: Callable[[DataFrame, DataFrame], DataFrame]


def file_rule(rule_id: str, severity: str, check: Callable[[list[dict]], list[tuple[int | None, str]]]) -> Rule:
    """A rule in Python over one file's nodes (dicts in document order), giving (line, message) of each violation.

    It is evaluated guarded, file by file: where it raises, the file gets BREX-999 and the others their findings.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("node_id").to_dict("records")
        base = (rows[0]["package"], rows[0]["file"])
        try:
            out = [(*base, line, message, rule_id, severity) for line, message in check(rows)]
        except Exception as e:  # noqa: BLE001 - any fault of a rule is a finding
            out = [(*base, None, f"rule {rule_id} raised: {e}", "BREX-999", "error")]
        return pd.DataFrame(out, columns=["package", "file", "line", "message", "rule_id", "severity"]).astype({"line": "Int32"})

    def findings(nodes: DataFrame, _dms: DataFrame) -> DataFrame:
        found = nodes.where("upper(file) like 'DMC-%'").groupBy("package", "file").applyInPandas(run, "package string, file string, line int, message string, rule_id string, severity string")
        return found.select("package", "rule_id", F.lit("L2").alias("layer"), "severity", "file", "line", "message")

    return Rule(rule_id, findings)


def checked(rules: tuple[Rule, ...], nodes: DataFrame, dms: DataFrame) -> DataFrame:
    """Findings of all rules; a rule that can't be planned gives BREX-999 for every file instead of an end."""
    out = [finding(dms.limit(0), "", "L2", "error", F.lit(""))]
    for rule in rules:
        try:
            out.append(rule.check(nodes, dms).select(*FINDING))
        except Exception as e:  # noqa: BLE001 - any fault of a rule is a finding
            said = f"rule {rule.rule_id} raised: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
            out.append(finding(dms.withColumn("line", F.lit(None).cast("int")), "BREX-999", "L2", "error", F.lit(said)))
    return reduce(DataFrame.unionByName, out)


#: The business rules; a caller may add its own.
RULES = (
    Rule("BREX-001", lambda nodes, _: hazard_steps(nodes)), Rule("BREX-002", lambda _, dms: code_format(dms)), Rule("BREX-003", lambda nodes, _: procedure_has_steps(nodes)),
    Rule("BREX-004", lambda nodes, _: applicability_present(nodes)), Rule("BREX-005", lambda nodes, _: extension_dates(nodes)),
)


def cross_file(nodes: DataFrame, dms: DataFrame, icns: DataFrame) -> DataFrame:
    """XREF rules.  ``icns``: package, ident."""
    index = dms.groupBy("package", "dmc").agg(F.max_by(F.struct("file", "issue_number"), F.struct(F.coalesce(F.expr("try_cast(issue_number as int)"), F.lit(-1)), "issue_number", "file")).alias("i")).select("package", "dmc", F.col("i.file").alias("index_file"), F.col("i.issue_number").alias("index_issue"))
    refs = references(nodes)
    body, listed = refs.where("not upper(file) like 'DML-%'"), refs.where("upper(file) like 'DML-%'")
    out = [finding(body.join(index, ["package", "dmc"], "left_anti"), "XREF-001", "L3", "error", F.concat(F.lit("no module "), "dmc"))]
    used = nodes.where("tag in ('graphic', 'symbol') and attrs['infoEntityIdent'] is not null").select("package", "file", "line", F.col("attrs")["infoEntityIdent"].alias("ident"))
    out.append(finding(used.join(icns, ["package", "ident"], "left_anti"), "XREF-002", "L3", "error", F.concat(F.lit("no figure "), "ident")))
    out.append(finding(listed.join(index, ["package", "dmc"], "left_anti"), "XREF-008", "L3", "error", F.concat(F.lit("registered but missing: "), "dmc")))
    old = listed.join(index, ["package", "dmc"]).where("issue_number <> index_issue").select("package", F.col("index_file").alias("file"), "line", "dmc")
    out.append(finding(old, "XREF-003", "L3", "error", F.concat(F.lit("issue differs from the register: "), "dmc")))
    issue = F.concat_ws("-", "issue_number", "in_work")
    number = F.expr("try_cast(issue_number as int)")
    order = F.struct(F.coalesce(number, F.lit(-1)).alias("n"), F.when(number.isNull(), F.coalesce("issue_number", F.lit(""))).otherwise(issue).alias("s"))
    ordered = dms.withColumn("issue", F.when(F.col("issue_number").isNotNull(), issue)).withColumn("place", order)
    w = Window.partitionBy("package", "dmc").orderBy("place", "file")
    again = ordered.withColumn("before", F.lag("issue").over(w)).where("before = issue")
    out.append(finding(again, "XREF-006", "L3", "error", F.concat(F.lit("same issue twice: "), "dmc")))
    ends = ordered.groupBy("package", "dmc").agg(F.min("place").alias("oldest"), F.max(F.struct("place", "file", "line")).alias("newest"), F.array_sort(F.collect_list(F.concat_ws(" @ ", "file", "issue"))).alias("copies"))
    newer = ends.where(F.col("newest.place") > F.col("oldest")).select("package", "dmc", F.col("newest.file").alias("file"), F.col("newest.line").alias("line"), "copies")
    out.append(finding(newer, "XREF-007", "L3", "warning", F.concat(F.lit("superseded copies of "), "dmc", F.lit(": "), F.array_join("copies", ", "))))
    edges = body.join(dms.select("package", "file", F.col("dmc").alias("owner")), ["package", "file"]).join(index, ["package", "dmc"]).select(F.concat_ws("|", "package", "owner").alias("src"), F.concat_ws("|", "package", "dmc").alias("dst"))
    loop = cycles(edges).select(F.substring_index("carrier", "|", 1).alias("package"), F.substring_index("carrier", "|", -1).alias("dmc"), "members").join(index, ["package", "dmc"]).select("package", F.col("index_file").alias("file"), F.lit(None).cast("int").alias("line"), "members")
    out.append(finding(loop, "XREF-005", "L3", "warning", F.concat(F.lit("cycle of "), F.size("members").cast("string"))))
    return reduce(DataFrame.unionByName, out)


def wrong_model(dms: DataFrame, accepted: tuple[str, ...]) -> DataFrame:
    """XREF-004: the model code is one of the accepted ones."""
    return finding(dms.where(~F.coalesce(F.element_at("attrs", "modelIdentCode"), F.lit("?")).isin(*accepted)), "XREF-004", "L3", "error", F.lit("foreign model code"))


def first_copies(digests: DataFrame) -> DataFrame:
    """(package, file) without byte-equal copies: of each digest the first by name.  ``digests``: package, file, digest."""
    return digests.where("digest is not null").groupBy("package", "digest").agg(F.min("file").alias("file")).select("package", "file")


def file_findings(nodes: DataFrame, accepted: tuple[str, ...] | None = None, rules: tuple[Rule, ...] = RULES, shape: Callable[[DataFrame], DataFrame] = structure_findings) -> DataFrame:
    """Findings that need one file only, of every file: L0, L1, and L2 where L1 passes."""
    own = nodes.where("error is null")
    dms = data_modules(own)
    l1 = shape(own).unionByName(model_findings(own))
    bad = l1.select("package", "file").distinct()
    parts = [parse_findings(nodes), l1, checked(rules, own.join(bad, ["package", "file"], "left_anti"), dms.join(bad, ["package", "file"], "left_anti"))]
    if accepted:
        parts.append(wrong_model(dms, accepted))
    return reduce(DataFrame.unionByName, parts)


def validate(nodes: DataFrame, icns: DataFrame, accepted: tuple[str, ...] | None = None, rules: tuple[Rule, ...] = RULES, shape: Callable[[DataFrame], DataFrame] = structure_findings) -> DataFrame:
    """All findings of the packages in ``nodes``; byte-equal copies of a file count once (the first by name)."""
    own = nodes.where("error is null").join(first_copies(nodes.where("node_id = 0")), ["package", "file"], "left_semi")
    broken = nodes.where("error is not null")
    return file_findings(own.unionByName(broken), accepted, rules, shape).unionByName(cross_file(own, data_modules(own), icns))


def findings_for(findings: DataFrame, files: DataFrame) -> DataFrame:
    """The findings of the given files (package, file)."""
    return findings.join(files.select("package", "file").distinct(), ["package", "file"], "left_semi")


def inspect(nodes: DataFrame, icns: DataFrame) -> DataFrame:
    """One row per package: files by kind, modules by content type, references, figures, files that can't be read."""
    own = nodes.where("error is null")
    kind = F.upper(F.substring("file", 1, 4))
    files = nodes.groupBy("package", "file").agg(F.max(F.col("error").isNotNull()).alias("broken")).groupBy("package").agg(
        F.count_if(kind == "DMC-").alias("data_modules"), F.count_if(kind.startswith("PMC-")).alias("publication_modules"),
        F.count_if(kind == "DML-").alias("lists"), F.count_if("broken").alias("unreadable"))
    types = data_modules(own).groupBy("package", F.coalesce("content_type", F.lit("unknown")).alias("t")).agg(F.count("*").alias("n"))
    types = types.groupBy("package").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("t", "n")))).alias("content_types"))
    refs = references(own).groupBy("package").agg(F.count("*").alias("references"), F.count_distinct("dmc").alias("referenced"))
    figures = icns.groupBy("package").agg(F.count_distinct("ident").alias("figures"))
    out = files.join(types, "package", "left").join(refs, "package", "left").join(figures, "package", "left")
    return out.fillna(0, ["references", "referenced", "figures"])


def inbound(nodes: DataFrame, dms: DataFrame) -> DataFrame:
    """Who refers to each module: package, dmc, referrers (sorted), n; a module that nobody refers to has none."""
    own = dms.select("package", "file", F.col("dmc").alias("owner"))
    to = references(nodes).join(own, ["package", "file"]).groupBy("package", "dmc").agg(F.sort_array(F.collect_set("owner")).alias("referrers"))
    return dms.select("package", "dmc").distinct().join(to, ["package", "dmc"], "left").select("package", "dmc", F.coalesce("referrers", F.array().cast("array<string>")).alias("referrers")).withColumn("n", F.size("referrers"))


def report(findings: DataFrame) -> DataFrame:
    """Severity counts per package."""
    return findings.groupBy("package").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def targeted(findings: DataFrame, only: list[str]) -> DataFrame:
    want = [x.upper() for x in only]
    return findings.where(F.upper("rule_id").isin(*want) | F.upper("layer").isin(*want))
