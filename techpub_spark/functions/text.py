"""Column functions: tokens, normal forms, identifiers, vectors.  All stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of identifiers, and words that deny what follows them in their clause.
DMC_PATTERN = r"DMC-[A-Z0-9]+(?:-[A-Z0-9]+){6,8}"
FULL_CODE = r"\bDMC(?:-[A-Z0-9]+)+\b"
BARE_CODE = r"\b[0-9]{2}-[0-9]{2}-[0-9]{2}-[0-9]{2}[A-Z]-[0-9]{3}[A-Z]-[A-Z]\b"
PART_SHAPE = r"\b[A-Z]{1,4}(?:-[A-Z0-9]+){2,}\b"
HYPHEN_TOKEN = r"\b[A-Z0-9]+(?:-[A-Z0-9]+)+\b"
NEGATIONS = (r"\bnot\b", r"\bno\b", r"n['’]t\b", r"\bnever\b", r"\binstead\b", r"\brather than\b", r"\bisn\b", r"\bwrong\b")


#: A word that nothing is joined to; a joined run with a digit, whole, looked for at the start of a run only; another word.
TOKEN = r"[A-Za-z]++(?![-/_0-9])|(?<![A-Za-z0-9][-/_])(?:[A-Za-z]++(?:[-/_][A-Za-z]++)*+[-/_]?)?[0-9][A-Za-z0-9]*+(?:[-/_][A-Za-z0-9]++)*+|[A-Za-z]++"


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words; a joined run (``-``, ``/``, ``_``) with a digit stays one token, others are split."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def squeeze(text: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_quote(text: Column) -> Column:
    """Form in which quotes and evidence are compared: squeezed, case folded (``ß`` as ``ss``)."""
    return F.replace(F.lower(squeeze(text)), F.lit("ß"), F.lit("ss"))


def normal_phrase(text: Column) -> Column:
    """Form in which task phrases are compared: lower case, anything but ASCII letters and digits a blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def sanitise(text: Column) -> Column:
    """Control characters removed."""
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f]", "")


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def chunk_id(dmc: Column, path: Column, strategy: Column, digest: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the joined key parts."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (dmc, path, strategy, digest)])), 1, 16)


def dmc_string(c: Column) -> Column:
    """Canonical code of an 11-part struct: eight dash groups, three of them concatenations."""
    g = c.getField
    return F.concat(
        F.lit("DMC-"),
        F.concat_ws(
            "-", g("model_ident_code"), g("system_diff_code"), g("system_code"), F.concat(g("sub_system_code"), g("sub_sub_system_code")), g("assy_code"),
            F.concat(g("disassy_code"), g("disassy_code_variant")), F.concat(g("info_code"), g("info_code_variant")), g("item_location_code"),
        ),
    )


def title(tech: Column, info: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(tech, F.lit("")), F.nullif(info, F.lit("")))


def sns_system(dmc: Column) -> Column:
    """System field of a code: the third dash field after the prefix, if it is digits."""
    part = F.get(F.split(F.regexp_replace(dmc, "^DMC-", ""), "-"), 2)
    return F.when(part.rlike("^[0-9]+$"), part)


def strict_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where the parts make none."""
    return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-M-d")


def xpath_related(a: Column, b: Column) -> Column:
    """Equal, or one nested in the other."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit("/"))) | F.startswith(b, F.concat(a, F.lit("/")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def affirmed(answer: Column, value: Column) -> Column:
    """Some occurrence of ``value`` stands in a clause without a negation before it.

    A clause starts after the nearest of ``.;,:!?`` before the occurrence; what an earlier occurrence in the
    same clause was preceded by counts too.
    """
    needle = F.lower(F.trim(value))
    pieces = F.split(F.lower(answer), F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    clause = lambda p: F.element_at(F.split(p, "[.;,:!?]", -1), -1)

    def step(acc: Column, piece: Column) -> Column:
        before = clause(F.concat(acc["tail"], piece))
        return F.struct(clause(F.concat(before, needle)).alias("tail"), (acc["hit"] | ~before.rlike("|".join(NEGATIONS))).alias("hit"))

    start = F.struct(F.lit("").alias("tail"), F.lit(False).alias("hit"))
    found = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda acc: acc["hit"])
    return F.when(needle == "", True).otherwise(found)


def balanced_objects(text: Column) -> Column:
    """All outermost ``{...}`` of a text, in order: braces are counted, those inside JSON strings are not."""
    start = F.expr("named_struct('depth', 0, 'quoted', false, 'escaped', false, 'from', 0, 'at', 0, 'found', cast(array() as array<struct<a:int,b:int>>))")

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + 1
        opens, closes = ~s["quoted"] & (c == "{"), ~s["quoted"] & (c == "}") & (s["depth"] > 0)
        whole = closes & (s["depth"] == 1)
        return F.struct(
            (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"),
            F.when(s["quoted"], s["escaped"] | (c != '"')).otherwise(c == '"').alias("quoted"),
            (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when(opens & (s["depth"] == 0), at).otherwise(s["from"]).alias("from"), at.alias("at"),
            F.when(whole, F.array_append(s["found"], F.struct(s["from"].alias("a"), at.alias("b")))).otherwise(s["found"]).alias("found"),
        )

    found = F.aggregate(F.split(text, ""), start, step, lambda s: s["found"])
    return F.transform(found, lambda p: F.substring(text, p["a"], p["b"] - p["a"] + 1))


def answer_object(text: Column) -> Column:
    """The JSON object of a model's reply: thinking block and code fence removed; null if there is none."""
    body = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    body = F.regexp_replace(body, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1")
    found = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
