"""Personal data: base patterns, and terms that disclose them by corpus co-occurrence.

Protected entities are the base matches (an address, a card, ...).  Over the N documents of the corpus
the information content of an entity is IC(e) = log2(N / c(e)), and what a term tells about it is
PMI(e; t) = log2(N * c(e, t) / (c(e) * c(t))), where c counts the documents that hold e, t or both.  A term
is disclosing if PMI >= ``alpha`` * IC(e) and IC(e) > 0: an entity that every document holds can't be
disclosed, one of a single document can.  Each place of the term in a document that holds the entity, on
whatever line, becomes a span of kind ``term``, unless it lies in a base span.  In the sanitised text a
base span is generalised to its kind, a disclosing term is generalised to ``[TERM]``, and one that
determines the entity (PMI = IC) is removed.

Native: built-in functions only.  Spark's patterns give strings, not places; a match's place follows
from the lengths of the pieces between matches.  Patterns use possessive repeats, so that long runs
cost linear time and no recursion.  Shuffles carry 64-bit term keys and counts, and the documents that
hold entities, each different text once; a corpus-frequent term is pre-aggregated before the shuffle.

Defined results: a null text counts as empty; repeated rows get the same spans each; no entities, or an
empty table, gives no terms; whole texts of any length are read.  Term keys are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, text_digest

KINDS = ("email", "ip", "card", "phone")

#: The contract's patterns, with possessive repeats and run starts where these match the same strings.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A part of a match of ``IP``, at most 255: zeros, then nothing or a number without leading zeros.
PART = r"0*+(?:[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
WORD = r"\p{L}{4,}"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(m, r"[\x20-]", "")
        return F.when(F.length(digits).between(16, 19), let(digits, _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, wanted=None) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points; only those whose value is ``wanted``."""
    kind = "array<struct<s:int,e:int,v:string>>"

    def walk(values: Column) -> Column:
        def go(gaps: Column) -> Column:
            pairs = F.transform(values, lambda v, i: F.struct(F.char_length(F.get(gaps, i)).alias("g"), v.alias("v")))
            start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

            def add(acc: Column, p: Column) -> Column:
                s = acc["at"] + p["g"]
                e = s + F.char_length(p["v"])
                more = F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e"), p["v"].alias("v"))).cast(kind)
                return F.struct(e.alias("at"), (more if wanted is None else F.when(wanted(p["v"]), more).otherwise(acc["out"])).alias("out"))

            return F.aggregate(pairs, start, add, lambda acc: acc["out"])

        return F.when(F.size(values) > 0, let(F.split(text, pattern, -1), go)).otherwise(F.array().cast(kind))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def base_places(text: Column) -> dict[str, Column]:
    """Kind -> array of (s, e, v), failing matches dropped.  Texts without the pattern's sign are skipped."""
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), _places(text, EMAIL)).otherwise(none),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), _places(text, IP)).otherwise(none),
        "card": F.when(text.rlike(r"[0-9]"), F.filter(_places(text, CARD), lambda m: F.char_length(m["v"]) >= 16)).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), _places(text, PHONE)).otherwise(none),
    }
    return {k: _passing(k, v) for k, v in found.items()}


def _passing(kind: str, places: Column) -> Column:
    return F.filter(places, lambda m: _passes(kind, m["v"]))


def _told(kind: str, places: Column) -> Column:
    return F.transform(places, lambda m: F.concat_ws(":", F.lit(kind), m["s"].cast("string"), m["e"].cast("string")))


def _words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _held(docs: DataFrame) -> DataFrame:
    """The different texts that hold an entity: digest, rows (n), text, entities (es, as kind:value) and base spans (spots)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(text_digest(F.col("text")).alias("digest"), text.alias("text")).where(F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]"))
    found = marked.select("digest", "text", F.struct(*[p.alias(k) for k, p in base_places(F.col("text")).items()]).alias("b"))

    def named(kind: str) -> Column:
        return F.transform(F.col(f"b.{kind}"), lambda m: F.concat(F.lit(f"{kind}:"), m["v"]))

    spots = F.concat(*[F.transform(F.col(f"b.{k}"), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))) for k in KINDS])
    rows = found.select("digest", F.struct("text", F.array_distinct(F.concat(*[named(k) for k in KINDS])).alias("es"), spots.alias("spots")).alias("h")).where(F.size("h.es") > 0)
    return stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.first("h").alias("h")).select("digest", "n", "h.*"), "held")


def _disclosed(docs: DataFrame, held: DataFrame, alpha: float) -> DataFrame:
    """(digest, entity, term, pmi, ic): disclosing terms, in each text that holds both."""
    total = docs.count()
    of_e = held.select("digest", "n", F.explode("es").alias("entity"))
    c_e = of_e.groupBy("entity").agg(F.sum("n").alias("c_e"))
    c_t = docs.select(F.explode(F.transform(_words(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.xxhash64(w))).alias("term_key")).groupBy("term_key").agg(F.count("*").alias("c_t"))
    # as c(e, t) <= c(e), a term of more documents than this can't be disclosing
    most = F.pow("c_e", F.lit(alpha)) * F.pow(F.lit(float(total)), F.lit(1 - alpha)) * (1 + 1e-9)
    of_e = of_e.drop("n").join(c_e, "entity").where(F.col("c_e") < total).select("digest", "entity", "c_e", most.alias("most"))
    top = of_e.agg(F.max("most").alias("top"))  # one row
    rare = c_t.join(F.broadcast(top), F.col("c_t") <= F.col("top")).drop("top")
    words = held.select("digest", "n", F.explode(_words(F.col("text"))).alias("term")).withColumn("term_key", F.xxhash64("term"))
    pairs = words.join(rare, "term_key").join(of_e, "digest").where("c_t <= most")
    c_et = F.sum("n").over(Window.partitionBy("entity", "term"))
    ic = F.log2(F.lit(float(total)) / F.col("c_e"))
    pmi = F.log2(F.lit(float(total)) * F.col("c_et") / (F.col("c_e") * F.col("c_t")))
    return pairs.withColumn("c_et", c_et).select("digest", "entity", "term", pmi.alias("pmi"), ic.alias("ic")).where(F.col("pmi") >= alpha * F.col("ic") - 1e-9)


def disclosing_terms(docs: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(entity, term, pmi, ic): terms that tell too much about an entity, over the whole corpus."""
    return _disclosed(docs, _held(docs), alpha).drop("digest").distinct()


def term_places(docs: DataFrame, alpha: float = 0.9) -> DataFrame:
    """(digest, terms): all places of disclosing terms in the texts that hold their entity, outside base spans."""
    held = _held(docs)
    risky = _disclosed(docs, held, alpha).groupBy(F.col("digest").alias("of")).agg(F.collect_set("term").alias("some"), F.collect_set(F.when(F.col("pmi") >= F.col("ic") - 1e-9, F.col("term"))).alias("sure"))
    places = _places(F.col("text"), WORD, lambda v: F.array_contains("some", F.lower(v)))
    free = F.filter(places, lambda m: ~F.exists("spots", lambda p: (p["s"] < m["e"]) & (m["s"] < p["e"])))
    terms = F.transform(free, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.array_contains("sure", F.lower(m["v"])).alias("remove")))
    return held.join(risky, F.col("digest") == F.col("of")).select("digest", terms.alias("terms")).where(F.size("terms") > 0)


def find_pii(docs: DataFrame, alpha: float = 0.9) -> DataFrame:
    """Per row of ``docs``: counts per base kind, digest of the base spans, all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.struct(*[p.alias(k) for k, p in base_places(text).items()]).alias("b"))
    extra = term_places(docs, alpha).withColumnRenamed("digest", "of_digest")
    told = F.concat(*[_told(k, F.col(f"b.{k}")) for k in KINDS])
    narrow = base.select("doc_id", "digest", *[F.size(f"b.{k}").cast("long").alias(f"n_{k}") for k in KINDS], told.alias("told"))
    terms = F.coalesce(F.transform("terms", lambda m: F.concat_ws(":", F.lit("term"), m["s"].cast("string"), m["e"].cast("string"))), F.array().cast("array<string>"))
    return narrow.join(extra, F.col("digest") == F.col("of_digest"), "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("told", ","), 256).alias("base_sha256"), F.array_join(F.concat("told", terms), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, alpha: float = 0.9, out: str = "sanitised") -> DataFrame:
    """``docs`` with the sanitised text beside its own columns: spans replaced from left to right."""
    work = docs.withColumn(out, F.struct(text_digest(F.col("text")).alias("digest"), F.struct(*[p.alias(k) for k, p in base_places(F.coalesce(F.col("text"), F.lit(""))).items()]).alias("b")))
    extra = term_places(docs, alpha).select(F.col("digest").alias("__of"), F.col("terms").alias("__terms"))

    def labelled(kind: str) -> Column:
        return F.transform(F.col(f"{out}.b.{kind}"), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("r")))

    spans = F.concat(
        *[labelled(k) for k in KINDS],
        F.coalesce(F.transform("__terms", lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.when(m["remove"], "").otherwise("[TERM]").alias("r"))), F.array().cast("array<struct<s:int,e:int,r:string>>")),
    )
    body = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"))

    def add(acc: Column, m: Column) -> Column:
        keep = m["s"] >= acc["at"]  # of overlapping spans the first stays
        piece = F.concat(acc["t"], F.substring(body, acc["at"] + 1, m["s"] - acc["at"]), m["r"])
        return F.struct(F.when(keep, m["e"]).otherwise(acc["at"]).alias("at"), F.when(keep, piece).otherwise(acc["t"]).alias("t"))

    text = F.aggregate(F.sort_array(spans), start, add, lambda acc: F.concat(acc["t"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    return work.join(extra, F.col(f"{out}.digest") == F.col("__of"), "left").select(*[c for c in docs.columns if c != out], text.alias(out))
