"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names ratios of length, symbols, stop words and lines with the range each must stay in;
``with_quality`` compiles them into column expressions that Catalyst evaluates in a single narrow
projection: no user function, no shuffle, one pass over the text.

Defined results: a null or empty text has no words, fails the base rule and is rejected; a repeated
row is judged like any other; an empty table gives an empty table; a document of any length is read
whole.  Extra columns of the input are kept and never read; the working columns are nested in one
struct, so that names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and a to in is it that for on as with was by are this from at be "
    "der die das und ist von zu mit den im ein eine nicht auf für sich des dem "
    "le la les de et un une des en que est pour dans qui sur par pas au du il elle avec "
    "el los las que y un una en de es por con para se del al no su lo"
).split()

#: White space that separates words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves an end open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are columns of the struct that ``measures`` makes.
RULES = (
    Rule("mean_word_length", "mean_word", 1.5, 14.0),
    Rule("words_per_line", "mean_line_words", 1.5, None),
    Rule("symbols_per_word", "symbol_ratio", None, 0.1),
    Rule("upper_case_letters", "upper_ratio", None, 0.5),
    Rule("exclamations_per_word", "bang_ratio", None, 0.3),
    Rule("stop_word_share", "stop_ratio", 0.02, None),
    Rule("stuttered_words", "stutter_ratio", None, 0.3),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(body != "", F.split(body, SPACE)).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur at least twice in the text.

    Windows are compared by 64-bit hashes of their words' hashes, within one text only.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(width)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(win: Column) -> Column:
        def positions(s: Column) -> Column:
            last = F.size(s) - 1
            return F.transform(
                F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"]))),
                lambda x: x["i"],
            )

        pairs = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(
            F.sort_array(let(pairs, positions)),
            start,
            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(win)) < F.size(win), total).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > width, let(let(hashed, windows), covered)).otherwise(F.lit(0).cast("long"))


def _counts(words: Column, lines: Column, text: Column) -> Column:
    n = F.size(words).cast("long")
    full = F.filter(lines, lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    return F.struct(
        n.alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(full).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))).cast("long").alias("n_stutter"),
        F.size(F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop"),
    )


def _ratios(c: Column) -> dict[str, Column]:
    per = lambda a, b: c[a] / F.greatest(c[b], F.lit(1))
    return {
        "mean_word": per("word_chars", "n_words"),
        "mean_line_words": per("n_words", "n_lines"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "upper_ratio": per("n_upper", "word_chars"),
        "bang_ratio": per("n_bangs", "n_words"),
        "stop_ratio": (c["n_stop"] + 1) / F.greatest(c["n_words"], F.lit(1)),  # smoothed: a short text may have none
        "stutter_ratio": per("n_stutter", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...], ratios: dict[str, Column]) -> Column:
    """The names of the broken rules, as one array expression."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratios[r.metric] < F.lit(float(r.low)))
        if r.high is not None:
            bad = bad | (ratios[r.metric] > F.lit(float(r.high)))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def with_quality(docs: DataFrame, out: str = "quality", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with one more struct column ``out``: the counts, ``broken`` rules, ``base_failed`` and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))
    counts = let(_words(body), lambda w: _counts(w, F.split(body, "\n"), body))

    def verdict(c: Column) -> Column:
        base = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        broken = compiled(rules, _ratios(c))
        return F.struct(c.alias("counts"), broken.alias("broken"), base.alias("base_failed"), (~base & (F.size(broken) == 0)).alias("kept"))

    return docs.withColumn(out, let(counts, verdict))


def quality_table(docs: DataFrame) -> DataFrame:
    """The query's columns for each row of ``docs``."""
    q = with_quality(docs.select("doc_id", "text"))
    c = F.col("quality.counts")
    return q.select(
        "doc_id", *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("quality.base_failed").alias("base_failed"), F.col("quality.kept").alias("kept"), F.array_join("quality.broken", ",").alias("broken"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows whose text passes every rule, with their own columns only."""
    work = "__quality__"
    while work in docs.columns:
        work += "_"
    return with_quality(docs, work).where(F.col(f"`{work}`.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
