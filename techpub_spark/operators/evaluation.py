"""Evaluation of answers, judges, figures, repairs and timings: counts and rates over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import balanced_objects

#: The verdicts of a judge.
VERDICTS = ("grounded", "hallucinated")


def _rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, places))


def repeat_stats(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``runs``: run, case_id, passed -> (pass rate per run with the mean over runs, failures per case, most frequent first)."""
    per = runs.groupBy("run").agg(F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))
    mean = per.agg(F.round(F.avg("pass_rate"), 4).alias("mean_pass_rate"), F.count("*").alias("n_runs"))
    failed = runs.where(~F.col("passed")).groupBy("case_id").agg(F.count("*").alias("failures"))
    return per.crossJoin(F.broadcast(mean)), failed.orderBy(F.col("failures").desc(), "case_id")


def sample(golden: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` queries in a seeded order that depends on ids alone: a fifth traps (two at least), the rest answerable.

    The order is that of a hash, so the sample differs from one drawn by another generator.
    """
    traps = max(2, n // 5)
    w = Window.partitionBy(F.size("relevant") == 0).orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id")
    place = F.row_number().over(w)
    return golden.withColumn("rn", place).where(F.col("rn") <= F.when(F.size("relevant") == 0, traps).otherwise(n - traps)).drop("rn")


def sample_summary(rows: DataFrame) -> DataFrame:
    """``rows``: answerable, refused, hit (booleans) -> success, false refusals, trap refusals, coverage when answered."""
    a, r = F.col("answerable"), F.col("refused")
    c = rows.agg(
        F.count("*").alias("n_sampled"), F.count_if(a).alias("n_answerable"), F.count_if(~a).alias("n_traps"), F.count_if(a & ~r).alias("answered"),
        F.count_if(a & ~r & F.col("hit")).alias("covered"), F.count_if(a & r).alias("false_refusals"), F.count_if(~a & r).alias("trap_refusals"))
    return c.select(
        "n_sampled", "n_answerable", "n_traps", _rate(F.col("covered"), F.col("n_answerable")).alias("answerable_success"), _rate(F.col("false_refusals"), F.col("n_answerable")).alias("false_refusal_rate"),
        _rate(F.col("trap_refusals"), F.col("n_traps")).alias("trap_refusal_rate"), _rate(F.col("covered"), F.col("answered")).alias("coverage_when_answered"))


def refusal_threshold(scores: DataFrame) -> DataFrame:
    """``scores``: answerable, top1 -> the lowest best score of an answerable query, and how many traps lie strictly below it."""
    low = scores.agg(F.min(F.when(F.col("answerable"), F.col("top1"))).alias("threshold"))
    return scores.crossJoin(F.broadcast(low)).groupBy("threshold").agg(F.count_if(~F.col("answerable")).alias("n_traps"), F.count_if(~F.col("answerable") & (F.col("top1") < F.col("threshold"))).alias("traps_below"))


def gate_regressions(rows: DataFrame, before: str = "hybrid", after: str = "hybrid-graph") -> DataFrame:
    """``rows``: query_id, mode, refused -> per query both decisions and whether a refusal was lost."""
    of = lambda m: F.max(F.when(F.col("mode") == m, F.col("refused")))
    return rows.groupBy("query_id").agg(of(before).alias("before"), of(after).alias("after")).withColumn("regression", F.coalesce(F.col("before") & ~F.col("after"), F.lit(False)))


def refusal_rates(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mode").agg(F.count_if("refused").alias("refused"), F.round(F.avg(F.col("refused").cast("double")), 4).alias("refusal_rate"))


def figure_case_passed(expect: Column, refused: Column, answer: Column, contains: Column, any_of: Column, conflict: Column, figure: Column, cited: Column) -> Column:
    """Whether a figure question was answered as expected.  Arrays: ``contains``, ``conflict`` (parts), ``cited`` (figure references)."""
    none, low = F.array().cast("array<string>"), F.lower(F.coalesce(answer, F.lit("")))
    has = lambda words: F.transform(F.coalesce(words, none), lambda x: F.contains(low, F.lower(x)))
    hit = F.when(F.coalesce(any_of, F.lit(False)), F.exists(has(contains), lambda x: x)).otherwise(F.forall(has(contains), lambda x: x))
    ref = figure.isNull() | F.array_contains(F.coalesce(cited, none), F.coalesce(figure, F.lit("")))
    return F.when(expect == "refuse", refused).when(expect == "present_both_or_refuse", refused | F.forall(has(conflict), lambda x: x)).otherwise(~refused & hit & ref)


def class_scores(rows: DataFrame) -> DataFrame:
    """``rows``: category, passed -> k of n per class."""
    return rows.groupBy("category").agg(F.count_if("passed").alias("k"), F.count("*").alias("n"))


def read_stability(reads: DataFrame) -> DataFrame:
    """``reads``: scale, outcome (flaky, exact, wrong) -> per scale instability, accuracy, the ``k`` of a consensus,
    and which scale is chosen: the smallest that is always exact, else the most accurate."""
    per = reads.groupBy("scale").agg(F.count("*").alias("calls"), F.count_if(F.col("outcome") == "flaky").alias("flaky"), F.count_if(F.col("outcome") == "exact").alias("exact"))
    good = F.col("calls") - F.col("flaky")
    per = per.withColumn("instability", F.coalesce(_rate(F.col("flaky"), F.col("calls"), 3), F.lit(0.0))).withColumn("accuracy", F.when(good > 0, F.round(F.col("exact") / good, 3)).otherwise(0.0))
    perfect = F.col("accuracy") == 1.0
    w = Window.partitionBy(F.lit(1)).orderBy(perfect.desc(), F.when(perfect, F.col("scale")), F.col("accuracy").desc(), "scale")  # a row per scale
    return per.withColumn("k", F.when(F.col("instability") <= 0.34, 2).otherwise(3)).withColumn("chosen", F.row_number().over(w) == 1)


def timing(samples: DataFrame) -> DataFrame:
    """``samples``: package, workers (0: serial), shards, seconds -> median, least and most seconds, speedup over serial, efficiency.

    ``verdict``: none where the best speedup of a package is under 1.05.
    """
    per = samples.groupBy("package", "workers").agg(F.max("shards").alias("shards"), F.percentile("seconds", 0.5).alias("median"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    base = per.where("workers = 0").select("package", F.col("median").alias("serial"))
    speed = F.when(F.col("median") > 0, F.col("serial") / F.col("median")).otherwise(0.0)
    out = per.where("workers > 0").join(base, "package").withColumn("speedup", F.round(speed, 3))
    out = out.withColumn("efficiency", F.when(F.least("workers", "shards") > 0, F.round(speed / F.least("workers", "shards"), 3)).otherwise(0.0))
    best = F.max("speedup").over(Window.partitionBy("package"))
    return out.withColumn("verdict", F.when(best < 1.05, "no speedup").when(F.col("speedup") == best, "best").otherwise("slower"))


def majority(runs: DataFrame) -> DataFrame:
    """``runs``: case_id, passed, tokens -> passes of n, the majority, whether runs disagree, tokens in all."""
    c = runs.groupBy("case_id").agg(F.count_if("passed").alias("k"), F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return c.withColumn("majority", F.col("k") * 2 > F.col("n")).withColumn("unstable", (F.col("k") > 0) & (F.col("k") < F.col("n")))


def repair_report(patches: DataFrame) -> DataFrame:
    """``patches``: status -> fixed (patched or applied), applied, refused (or out of budget), all_resolved."""
    s = F.lower("status")
    c = patches.agg(F.count_if(s.isin("patched", "applied")).alias("fixed"), F.count_if(s == "applied").alias("applied"), F.count_if(s.isin("refused", "budget-exhausted")).alias("refused"))
    return c.withColumn("all_resolved", F.col("refused") == 0)


def finding_key() -> Column:
    """Identity of a finding across runs: a changed line, severity or message is a new finding."""
    path = F.coalesce(F.col("path"), F.lit(""))
    line = F.coalesce(F.col("line").cast("string"), F.lit("None"))
    return F.concat(F.col("rule_id"), F.lit("@"), F.col("file"), F.lit("@"), path, F.lit("@L"), line, F.lit("@"), F.col("severity"), F.lit("@"), F.col("message"))


def in_tiers(findings: DataFrame, tier: Column) -> DataFrame:
    """Findings by tier, then as they came (``seq``)."""
    return findings.withColumn("tier", tier).orderBy("tier", "seq")


def shards(rows: DataFrame, n: int, order_col: str) -> DataFrame:
    """``rows`` with ``shard``: contiguous, near equal, never more shards than rows."""
    total = rows.count()
    if not total:
        return rows.withColumn("shard", F.lit(0))
    return rows.withColumn("shard", F.ntile(max(1, min(n, total))).over(Window.orderBy(order_col)) - 1)


def verdict(reply: Column, nonce: Column | None = None) -> Column:
    """A judge's verdict from all it said, strictly: verdict (null if off contract), groundedness, supported, claims.

    Of the outermost JSON objects the last counts whose ``verdict`` is exactly one of ``VERDICTS`` and, where a nonce
    was asked for, whose ``nonce`` is it.  A claim is an object, supported only by the JSON value ``true``;
    groundedness is a JSON number, else the share of supported claims, else null.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    named = lambda v, path: F.coalesce(F.schema_of_variant(get(v, path, "variant")), F.lit("VOID"))

    def fits(v: Column) -> Column:
        ok = (named(v, "$.verdict") == "STRING") & get(v, "$.verdict", "string").isin(*VERDICTS)
        return F.coalesce(ok if nonce is None else ok & (named(v, "$.nonce") == "STRING") & (get(v, "$.nonce", "string") == nonce), F.lit(False))

    able = F.filter(F.transform(balanced_objects(reply), F.try_parse_json), fits)

    def read(v: Column) -> Column:
        claims = F.filter(F.coalesce(get(v, "$.claims", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda c: F.coalesce(F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), F.lit(False)))
        yes = F.size(F.filter(claims, lambda c: F.coalesce((named(c, "$.supported") == "BOOLEAN") & get(c, "$.supported", "boolean"), F.lit(False))))
        number = F.when(named(v, "$.groundedness").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), get(v, "$.groundedness", "double"))
        share = F.when(F.size(claims) > 0, yes / F.size(claims))
        return F.struct(get(v, "$.verdict", "string").alias("verdict"), F.coalesce(number, share).alias("groundedness"), yes.alias("supported"), F.size(claims).alias("claims"))

    return F.get(F.transform(F.slice(able, -1, 1), read), F.lit(0))


def aggregate(rows: DataFrame) -> DataFrame:
    """``rows``: category, passed -> n and pass rate overall (null category) and per category."""
    return rows.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))
