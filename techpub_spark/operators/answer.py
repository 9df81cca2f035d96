"""Answering: gates around a pluggable model, adversarial scoring, figure checks and repair selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import affirmed, answer_object, normal_quote
from .figures import figure_ref

SHORTEST_QUOTE = 12
REPLY = "answerable boolean, answer string, citations array<struct<chunk_id:string,quote:string>>"


def threshold_gate(candidates: DataFrame, threshold: float) -> DataFrame:
    """Per query: refused if there is no candidate or the best score is strictly below the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies in 0..1")
    top = candidates.groupBy("query_id").agg(F.max("score").alias("top1"))
    return top.withColumn("refused", F.coalesce(F.col("top1") < threshold, F.lit(True)))


def excluded(candidates: DataFrame, kept: int, threshold: float, withheld: DataFrame) -> DataFrame:
    """Sources that did not reach the model and why; the code of an unauthorised one is redacted."""
    auth = withheld.select("query_id", F.lit(None).cast("string").alias("dmc"), F.lit("authorisation").alias("reason"))
    cut = candidates.where(F.col("rank") > kept).select("query_id", "dmc", F.lit("rerank cut").alias("reason"))
    low = candidates.where((F.col("rank") <= kept) & (F.col("score") < threshold)).select("query_id", "dmc", F.lit("below threshold").alias("reason"))
    return auth.unionByName(cut).unionByName(low)


def prompts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, prompt): question and evidence as JSON; a thinking tag in the evidence is escaped.

    ``evidence``: query_id, rank, id, text, a bounded number of rows a query.
    """
    e = evidence.groupBy("query_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "text"))), lambda x: F.struct(x["id"].alias("id"), F.replace(x["text"], F.lit("<think"), F.lit("&lt;think")).alias("text")))).alias("evidence"))
    return questions.join(e, "query_id").select("query_id", F.concat_ws("\n", F.lit("Answer only from the evidence."), "question", "evidence").alias("prompt"))


def generate(asked: DataFrame, model: Callable[[str], str], retries: int = 1) -> DataFrame:
    """(query_id, reply struct or null): the model is asked again up to ``retries`` times if the shape is wrong.

    Only rows that passed the gates before may be in ``asked``.
    """
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                text = None
                for _ in range(retries + 1):
                    text = model(p)
                    try:
                        if isinstance(json.loads(text[text.index("{") : text.rindex("}") + 1]).get("answerable"), bool):
                            break
                    except (ValueError, AttributeError):
                        continue
                out.append(text)
            yield pd.DataFrame({"query_id": pdf["query_id"], "reply": out})

    raw = asked.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, reply string")
    return raw.select("query_id", F.from_json(answer_object(F.col("reply")), REPLY).alias("reply"))


def citation_gate(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per citation: valid, or why not.  ``replies``: query_id, reply; ``evidence``: query_id, id, text.

    A quote must come from a retrieved chunk, have ``SHORTEST_QUOTE`` characters, and, with more than one
    chunk, not stand in every one of them.
    """
    cites = replies.select("query_id", F.posexplode("reply.citations").alias("pos", "c")).select("query_id", "pos", F.col("c.chunk_id").alias("cited"), normal_quote(F.col("c.quote")).alias("quote"))
    norm = evidence.select("query_id", "id", normal_quote(F.col("text")).alias("norm"))
    per = cites.join(norm, "query_id", "left").groupBy("query_id", "pos", "cited", "quote").agg(
        F.max(F.col("id") == F.col("cited")).alias("known"), F.max((F.col("id") == F.col("cited")) & F.contains("norm", F.col("quote"))).alias("found"),
        F.min(F.contains("norm", F.col("quote"))).alias("everywhere"), F.count("id").alias("n"),
    )
    why = (
        F.when(~F.coalesce("known", F.lit(False)), "not retrieved").when(F.char_length("quote") < SHORTEST_QUOTE, "quote too short")
        .when(~F.coalesce("found", F.lit(False)), "quote not in chunk").when((F.col("n") > 1) & F.col("everywhere"), "boilerplate")
    )
    return per.select("query_id", "pos", "cited", "quote", why.alias("reason"))


#: Words of an answer that claim nothing about a figure.
PLAIN_WORDS = (
    "a an the this that these those is are was were be been being of to in on at for and or but not no its it their there here as with from by "
    "into onto per each any one two three four five six seven eight nine ten zero first second third only both which what where when who whom how "
    "many much number numbers value values figure figures illustration illustrations image images diagram drawing shown show shows showing "
    "depicts depicted marks marked mark called call callout callouts identified identifies identify labelled labeled label labels part parts "
    "hotspot hotspots item items component components section point points area areas "
).split()
WORD = "[a-z][a-z-]+"


def ungrounded(answer_words: Column, pool_words: Column, stop: Column) -> Column:
    """Words of an answer that neither the evidence, nor the question, nor the stop words hold."""
    return F.array_except(F.array_except(answer_words, stop), pool_words)


def figure_claims(answer_: Column, grounding: Column) -> Column:
    """What an answer from figures says that ``grounding`` (their texts and the question) does not: words, part numbers, measures."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
    return F.array_union(F.array_distinct(ungrounded(words(answer_), words(grounding), F.lit(PLAIN_WORDS))), invented(answer_, grounding))


def figure_verified(described: Column, declared: Column, parts: Column, read_text: Column, refused: Column) -> Column:
    """The described and declared ids are the same set and each declared part is a whole token of the text read."""
    tokens = F.transform(F.split(read_text, r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    same = F.array_sort(F.array_distinct(described)) == F.array_sort(F.array_distinct(declared))
    return ~refused & same & (F.size(F.array_except(parts, tokens)) == 0)


def consensus(reads: DataFrame, k: int) -> DataFrame:
    """The first signature that is read ``k`` times, in attempt order: figure_id, signature, attempt.  Null if none."""
    w = Window.partitionBy("figure_id", "signature").orderBy("attempt")
    hit = reads.where("signature is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") == k)
    first = hit.groupBy("figure_id").agg(F.min_by(F.struct("signature", "attempt"), "attempt").alias("h"))
    return reads.select("figure_id").distinct().join(first, "figure_id", "left").select("figure_id", "h.signature", "h.attempt")


def behaviour(cases: DataFrame) -> DataFrame:
    """Pass or fail of adversarial cases, why, and the gate that a wrongly answered one slipped through.

    ``cases``: id, category, expected (answer, refuse, clarify), outcome (answered, refused), answer, must_state,
    must_not_state (arrays; null counts as empty).
    """
    empty = F.array().cast("array<string>")
    text = F.coalesce("answer", F.lit(""))
    refused = F.col("outcome") == "refused"
    wrong = F.exists(F.coalesce("must_not_state", empty), lambda v: affirmed(text, v))
    stated = F.transform(F.coalesce("must_state", empty), lambda v: F.contains(F.lower(text), F.lower(F.trim(v))))
    complete = F.forall(stated, lambda x: x)
    note = (
        F.when((F.col("expected") == "refuse") & refused, "+refused as required").when(F.col("expected") == "refuse", "-answered what should be refused")
        .when((F.col("expected") == "answer") & refused, "-refused what can be answered").when((F.col("expected") == "answer") & ~complete, "-a required fact is missing")
        .when((F.col("expected") == "answer") & wrong, "-affirmed a forbidden value").when(F.col("expected") == "answer", "+answered")
        .when(refused, "+refused a wrong premise").when(wrong, "-affirmed a wrong premise").when(F.exists(stated, lambda x: x), "+corrected a wrong premise").otherwise("+did not affirm a wrong premise")
    )
    out = cases.withColumn("note", F.substring(note, 2, 80)).withColumn("passed", F.startswith(note, F.lit("+")))
    return out.withColumn("slipped", F.when(~F.col("passed") & (F.col("expected") != "answer") & ~refused, "all gates"))


def rates(rows: DataFrame, by: str, flag: str) -> DataFrame:
    """Rate overall (null group) and per group in one pass."""
    r = F.round(F.avg(F.col(flag).cast("double")), 4)
    return rows.rollup(by).agg(F.count("*").alias("n"), r.alias("rate"))


#: Shapes of part numbers and measurements that an answer must not invent.
PART_TOKEN, MEASURE = r"\b[A-Z]{1,4}-\d+(?:-\d+)+\b", r"(?i)\b\d+(?:\.\d+)?\s?(?:mm|cm|nm|kg|°|deg|degrees?)\b"


def invented(answer_: Column, grounding: Column) -> Column:
    """Part numbers and measurements of an answer that the grounding text does not hold."""
    found = F.array_union(F.regexp_extract_all(answer_, F.lit(PART_TOKEN), F.lit(0)), F.regexp_extract_all(answer_, F.lit(MEASURE), F.lit(0)))
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.filter(found, lambda t: ~F.contains(flat(grounding), flat(t)))


def shown_citations(gated: DataFrame, evidence: DataFrame) -> DataFrame:
    """Valid citations for display, the first quote per chunk: query_id, id, quote, and what ``evidence`` knows of it.

    ``gated``: as ``citation_gate`` gives it; ``evidence``: query_id, id, dmc, source_path, chunk_type, icn_refs, text.
    """
    first = gated.where("reason is null").groupBy("query_id", F.col("cited").alias("id")).agg(F.min_by("quote", "pos").alias("quote"), F.min("pos").alias("pos"))
    own = first.join(evidence.select("query_id", "id", "dmc", "source_path", "chunk_type", "icn_refs"), ["query_id", "id"])
    return own.withColumn("figure_ref", figure_ref(F.col("chunk_type"), F.get("icn_refs", 0), F.col("quote")))


def answer_questions(questions: DataFrame, evidence: DataFrame, model: Callable[[str], str], threshold: float) -> DataFrame:
    """The two-outcome pipeline: query_id, refused, gate, detail, answer, citations.

    ``questions``: query_id, question; ``evidence``: the reranked rows of each, with query_id, rank, id, score, text,
    dmc, source_path, chunk_type, icn_refs.  Gates in order, by the names that ``governance.RESOLUTIONS`` knows:
    ``threshold`` (no evidence, or a best score under it); ``llm-contract`` (a reply of the wrong shape); ``llm`` (the
    model's own refusal); ``citation-validation`` (no answer, no citation, or one that does not hold: one is enough);
    ``figure-out-of-description`` (only figures are cited and they, with the question, do not hold a word, part number
    or measure of the answer; and instead of the two before it where the best evidence is a figure).  ``detail``
    says what was wrong.  The model sees only questions that passed the gates before it.
    """
    top = threshold_gate(evidence, threshold)
    asked = questions.join(top.where(~F.col("refused")).select("query_id"), "query_id", "left_semi")
    replies = generate(prompts(asked, evidence), model)
    gated = citation_gate(replies, evidence)
    bad = gated.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("why"))
    shown = shown_citations(gated, evidence)
    cited = shown.join(evidence.select("query_id", "id", "text"), ["query_id", "id"]).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "dmc", "source_path", "quote", "figure_ref"))).alias("citations"),
        F.min(F.col("chunk_type") == "figure").alias("figures"), F.concat_ws(" ", F.collect_list("text")).alias("grounding"))
    every = questions.join(top, "query_id", "left").join(replies, "query_id", "left").join(bad, "query_id", "left").join(cited, "query_id", "left")
    best = evidence.groupBy("query_id").agg((F.min_by("chunk_type", "rank") == "figure").alias("pictured"))
    every = every.join(best, "query_id", "left")
    loose = figure_claims(F.col("reply.answer"), F.concat_ws(" ", "grounding", "question"))
    silent = (F.trim(F.coalesce("reply.answer", F.lit(""))) == "") | F.col("n").isNull()
    figure, pictured = F.lit("figure-out-of-description"), F.coalesce("pictured", F.lit(False))
    gate = (
        F.when(F.coalesce("refused", F.lit(True)), "threshold").when(F.col("reply.answerable").isNull(), "llm-contract")
        .when(~F.col("reply.answerable"), F.when(pictured, figure).otherwise("llm"))
        .when(silent | F.col("why").isNotNull(), F.when(pictured, figure).otherwise("citation-validation"))
        .when(F.coalesce("figures", F.lit(False)) & F.coalesce(F.size(loose) > 0, F.lit(False)), figure)
    )
    asked_ = F.col("reply.answerable")
    detail = F.when(asked_ & silent, "no answer with a citation").when(asked_ & F.col("why").isNotNull(), F.col("why")).when(asked_, F.concat(F.lit("not in the figures: "), F.array_join(F.array_sort(loose), ", ")))
    return every.select("query_id", gate.isNotNull().alias("refused"), gate.alias("gate"), F.when(gate.isNotNull(), detail).alias("detail"), F.when(gate.isNull(), F.trim("reply.answer")).alias("answer"), F.when(gate.isNull(), F.col("citations")).alias("citations"))


def select_repair(candidates: DataFrame, veto: float = 0.5) -> DataFrame:
    """Best verified candidate per finding: least deleted, then role order, then the diff itself.

    ``candidates``: finding, role_order, diff, source_lines, verified.  One that deletes more than ``veto`` of its
    source is out, and so is one whose source is not known (null).
    """
    lines = F.split("diff", "\n")
    gone = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))))
    read = F.when(F.col("source_lines").isNotNull(), F.greatest("source_lines", F.lit(1)))
    ok = candidates.withColumn("deleted", gone / read).where(F.col("verified") & (F.col("deleted") <= veto))
    return ok.groupBy("finding").agg(F.min(F.struct("deleted", "role_order", "diff")).alias("best")).select("finding", "best.*")
