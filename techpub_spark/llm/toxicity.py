"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs (full-width, Cyrillic and Greek look-alikes) and digit or sign substitutions
to plain letters, and drops zero-width characters.  The lexicon holds word beginnings; each has the
log-odds of its training documents as weight.  Exception phrases (a hit with the word before or after
it that training shows to be harmless, or given ones) are patterns of the same automaton and cancel
the hits inside them.  The hits' weights are summed, damped by the logarithm of the text's length and
turned into a probability by two coefficients.

Training reads at most ``max_rows`` labelled documents (the bound; chosen by a hash of the id, so the
choice does not depend on the data's order): terms are counted by a distributed aggregate, and only
terms that pass the thresholds, at most ``max_terms``, reach the driver.  Scoring reads every text whole.
Chosen style: Arrow batches for scoring, no shuffle; the model (bounded) travels with the function.

Defined results: a null or empty text has no hits and the score of a text without any; unlabelled or
null-labelled rows don't train; no labels or one class only give an empty lexicon and the score 0;
repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Look-alikes of Latin letters, and signs used for letters inside words.
LOOKS = dict(zip("авекмнорстухіѕјԁɡαβεικνορτυχ", "abekmhopctyxisjdgabeiknoptux", strict=True))
DIGITS = str.maketrans("013457@$", "oieastas")
GONE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
TABLE = {ord(a): b for a, b in LOOKS.items()} | GONE
MIXED = re.compile(r"[^\W_]*[0-9@$][\w@$]*")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower-case words of ``text``, look-alikes and substitutions folded, one blank before each."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = text.lower().translate(TABLE)
    else:
        text = text.lower()
    text = MIXED.sub(lambda m: m[0].translate(DIGITS) if any(c.isalpha() for c in m[0]) else m[0], text)
    return " " + " ".join(WORD.findall(text)) + " "


@dataclass
class Model:
    """Word beginnings with their weights, harmless phrases, and the two coefficients of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    base: float = -50.0
    slope: float = 1.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, w in self.weights.items():
            a.add_word(" " + word, (len(word), w))
        for phrase in self.exceptions:
            a.add_word(" " + phrase + " ", (len(phrase), None))
        a.make_automaton()
        return a

    def raw(self, folded: str, automaton) -> tuple[float, int]:
        """Damped sum of the hits' weights, and their number."""
        if not len(automaton):
            return 0.0, 0
        hits, spared = [], []
        for end, (n, w) in automaton.iter(folded):
            if w is None:
                spared.append((end - n - 1, end))
            else:
                hits.append((end - n + 1, end, w))
        if spared:
            spared.sort()
            reach = list(accumulate((e for _, e in spared), max))  # how far the phrases up to here go
            hits = [h for h in hits if not (k := bisect_right(spared, (h[0], math.inf))) or reach[k - 1] < h[1]]
        if not hits:
            return 0.0, 0
        return sum(w for _, _, w in hits) / math.log2(2 + len(folded) / 1000), len(hits)

    def score(self, raw: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.base + self.slope * raw))))


def held_out(doc_id: object) -> bool:
    """True if a row must not train."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def terms_of(folded: str, shortest: int = 4, longest: int = 12) -> set[str]:
    """The distinct word beginnings of a text."""
    out: set[str] = set()
    for w in set(folded.split()):
        out.update(w[:k] for k in range(shortest, min(len(w), longest) + 1))
    return out


def fit(base: float, slope: float, data: list[tuple[float, int]], rounds: int = 40) -> tuple[float, float]:
    """Two coefficients of a logistic curve, by damped Newton steps with a small ridge."""
    for _ in range(rounds):
        g0 = g1 = 0.0
        h00 = h11 = 1e-3
        h01 = 0.0
        for x, y in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, base + slope * x))))
            d, v = p - y, p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1 = g0 + 1e-3 * base, g1 + 1e-3 * slope
        det = h00 * h11 - h01 * h01
        s0, s1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        top = max(1.0, abs(s0), abs(s1))
        base, slope = base - s0 / top, slope - s1 / top
        if max(abs(s0), abs(s1)) < 1e-6:
            break
    return base, slope


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 5_000, least: int = 4, purity: float = 0.99, common: float = 0.04, exceptions: tuple[str, ...] = ()) -> Model:
    """Learn the lexicon, its weights and the score's coefficients from at most ``max_rows`` labelled rows.

    A term needs ``least`` toxic documents and ``purity``; it enters if it is in a share ``common`` of the
    toxic documents or explains one that no other term explains.
    """
    y = (
        labels.where("toxic is not null and doc_id is not null")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_rows)
    )
    # the bounded sample is read once from the documents and kept
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", F.col("y").cast("int").alias("y")), "toxic_sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in terms_of(fold(text or "")):
                    counts.setdefault(t, [0, 0])[1 if label else 0] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), *[pa.array([c[i] for c in counts.values()], pa.int64()) for i in (0, 1)]], names=["term", "clean", "toxic"])

    total = {bool(r[0]): r[1] for r in sample.groupBy(F.col("y") > 0).count().collect()}
    if not total.get(True) or not total.get(False):
        return Model({}, exceptions)
    odds = (F.col("toxic") + 0.5) / (total[True] + 1) / ((F.col("clean") + 0.5) / (total[False] + 1))
    found = (
        sample.mapInArrow(spread, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("weight", F.log(odds))
        .where((F.col("toxic") >= least) & (F.col("toxic") / total[True] >= purity / (1 - purity) * F.col("clean") / total[False]))
        .orderBy(F.col("toxic").desc(), "term").limit(max_terms).collect()
    )
    good = {r["term"]: r["weight"] for r in found}
    # the shortest pure beginning stands for its extensions
    short = {t: w for t, w in good.items() if t[:-1] not in good}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms_of(fold(t or "")) & short.keys()) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

    # at most max_rows short lists: which of the terms each toxic document of the sample holds
    lists = [set(r["terms"]) for r in sample.where("y > 0").select("text").mapInArrow(holds, "terms array<string>").collect()]
    often = {t for t in short if sum(t in x for x in lists) >= max(least, common * len(lists))}
    model = Model({t: short[t] for t in sorted(often | set(cover(lists, short, 1)))}, exceptions)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for batch in batches:
            xs, near = [], []
            for text in batch.column(0).to_pylist():
                folded = fold(text or "")
                x, n = model.raw(folded, auto)
                xs.append(x)
                near.append(phrases(folded, model, auto) if n else [])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.float64()), batch.column(1), pa.array(near, pa.list_(pa.string()))], names=["x", "y", "near"])

    seen = sample.mapInArrow(probe, "x double, y int, near array<string>")
    harmless = (
        seen.select("y", F.explode("near").alias("phrase")).groupBy("phrase")
        .agg(F.count_if(F.col("y") > 0).alias("bad"), F.count_if(F.col("y") == 0).alias("ok"))
        .where("ok >= 3 and bad = 0").orderBy(F.col("ok").desc(), "phrase").limit(max_terms)
    )
    model.exceptions = tuple(sorted({*exceptions, *(r["phrase"] for r in harmless.collect())}))
    # one pair of numbers a row, at most max_rows
    data = [(r["x"], 1 if r["y"] else 0) for r in seen.select("x", "y").collect()]
    model.base, model.slope = fit(-3.0, 1.0, data)
    return model


def cover(lists: list[set[str]], weights: dict[str, float], least: int) -> list[str]:
    """Terms that each explain at least ``least`` documents that no term before explains.

    Copies of one toxic document share all their words; once its true term is taken, the others explain
    nothing more.
    """
    left = [set(x) for x in lists]
    out = []
    while True:
        n: dict[str, int] = {}
        for x in left:
            for t in x:
                n[t] = n.get(t, 0) + 1
        best = max(n, key=lambda t: (n[t], weights[t], t), default=None)
        if best is None or n[best] < least:
            return out
        out.append(best)
        left = [x for x in left if best not in x]


def phrases(folded: str, model: Model, automaton) -> list[str]:
    """The two-word phrases around each hit."""
    out = []
    for end, (n, w) in automaton.iter(folded):
        if w is None:
            continue
        start, stop = end - n + 1, folded.index(" ", end)
        before, after = folded.rfind(" ", 0, start - 1), folded.find(" ", stop + 1)
        if before >= 0 and start > 1:
            out.append(folded[before + 1 : stop])
        if after > 0:
            out.append(folded[start:after])
    return sorted(set(out))


def score_toxicity(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, hits."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = model.automaton()
        for batch in batches:
            raws = [model.raw(fold(t.as_py() or ""), auto) for t in batch.column(1)]
            scores = [model.score(x) if model.weights else 0.0 for x, _ in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= cut) for s in scores], pa.int32()), pa.array([n for _, n in raws], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "hits"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int, hits long")
