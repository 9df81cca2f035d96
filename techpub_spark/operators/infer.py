"""Models as callables: batched, with attempts and a deadline, and memoised by model, revision and text.

A table of known answers lies beside the data; only texts that it does not know reach the model, each once,
however many rows have them.  What fails is not remembered.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import Folder


class Model(NamedTuple):
    """A model: ``call`` maps a batch of texts to answers of the Spark type ``kind``, one for each text.

    ``ok`` says whether an answer counts (a finished reply, a vector of the right length); others are asked again.
    """

    name: str
    revision: str
    call: Callable[[list[str]], list]
    kind: str
    ok: Callable[[object], bool] = lambda answer: answer is not None
    batch: int = 64
    attempts: int = 3
    deadline: float = 60.0


def hashed_vectors(dimension: int = 64) -> Model:
    """Deterministic stand-in for an embedding model: signed counts of a text's words by hash, of unit length."""

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return Model(f"hash-{dimension}", "1", call, "array<double>", lambda v: len(v) == dimension)


def answered(model: Model, texts: list[str], clock: Callable[[], float] = time.monotonic) -> list[tuple[object, str | None]]:
    """(answer, why there is none) of each text of one batch.

    All attempts share one deadline; a text whose answer does not count is asked again with the others that failed.
    """
    out: list[tuple[object, str | None]] = [(None, "not asked")] * len(texts)
    open_, until = list(range(len(texts))), clock() + model.deadline
    for _ in range(model.attempts):
        if not open_:
            break
        if clock() >= until:
            return [(a, "the deadline has passed") if a is None else (a, why) for a, why in out]
        try:
            got = model.call([texts[i] for i in open_])
            if len(got) != len(open_):
                raise ValueError(f"{len(got)} answers to {len(open_)} texts")
        except Exception as e:  # noqa: BLE001 - any fault of a model is an answer that failed
            for i in open_:
                out[i] = (None, f"{type(e).__name__}: {e}")
            continue
        still = []
        for i, answer in zip(open_, got, strict=True):
            good = answer is not None and model.ok(answer)
            out[i] = (answer, None) if good else (None, "an answer that does not count")
            if not good:
                still.append(i)
        open_ = still
    return out


def _path(root: str, model: Model) -> str:
    safe = "".join(c if c.isalnum() or c in "._-" else "_" for c in f"{model.name}@{model.revision}")
    return f"{root.rstrip('/')}/{safe}-{hashlib.sha256(f'{model.name}@{model.revision}'.encode()).hexdigest()[:8]}"


def known(spark: SparkSession, root: str, model: Model) -> DataFrame:
    """(digest, answer) that are remembered of a model and revision; of answers that were written twice, one."""
    kinds = f"digest string, answer {model.kind}"
    if not Folder(spark, _path(root, model)).has(""):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(_path(root, model)).groupBy("digest").agg(F.first("answer").alias("answer"))


def inferred(rows: DataFrame, text: str, model: Model, root: str) -> DataFrame:
    """``rows`` with ``answer`` and ``why`` (null where there is an answer); a null text has neither question nor answer.

    Texts without a remembered answer are asked in batches where they are, and what counts is written to ``root``
    before the rows are joined to it.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__digest", F.when(F.col(text).isNotNull(), F.sha2(F.col(text), 256)))
    asked = keyed.where("__digest is not null").groupBy(F.col("__digest").alias("digest")).agg(F.first(text).alias("text"))
    misses = asked.join(known(spark, root, model).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), model.batch):
                part = pdf.iloc[at : at + model.batch]
                got = answered(model, part["text"].tolist())
                yield pd.DataFrame({"digest": part["digest"].to_numpy(), "answer": pd.Series([a for a, _ in got], dtype=object), "why": [w for _, w in got]})

    path = _path(root, model)
    made = misses.mapInPandas(run, f"digest string, answer {model.kind}, why string")
    # one write holds answers and failures of this run, so that a text is asked once; failures are kept apart and not read again
    made.withColumn("failed", F.col("why").isNotNull()).write.mode("overwrite").parquet(path + ".run")
    run_ = spark.read.schema(f"digest string, answer {model.kind}, why string, failed boolean").parquet(path + ".run")
    run_.where("not failed").select("digest", "answer").write.mode("append").parquet(path)
    answers = known(spark, root, model).withColumn("why", F.lit(None).cast("string"))
    every = answers.unionByName(run_.where("failed").select("digest", "answer", "why"))
    return keyed.join(every.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
