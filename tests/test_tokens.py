import random
import re

from pyspark.sql import functions as F

from techpub_spark.functions.text import tokenize


def reference(text):
    out = []
    for run in re.findall(r"[A-Za-z0-9]+(?:[-/_][A-Za-z0-9]+)*", text):
        out += [run.lower()] if re.search("[-/_]", run) and re.search("[0-9]", run) else re.split("[-/_]", run.lower())
    return out


def test_tokens_of_odd_runs(spark):
    """Tokens equal the two-step rule, also of a joined run of any length, which a nested group can't match."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1-/_ éK.0") for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["-".join(["ab"] * 100_000), "-".join(["ab"] * 20_000) + "-1", "", "a--1", "-a1-", "x1-foo", "foo-bar-1_z/", "a-" * 40 + "-1"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize(F.col("t")).alias("ts")).collect()
    assert all(r.ts == reference(texts[r.i]) for r in got) and len(got) == len(texts)
