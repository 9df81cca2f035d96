"""Windows of words by their places, against packing word by word."""

import random
import time

from pyspark.sql import functions as F

from techpub_spark.operators import chunking


def slow(text, size, overlap):
    """The rule, word by word."""
    out, cur = [], []
    length = lambda ws: sum(map(len, ws)) + max(0, len(ws) - 1)
    for w in (w[i : i + size] for w in text.split(" ") if w for i in range(0, len(w), size)):
        if length([*cur, w]) <= size:
            cur.append(w)
            continue
        out.append(" ".join(cur))
        kept = []
        for x in reversed(cur):
            if length([x, *kept]) > overlap or length([x, *kept]) + 1 + len(w) > size:
                break
            kept.insert(0, x)
        cur = [*kept, w]
    return out + [" ".join(cur)] * bool(cur)


def test_windows_by_places(spark):
    rng = random.Random(2)
    texts = [" ".join("é😀abc"[rng.randrange(5)] * rng.choice((1, 2, 3, 7, 12, 30)) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", " ", None, "a\t b\n\nc"]
    for size, overlap in ((10, 3), (12, 0), (25, 24), (7, 9)):
        assert [chunking.packed(t, size, overlap) for t in texts[:200]] == [slow(t, size, overlap) for t in texts[:200]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.w for r in rows.select("i", chunking.windows(F.col("t"), 12, 5).alias("w")).collect()}
    assert got[203] == ["a b c"] and got[202] is None and got[200] == got[201] == []
    assert all(got[i] == slow(t, 12, 5) for i, t in enumerate(texts[:200]))


def test_windows_of_a_long_text_take_their_length(spark):
    one = lambda n: spark.range(1).select(F.array_join(F.array_repeat(F.lit("word"), n), " ").alias("t")).select(F.size(chunking.windows(F.col("t"), 100_000, 50_000)).alias("n"))
    one(10).collect()
    began = time.time()
    assert one(60_000).first().n == 5 and time.time() - began < 20
