import hashlib
import random

import numpy as np
import pyarrow as pa

from techpub_spark.llm import common, line_dedup


def test_a_large_bucket_sends_one_member_a_block():
    """What a bucket sends on does not grow with it; every different id but the smallest has one ray."""
    ids = sorted({hashlib.md5(b"%d" % (i % 5000)).digest() for i in range(20000)})
    again = random.Random(1).choices(ids, k=12000) + ids
    rows = pa.RecordBatch.from_arrays([pa.array(again, pa.binary()), pa.array([[7, -9]] * len(again), pa.list_(pa.int64()))], names=["id", "buckets"])
    sent = list(common._combined(iter([rows])))
    members = [x for b in sent for k, x in zip(b["kind"].to_pylist(), b["rows"].to_pylist(), strict=True) if k == 1]
    assert sum(map(len, members)) == 2 * 24
    order = sorted(((p, k, x) for b in sent for p, k, x in zip(*b.to_pydict().values(), strict=True)))
    packed = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*order, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "rows"])
    rays = [tuple(r.values()) for b in common._star_rows(iter([packed])) for r in b.to_pylist()]
    assert sorted(rays) == sorted((b, ids[0], i) for b in (7, -9) for i in ids[1:])


def test_components_end_with_the_round_that_made_stars(spark, monkeypatch):
    """A chain that one round contracts takes one round, none to confirm it."""
    made = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, heavy=False: made.append(name) or stored(df, name, heavy))
    got = common.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {1: 1, 2: 1, 3: 1}
    assert made == ["edges", "edges", "components"]


def test_tokens_of_many_lines():
    lines = ["abc", "the same line of text", "", "another line, longer than the first one", "the same line of text", "x"]
    for one, t in zip(lines, line_dedup.line_tokens.many(lines), strict=True):
        assert np.array_equal(line_dedup.line_tokens(one), t)


def _apart(rng, sizes):
    """Groups of token sets with their marks: some sets are alike, most are not."""
    rows = []
    for bucket, m in enumerate(sizes):
        base = [rng.getrandbits(64) for _ in range(120)]
        for k in range(m):
            kept = base[: rng.choice([60, 118, 119, 120])]
            t = np.unique(np.array([*kept, *[rng.getrandbits(64) for _ in range(rng.choice([1, 60]))]], np.uint64))
            i = hashlib.md5(b"%d %d" % (bucket, k)).digest()
            rows.append((bucket, 0, m, i, hashlib.md5(b"%d" % rng.randrange(m)).digest(), len(t), common.parity_sketch(t).tolist()))
    schema = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("id", pa.binary()), ("own", pa.binary()), ("size", pa.int32()), ("sketch", pa.list_(pa.int64()))])
    return rows, [pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[a : a + 50], strict=True), schema)], schema=schema) for a in range(0, len(rows), 50)]


def test_parts_give_every_pair_that_can_link():
    """Whole: all of them, by brute force.  Else a bounded number a member, which joins the same members, and the bucket's name."""
    rows, batches = _apart(random.Random(5), [2, 8, 9, 40, 150])
    bound = lambda x, y: x + y - 1.6 * np.maximum(x, y)
    bits = lambda x, y: sum(int(p ^ q).bit_count() for p, q in zip(*(np.array(r[6]).view(np.uint64).tolist() for r in (x, y)), strict=True))
    want = {frozenset((x[3], y[3])) for x in rows for y in rows if x[3] < y[3] and x[0] == y[0] and x[4] != y[4] and min(x[5], y[5]) >= 0.8 * max(x[5], y[5]) and bits(x, y) <= bound(x[5], y[5])}
    got = [r for b in common._near(0.8, bound, 6, True)(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(want) and {frozenset((r["a"], r["b"])) for r in got} == want
    some = [r for b in common._near(0.8, bound, 6, False)(iter(batches)) for r in b.to_pylist()]
    again = {r["bucket"] for r in some if r["a"] is None}
    pairs = {frozenset((r["a"], r["b"])) for r in some if r["a"] is not None}
    of = {r[3]: r[0] for r in rows}
    assert 4 in again and pairs <= want
    assert {p for p in pairs if of[min(p)] not in again} == {p for p in want if of[min(p)] not in again}
    assert all(sum(of[min(p)] == b for p in pairs) <= 6 * sum(r[0] == b for r in rows) for b in again)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Buckets of several parts: every link is found by the parts or by the prefix join, and no join makes rows of tokens."""
    from pyspark.sql import functions as F

    from techpub_spark.llm import near_dedup

    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(40)]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.choice([2, 9])):
                t[rng.randrange(40)] = rng.choice(words)
            texts.append(" ".join(t))
    by_id = {hashlib.md5(t.encode()).digest(): t for t in texts}
    table = spark.createDataFrame([(bytearray(i), t) for i, t in by_id.items()], "id binary, text string")
    members = spark.createDataFrame([(bytearray(i), [1, 2]) for i in by_id], "id binary, buckets array<long>")

    def verify(pairs, met):
        got = pairs.join(met.toDF("a", "ta"), "a").join(met.toDF("b", "tb"), "b")
        return got.select("a", "b", F.udf(lambda x, y: near_dedup.similarity(x, y, 0.8), "double")("ta", "tb").alias("sim"))

    ids = sorted(by_id)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near_dedup.similarity(by_id[a], by_id[b], 0.8) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    asked = []
    joined = common.prefix_pairs
    monkeypatch.setattr(common, "prefix_pairs", lambda *a: asked.append(1) or joined(*a))
    for part, joins in ((4096, 0), (16, 1)):
        monkeypatch.setattr(common, "PART", part)
        asked.clear()
        comp = common.bucket_components(members, verify, 0.8, lambda w: table.join(w, F.col("id") == F.col("of"), "left_semi"), near_dedup.word_tokens, lambda x, y: x + y - 1.6 * F.greatest(x, y), near_by=6)
        got = {bytes(r.node): bytes(r.root) for r in comp.collect()}
        assert {i: got.get(i, i) for i in ids} == {i: find(i) for i in ids} and len(asked) == joins
