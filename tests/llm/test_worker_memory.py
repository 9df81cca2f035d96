import inspect

from techpub_spark.llm import common, near_dedup, packing


def test_the_word_cache_stays_small_and_gives_the_same_ids():
    """Of any number of distinct words, a worker keeps a bounded number; frequent ones stay, and no id changes."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert inspect.signature(packing.WordEncoder).parameters["most"].default <= 1 << 17
    small, large = packing.WordEncoder(path, 64), packing.WordEncoder(path, 1 << 30)
    for k in range(200):
        text = "the same words, " + " ".join(f"x{(k * 7 + i) % 900}y" for i in range(20))
        assert small.encode(text) == large.encode(text)
        assert len(small.seen) <= 64 and len(small.seen) + len(getattr(small, "before", {})) <= 128
        assert "same" in small.seen
    many = " ".join(f"w{i}" for i in range(500))  # more than the cache at once
    assert small.encode(many) == large.encode(many)
    assert small.encode("the same") == large.encode("the same")


def test_sketches_and_stars_share_a_worker(spark, monkeypatch):
    """The first step of near_dedup takes one Python worker a task, not two in a row."""
    plans, stored = [], common.stored

    def seen(df, name, heavy=False):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return stored(df, name, heavy)

    monkeypatch.setattr(common, "stored", seen)
    words = [f"word{i}" for i in range(40)]
    rows = [(k, " ".join(words[: 38 + k])) for k in range(3)] + [(9, None)]
    got = near_dedup.document_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {0: 0, 1: 0, 2: 0, 9: 9}
    star = next(p for name, p in plans if name == "star")
    assert star.count("MapInArrow") == 2  # sketches with stars of a task; stars of a part
