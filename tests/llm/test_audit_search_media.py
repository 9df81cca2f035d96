"""Source divergence, ranked search and media columns against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from techpub_spark.llm import divergence, media, ranked_search
from techpub_spark.llm.terms import LETTERS, WORDS, pieces, split_terms

DOCS = "doc_id long, text string, lang string, source string"


def lowered(found):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def letters(text):
    return lowered(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))


def words(text):
    return lowered(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))


def corpus(seed, n=160, vocabulary=60, sources="abcd"):
    r = random.Random(seed)
    names = [f"{chr(97 + i % 26)}{'é' if i % 7 == 0 else 'x'}{chr(97 + i // 26)}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        k = min(vocabulary - 1, int(r.expovariate(0.08)))
        text = " ".join(r.choice([names[min(vocabulary - 1, int(r.expovariate(0.1)))], names[k], names[k].upper(), "1x", "-"]) for _ in range(r.randrange(60)))
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice([*sources, *sources[:1] * 4, None])))
    return rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZ0é😀 -\n[`{@", max_size=12)), max_size=6))
def test_split_terms(texts):
    for table, rule in ((LETTERS, letters), (WORDS, words)):
        terms, row = split_terms(pa.array(texts, pa.string()), table)
        assert [(int(r), t) for r, t in zip(row, terms.to_pylist())] == [(i, t) for i, x in enumerate(texts) for t in rule(x)]


def test_split_terms_of_a_slice_and_pieces():
    texts = pa.array(["ab cd", None, "", "éf", "x" * 50])
    terms, row = split_terms(texts.slice(1, 3), WORDS)
    assert terms.to_pylist() == ["éf"] and row.tolist() == [2]
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    assert [p.num_rows for p in pieces(batch, "text", 8)] == [4, 1]
    assert [p.num_rows for p in pieces(batch, "text", 1)] == [1, 2, 1, 1]


def brute_audit(rows, least, ranks):
    rows = [(letters(t), g or "", s or "") for _, t, g, s in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), {(g, s) for _, g, s in rows}
    for t, g, _ in rows:
        df[g].update(set(t))
    kept = {g: [t for t, c in df[g].items() if c >= least] for g in {g for g, _ in groups}}
    for t, g, s in rows:
        use = [x for x in t if df[g][x] >= least]
        n[g, s].update(use)
        n[g].update(use)

    def p(key, lang):
        whole = sum(n[key].values())
        return {t: 1 + 1000000000 * (n[key][t] + 5) // (whole + 5 * len(kept[lang])) for t in kept[lang]}

    out = []
    for g, s in groups:
        own, all_of = p((g, s), g), p(g, g)
        pairs = [(o, sum(abs(own[t] - q) for t, q in p((g, o), g).items())) for lang, o in groups if lang == g and o != s]
        terms = [(t, own[t] - all_of[t]) for t in kept[g] if n[g, s][t] > 0 and own[t] > all_of[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
            for k, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out.append((g, s, part, item, value, k))
    return sorted(out)


@pytest.mark.parametrize("seed,least,width", [(1, 5, divergence.WIDTH), (2, 12, divergence.BLOCK), (3, 200, divergence.BLOCK)])
def test_audit_against_brute_force(spark, seed, least, width):
    rows = corpus(seed)
    rows += [rows[3], (1, None, "en", "only"), (2, "", "xx", "a"), (None, "solo", "yy", "a"), (7, "zz " * 3000, "en", "a")]
    docs = spark.createDataFrame([(*r, 0, "w") for r in rows], DOCS + ", n int, term string").repartition(5)
    got = divergence.audit_divergence(docs, least=least, ranks=6, width=width)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, least, 6)


def test_audit_of_nothing(spark):
    assert divergence.audit_divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_sketch_never_says_too_little(spark):
    rows = corpus(5, 300)
    docs = spark.createDataFrame(rows, DOCS).na.fill("", ["text", "lang"]).repartition(7)
    df = defaultdict(Counter)
    for _, t, g, _ in rows:
        df[g or ""].update(set(letters(t)))
    for width in (divergence.BLOCK, 4 * divergence.BLOCK):
        sketch = divergence.document_sketch(docs, 20, width, 2)
        for g, counts in df.items():
            low = sketch[divergence.cells(g, list(counts), width, 2)].min(axis=0)
            assert (low >= np.minimum(list(counts.values()), 20)).all()
            assert (low == np.minimum(list(counts.values()), 20)).mean() > 0.9  # few collisions here


def test_shares_do_not_overflow(spark):
    df = spark.createDataFrame([(10**16, 10**17, 10**9)], "n long, w long, v long")
    assert df.select(divergence.share("n", "w", "v")).first()[0] == 1 + 10**9 * (10**16 + 5) // (10**17 + 5 * 10**9)


# ranked search


def brute_search(docs, items, k=10):
    terms = [(d, Counter(words(t))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    n_docs, n_terms = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,shard,query_bytes", [(1, 64 << 20, 4 << 20), (2, 2000, 100), (3, 1, 40)])
def test_search_against_brute_force(spark, seed, shard, query_bytes, monkeypatch):
    rows = [(d, t) for d, t, _, _ in corpus(seed, 250)]
    rows += [rows[5], rows[5], (None, rows[6][1]), (None, None), (-4, rows[6][1]), (900, "ax " * 5000), (901, ""), (902, "only here")]
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(words(rows[r.randrange(200)][1]) or ["q"]) for _ in range(r.randrange(30)))) for i in range(12)]
    items += [(50, None), (51, "..."), (52, "nowhere"), (53, "only only ONLY"), (None, "ax"), (54, "ax " * 400)]
    monkeypatch.setattr(ranked_search, "SHARD", shard)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, score int, item int").repartition(3)
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    got = ranked_search.ranked_search(docs, asked, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.ranked_search(docs, items).collect() == []
    assert ranked_search.ranked_search(items.toDF("doc_id", "text"), docs.toDF("item_id", "text")).collect() == []


def cost(values, cuts, price):
    return sum(max(values[a:b]) * (b - a) - sum(values[a:b]) + price for a, b in zip(cuts, cuts[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), max_size=9), max_size=4), st.integers(1, 60))
def test_blocks_have_the_least_error(lists, price):
    flat = np.array([x for one in lists for x in one], np.int64)
    ptr = np.cumsum([0, *map(len, lists)])
    cut = ranked_search.variable_blocks(flat, ptr, price)
    for one, a, b in zip(lists, ptr, ptr[1:]):
        if one:
            own = [int(c) - a for c in cut if a <= c < b] + [len(one)]
            masks = ([0, *[i for i in range(1, len(one)) if m >> i & 1], len(one)] for m in range(0, 1 << len(one), 2))
            assert own[0] == 0 and cost(one, own, price) == min(cost(one, c, price) for c in masks)


def test_long_lists_are_cut_whole():
    x = np.random.default_rng(1).integers(1, 1000, 5000)
    cut = ranked_search.variable_blocks(x, np.array([0, 0, 4990, 5000]), 2000)
    assert cut[0] == 0 and cut[-1] == 5000 and 4990 in cut and (np.diff(cut) > 0).all() and np.diff(cut).max() <= ranked_search.LONGEST
    assert cost(x, cut, 2000) < cost(x, range(0, 5001, 10), 2000)


def test_search_skips_blocks():
    r = np.random.default_rng(3)
    docs, sizes = 40000, np.full(40000, 50)
    code = np.repeat(np.arange(6), 15000)
    doc = np.concatenate([r.choice(docs, 15000, replace=False) for _ in range(6)])
    rare = np.repeat([10, 11, 12], 12), np.tile(r.choice(docs, 12, replace=False), 3)  # a dozen documents with three rare terms
    shard = ranked_search.Shard(np.concatenate([code, rare[0]]), np.concatenate([doc, rare[1]]), sizes, 13, docs, 50 * docs)
    found, _ = shard.search(np.array([0, 1, 2, 3, 4, 5, 10, 11, 12]), np.array([900] * 6 + [6000] * 3), 10)
    assert set(found) <= set(rare[1]) and shard.read < 0.2 * len(shard.doc)


# media columns


def test_wav():
    for n in (0, 1, 192, 577):
        raw = bytes(i % 251 for i in range(n))
        assert media.wav_samples(media.wav_bytes(raw)) == (raw, media.RATE)
    tagged = media.wav_bytes(b"ab")
    tagged = tagged[:36] + b"LIST\x03\0\0\0abc\0" + tagged[36:]
    assert media.wav_samples(tagged)[0] == b"ab"
    for bad in (b"", b"RIFFxxxxWAVE", tagged[:22] + b"\2" + tagged[23:]):
        with pytest.raises(ValueError):
            media.wav_samples(bad)


@pytest.mark.parametrize("up,down", [(1, 3), (2, 3), (3, 2), (5, 1), (1, 1), (160, 441), (4, 6)])
@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_resampling_against_definition(up, down, n):
    x = np.random.default_rng(n).normal(size=n)
    g = math.gcd(up, down)
    u, d = up // g, down // g
    got = media.resampled(x, up, down)
    if u == d:
        assert (got == x).all()
        return
    h = media.lowpass(u, d)
    stuffed = np.zeros(n * u)
    stuffed[::u] = x
    full = np.convolve(np.concatenate([stuffed, np.zeros(len(h))]), h)[len(h) // 2 :]
    assert np.allclose(got, full[: n * u : d], atol=1e-12)


def test_resampling_keeps_tones():
    t = np.arange(4800)
    low, high = np.sin(2 * np.pi * 1000 * t / 48000), np.sin(2 * np.pi * 12000 * t / 48000)
    assert np.allclose(media.resampled(low, 1, 3)[50:-50], low[::3][50:-50], atol=0.01)
    assert np.abs(media.resampled(high, 1, 3)[50:-50]).max() < 0.01


def test_log_mel():
    x = np.sin(2 * np.pi * 2000 * np.arange(16000) / 16000)
    mel, energy = media.log_mel(x)
    assert mel.shape == (99, media.BANDS) and energy.shape == (99,)
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 8000 / 700), media.BANDS + 2)[1:-1] / 2595) - 1)
    assert abs(centre[mel[50].argmax()] - 2000) < 150
    y = np.concatenate([x[:1], x[1:] - media.EMPHASIS * x[:-1]])[1600:2000]
    dft = [abs(sum(y * np.hanning(400) * np.exp(-2j * np.pi * k * np.arange(400) / 512))) ** 2 for k in range(257)]
    assert np.allclose(mel[10], np.log(np.maximum(np.array(dft) @ media.mel_bank(), media.FLOOR)))
    assert media.log_mel(np.zeros(1))[0].shape == (1, media.BANDS)
    big = np.random.default_rng(1).normal(size=media.HOP * (media.CHUNK + 9))
    assert np.allclose(media.log_mel(big)[0][media.CHUNK], media.log_mel(big[media.CHUNK * media.HOP - 1 :])[0][0], atol=2)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=25))
def test_spans(energy):
    on, want, begin = False, [], 0
    for i, e in enumerate(energy):
        if not on and e >= 6:
            on, begin = True, i
        elif on and e < 3:
            on = False
            want.append((begin, i))
    assert media.sound_spans(np.array(energy, float), 6, 3) == want + [(begin, len(energy))] * on


def test_media_round_trip(spark, tmp_path):
    texts = [None, "", "a", "Grüße 😀" * 30, "x" * 192, "y" * 193, "lorem ipsum " * 6000, "a", "Grüße 😀" * 30]
    docs = spark.createDataFrame([(i if i else None, t, 0, b"m") for i, t in enumerate(texts)], "doc_id long, text string, frames int, media binary").repartition(3)
    kept = media.store_media(docs)
    assert kept.columns == ["doc_id", "n_bytes", "media"]
    full = media.audio_features(kept)
    full.write.parquet(f"{tmp_path}/features")
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/features").collect()}
    digest = {r["doc_id"]: r for r in full.select(*media.media_digest()).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw, r, d = (t or "").encode(), rows[i or None], digest[i or None]
        want = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert bytes(r["payload"]) == want == media.wav_samples(bytes(r["media"]))[0]
        assert (d["n_bytes"], d["payload_bytes"], d["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert (d["tail_crc32"], d["media_bytes"], d["media_sha256"]) == (zlib.crc32(want[-16:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        tensors = media.read_tensors(bytes(r["tensors"]))
        assert tensors.schema.field("tensor").type == media.SHAPE
        cube = tensors["tensor"].combine_chunks().to_numpy_ndarray()
        assert cube.shape == (-(-r["frames"] // media.FRAMES), media.FRAMES, media.BANDS) and sum(tensors["frames"].to_pylist()) == r["frames"]
        x = media.resampled((np.frombuffer(want, np.uint8).astype(float) - 128) / 128, 1, 3)
        mel, energy = media.log_mel(x)
        assert np.allclose(cube.reshape(-1, media.BANDS)[: len(mel)], mel, atol=6e-4)
        assert tensors["start"][0].as_py() == 0 and math.isclose(tensors["end"].to_pylist()[-1], ((len(mel) - 1) * 160 + 400) / 16000)
        assert [(s["start"], s["end"]) for s in r["spans"]] == [(a / 100, ((b - 1) * 160 + 400) / 16000) for a, b in media.sound_spans(energy)]
    assert digest[2]["feature"] == digest[7]["feature"] and digest[3]["feature"] == digest[8]["feature"] and digest[4]["feature"] != digest[5]["feature"]
    assert media.audio_features(media.store_media(docs.limit(0))).collect() == []
