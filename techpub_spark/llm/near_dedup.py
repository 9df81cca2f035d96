"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Texts that are equal collapse by a 128-bit digest.  A different text is a sequence of words; its shingles
of ``WORDS`` words are labelled with their number of occurrence, and each of ``sketches`` hash functions
takes the two smallest and keeps them in text order, so that a collision needs the same content in the
same order.  Every sketch is a bucket; members of a bucket are verified by a banded alignment of their
words: similarity = 1 - edit distance / words of the longer, at least ``threshold``.  Edits that spread
over a fifth of the words leave a shingle similarity of about 0.2, which 64 sketches of two still find
with a probability over 0.9; at 0.3 it is over 0.99.  Components of the links are the classes; the smallest
doc_id of a class stays.

Signatures are computed where the documents are read, from the bytes of whole texts; the shuffle carries
(bucket, digest).  Only texts that met another are moved for alignment: a scan picks them by a bit table
of fixed size, an exact join follows.  Exact copies, however many, are one member.  Chosen style: Arrow batches with numpy, DataFrame joins for the rest.

Defined results: a null text counts as empty; all empty texts are copies of each other; a text with fewer
than ``WORDS`` words is one shingle, so only equal word sequences match; ties keep the smallest doc_id,
nulls first; rows that repeat a doc_id and a text are copies; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_components, dropped, has_bit, sorted_join, stored, wanted_bits
from .line_dedup import mix

WORDS, SKETCHES, THRESHOLD, BLOCK = 5, 64, 0.8, 1 << 22
#: Digests that a task remembers, so that texts it has seen are not sent again.
RECENT = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts laid end to end as UTF-8 bytes, and the first word of each text (plus the end).

    ``bounds``: the texts' byte offsets and the end.  A word's hash is a difference of running sums.
    """
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.zeros(len(raw), bool)
    begin[bounds[:-1][bounds[:-1] < len(raw)]] = True
    starts = np.flatnonzero(~space & (begin | np.concatenate([[True], space[:-1]]))) if len(raw) else np.zeros(0, np.int64)
    nexts = np.concatenate([space[1:] | begin[1:], [True]]) if len(raw) else np.zeros(0, bool)
    ends = np.flatnonzero(~space & nexts) + 1
    with np.errstate(over="ignore"):
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * powers(BASE, len(raw)), dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * powers(INVERSE, len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def labelled(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled shingle hashes of all texts, and each text's first shingle (plus the end)."""
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    place = np.arange(at[-1]) - at[doc] + first[doc]
    with np.errstate(over="ignore"):
        h = np.zeros(at[-1], np.uint64)
        padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
        for k in range(WORDS):
            inside = place + k < first[doc + 1]
            h = h * np.uint64(0x165667B19E3779F9) + np.where(inside, padded[place + k], np.uint64(k + 1))
        h = mix(h)
        mine = h ^ mix((doc + 1).astype(np.uint64))
        order = np.argsort(mine, kind="stable")
        run = mine[order]
        new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
        if not new.all():
            since = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
            label = np.zeros(len(h), np.uint64)
            label[order] = since.astype(np.uint64)
            h = np.where(label > 0, mix(h + label * np.uint64(0xD6E8FEB86659FD93)), h)
    return h, at


def order_sketches(h: np.ndarray, at: np.ndarray, sketches: int) -> np.ndarray:
    """(texts with a shingle, sketches) bucket hashes: two smallest shingles under each function, in text order."""
    n = np.diff(at)
    live = np.flatnonzero(n)
    starts, sizes = at[:-1][live], n[live]
    out = np.zeros((len(live), sketches), np.uint64)
    if not len(live):
        return out
    with np.errstate(over="ignore"):
        mixers = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64)).reshape(-1, 2)
        for s in range(sketches):
            v = (h ^ mixers[s, 0]) * (mixers[s, 1] | np.uint64(1))
            places = []
            for _ in range(2):
                low = np.minimum.reduceat(v, starts)
                hit = np.flatnonzero(v == np.repeat(low, sizes))
                owner = np.searchsorted(starts, hit, "right") - 1
                place = np.zeros(len(live), np.int64)
                place[owner[::-1]] = hit[::-1]
                places.append(place)
                v[place] = FULL
            a, b = np.minimum(*places), np.maximum(*places)
            one = sizes == 1
            x, y = h[a], np.where(one, np.uint64(0), h[b])
            out[:, s] = mix((x * np.uint64(0xC2B2AE3D27D4EB4F) + y) ^ mix(np.full(len(live), s + 1, np.uint64)))
    return out


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1.

    Common ends are cut off; a band of diagonals around the main one is kept as bits of integers and
    doubled until the distance fits into it.
    """
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    eq: dict = {}
    for k, x in enumerate(a):
        eq[x] = eq.get(x, 0) | 1 << k
    t = max(15, abs(len(a) - len(b)))
    while True:
        t = min(t, most)
        d = _band(eq, len(a), b, t)
        if d <= t:
            return d
        if t >= most:
            return most + 1
        t *= 2


def _band(eq: dict, m: int, b: list, t: int) -> int:
    """Distance along the diagonals -t..t; exact if it is at most ``t``."""
    mask = (1 << (2 * t + 1)) - 1
    vp, vn, score, bottom = mask >> t << t, 0, min(t, m), 1 << (2 * t)
    for j, y in enumerate(b, 1):
        e, low = eq.get(y, 0), j - t - 1
        x = (e >> low if low >= 0 else e << -low) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = (vn | ~(d0 | vp)) & mask, d0 & vp
        if j + t <= m:
            score += not d0 & bottom
        elif 0 <= m - j + t:
            bit = 1 << (m - j + t)
            score += bool(hp & bit) - bool(hn & bit)
        vp, vn = (hn | ~((d0 >> 1) | hp)) & mask, (d0 >> 1) & hp
    return score


def similarity(a: str, b: str, threshold: float) -> float:
    """1 - edit distance / longer, in words; 0 if it is under ``threshold``."""
    return _similarity(_Words(a), _Words(b), threshold)


class _Words:
    """A text's words and how often each occurs."""

    def __init__(self, text: str):
        self.words = text.split()
        self.bag = Counter(self.words)


def _similarity(a: _Words, b: _Words, threshold: float) -> float:
    longer = max(len(a.words), len(b.words))
    if not longer:
        return 1.0
    most = int((1 - threshold) * longer + 1e-9)
    few, many = (a.bag, b.bag) if len(a.bag) < len(b.bag) else (b.bag, a.bag)
    get = many.get
    if min(len(a.words), len(b.words)) < longer - most or sum([min(n, get(w, 0)) for w, n in few.items()]) < longer - most:
        return 0.0  # an edit takes away one common word at most
    d = banded_distance(a.words, b.words, most)
    return 1 - d / longer if d <= most else 0.0


def word_tokens(text: str) -> np.ndarray:
    """Hashes of a text's words, each labelled with its number of occurrence.

    An edit similarity of t implies that two texts share at least t times the longer one's labelled words.
    """
    seen: dict[str, int] = {}
    out = np.zeros(len(words := text.split()), np.uint64)
    for i, w in enumerate(words):
        seen[w] = n = seen.get(w, 0) + 1
        out[i] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), n)
    return np.unique(out)


def _sketch_rows(sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[bytes] = set()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            pick = []
            for i, k in enumerate(keys.to_pylist()):
                if k not in recent:
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(k)
                    pick.append(i)
            part, size = [], 0
            for n, i in enumerate(pick):
                raw = texts[i].as_buffer()
                part.append((i, raw.to_pybytes() if raw else b""))
                size += len(part[-1][1])
                if size >= BLOCK or n == len(pick) - 1:
                    rows = np.array([i for i, _ in part], np.int64)
                    words, first = word_hashes(np.frombuffer(b"".join([t for _, t in part]), np.uint8), np.cumsum([0, *[len(t) for _, t in part]]))
                    h, starts = labelled(words, first)
                    sig = order_sketches(h, starts, sketches)
                    ends = pa.array(np.arange(len(sig) + 1) * sketches, pa.int32())
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[np.diff(starts) > 0])), pa.ListArray.from_arrays(ends, pa.array(sig.ravel().view(np.int64)))], names=["id", "buckets"])
                    part, size = [], 0

    return run


def _wanted_texts(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[bytes] = set()
        for batch in batches:
            pick = []
            for i in np.flatnonzero(has_bit(table.value, batch.column(0))).tolist():
                if (k := batch.column(0)[i].as_py()) not in recent:
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(k)
                    pick.append(i)
            if pick:
                yield batch.take(pa.array(pick))

    return run


def document_classes(docs: DataFrame, threshold: float = THRESHOLD, sketches: int = SKETCHES) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, class_id (the doc_id that stays), class_rows, kept, same."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.unhex(F.md5("text")))
    members = keyed.select("id", F.col("text").cast("binary").alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims, last = [], ("", _Words(""))
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                last = last if last[0] == y else (y, _Words(y))  # pairs come in the order of b
                sims.append(_similarity(_Words(x), last[1], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    def texts(wanted: DataFrame) -> DataFrame:
        likely = keyed.select("id", "text").mapInArrow(_wanted_texts(wanted_bits(wanted)), "id binary, text string")
        return sorted_join(likely, wanted, F.col("id") == F.col("of"), "left_semi").groupBy("id").agg(F.first("text").alias("text"))

    def verify(pairs: DataFrame, met: DataFrame) -> DataFrame:
        left, right = met.toDF("ia", "ta"), met.toDF("ib", "tb")
        both = sorted_join(sorted_join(pairs, left, F.col("a") == F.col("ia")), right, F.col("b") == F.col("ib")).select("a", "b", "ta", "tb")
        return both.mapInArrow(align, "a binary, b binary, sim double")

    comp = bucket_components(members, verify, threshold, texts, word_tokens, lambda x, y: x + y - 2 * threshold * F.greatest(x, y), rows=_sketch_rows(sketches))
    seen = stored(keyed.select("doc_id", "id"), "documents")
    rows = seen.groupBy("id", "doc_id").agg(F.count("*").alias("same"))
    first = rows.groupBy("id").agg(F.min(F.struct("doc_id", "id", "same")).alias("first"), F.sum("same").alias("n"))
    multi = sorted_join(first, comp, F.col("id") == F.col("node"), "left").where("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "first", "n")
    multi = stored(multi, "multi", heavy=True)
    dropped(comp)
    keeper = multi.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("class_rows")).withColumnRenamed("root", "r")
    known = sorted_join(multi, keeper, F.col("root") == F.col("r")).select(F.col("id").alias("of"), "keeper", "class_rows")
    alone = F.col("keeper").isNull()
    return sorted_join(seen, known, F.col("id") == F.col("of"), "left").select(
        "doc_id", F.col("id").alias("digest"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        (alone | ((F.col("id") == F.col("keeper.id")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")))).alias("kept"),
        F.coalesce("keeper.same", F.lit(1)).alias("same"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: one row of each class of near-duplicates, with its own columns."""
    kept = document_classes(docs, threshold).where("kept").select(F.col("doc_id").alias("__doc"), F.col("digest").alias("__id"), F.col("same").alias("__same")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    body = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    out = sorted_join(docs.toDF(*names), kept, (body == F.col("__id")) & F.col(doc).eqNullSafe(F.col("__doc")))
    single, again = out.where("__same = 1"), out.where("__same > 1").dropDuplicates(["__doc", "__id"])  # repeated rows are rare
    return single.unionByName(again).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
