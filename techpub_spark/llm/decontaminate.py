"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are sequences of folded words.  The CGK random walk reads a sequence and advances by a
random bit of (step, word), so that sequences at a small edit distance give embeddings at a small Hamming
distance.  Items are put in length classes (ratio ``RATIO``); for each class, windows of the class's length
at every word of a document are embedded ``reps`` times, ``samples`` positions of the embedding are hashed,
and windows whose hash equals an item's are candidates.  Windows in which too few words occur in any item
can't be within the distance and are skipped, which loses nothing.  A candidate counts only if its best
alignment with the item has an edit similarity (in words) of at least ``similarity``.

``reps`` follows from ``target_recall``: it is the number after which items edited at half the allowed
distance are found at that rate, simulated on the items themselves (at most 24: what the walks miss costs no match).  An exact rest
finds it: an item cut into one piece more than edits are allowed has a piece that no edit touches, so every
place of a piece is a candidate too, and no place within the distance is lost, up to the threshold itself.

The items are a stated query set: they travel to the tasks in blocks of at most ``block_items`` items,
one pass over the documents a block, so what is sent has a fixed bound.  No shuffle, no join.
Chosen style: Arrow batches with numpy; memory is ``BLOCK_CHARS`` of text at a time (or one document).

Defined results: null and empty texts match nothing; items that are null or have no word are skipped; items
too short to allow an edit (under five words at 0.8) match only exactly; repeated rows are judged each; repeated items each
give rows; empty tables give an empty result; documents of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATIO, BLOCK_CHARS = 1.25, 2_000_000
PUNCTUATION = re.compile("[" + re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—") + "]+")


def fold(text: str) -> list[str]:
    """Lower-case words without punctuation."""
    return PUNCTUATION.sub(" ", text.lower()).split()


def edit_distance(a: list, b: list) -> int:
    """Edit distance of two sequences (bit-parallel, one integer column)."""
    if not a or not b:
        return len(a) + len(b)
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    eq: dict = {}
    for i, x in enumerate(a):
        eq[x] = eq.get(x, 0) | 1 << i
    pv, mv, score = mask, 0, len(a)
    for y in b:
        m = eq.get(y, 0)
        d0 = (((m & pv) + pv) ^ pv) | m | mv
        hp, hn = mv | ~(d0 | pv), pv & d0
        score += bool(hp & top) - bool(hn & top)
        hp = hp << 1 | 1
        pv, mv = (hn << 1 | ~(d0 | hp)) & mask, hp & d0 & mask
    return score


def best_place(item: list, text: list) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``text`` that is nearest to ``item``; of ties the first to end."""

    def ends(a: list, b: list) -> list[int]:
        mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
        eq: dict = {}
        for i, x in enumerate(a):
            eq[x] = eq.get(x, 0) | 1 << i
        pv, mv, score, out = mask, 0, len(a), [len(a)]
        for y in b:
            m = eq.get(y, 0)
            d0 = (((m & pv) + pv) ^ pv) | m | mv
            hp, hn = mv | ~(d0 | pv), pv & d0
            score += bool(hp & top) - bool(hn & top)
            hp <<= 1
            pv, mv = (hn << 1 | ~(d0 | hp)) & mask, hp & d0 & mask
            out.append(score)
        return out

    forward = ends(item, text)
    d = min(forward)
    end = forward.index(d)
    back = ends(item[::-1], text[:end][::-1])
    return d, end - back.index(d), end


class Index:
    """Length classes of items, their random walks and the hashed samples of their embeddings."""

    def __init__(self, items: list[tuple[object, str]], similarity: float, target_recall: float, samples: int, seed: int = 5, most_reps: int = 24, min_words: int = 1):
        self.similarity = similarity
        self.items = [(i, w) for i, t in items if len(w := fold(t or "")) >= max(1, min_words)]
        self.vocab: dict[str, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 2)  # 0: past the end, 1: a word of no item
        self.coded = [np.array([self.vocab[x] for x in w], np.int32) for _, w in self.items]
        self.bags = [frozenset(c.tolist()) for c in self.coded]
        rng = np.random.default_rng(seed)
        self.classes: list[dict] = []
        order = sorted((k for k in range(len(self.items)) if self.most(len(self.coded[k]))), key=lambda k: len(self.coded[k]))
        while order:
            low = len(self.coded[order[0]])
            mine = [k for k in order if len(self.coded[k]) < low * RATIO or len(self.coded[k]) == low]
            order = order[len(mine) :]
            self.classes.append(self._class(mine, low, samples, rng, target_recall, most_reps))
        self.pieces = self._pieces()

    def most(self, m: int) -> int:
        """Edits allowed in an item of ``m`` words."""
        return int((1 - self.similarity) * m + 1e-9)

    def _pieces(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Length -> hashes in order, item and first word of the pieces of all items."""
        cut: dict[int, list[tuple[int, int]]] = {}
        for i, c in enumerate(self.coded):
            n = min(self.most(len(c)) + 1, len(c))
            ends = [len(c) * k // n for k in range(n + 1)]
            for a, b in zip(ends, ends[1:]):
                cut.setdefault(b - a, []).append((i, a))
        out = {}
        for size, places in cut.items():
            sig = self.piece_hashes(np.array([self.coded[i][a : a + size] for i, a in places], np.int32).ravel(), size)[::size]
            by = np.argsort(sig, kind="stable")
            out[size] = (sig[by], *(np.array(places, np.int64)[by].T))
        return out

    @staticmethod
    def piece_hashes(words: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each place; a collision costs a needless alignment only."""
        out = np.zeros(max(len(words) - size + 1, 0), np.uint64)
        for k in range(size):
            out = (out ^ words[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _class(self, mine: list[int], size: int, samples: int, rng, target: float, most: int) -> dict:
        steps = 2 * size
        walks = []
        heads = np.zeros((len(mine), size + 1), np.int32)
        for r, k in enumerate(mine):
            heads[r, :size] = self.coded[k][:size]
        # items edited at half the allowed distance, to tell how many repetitions the target takes
        trials = np.zeros((max(64, len(mine)), size + 1), np.int32)
        for r in range(len(trials)):
            w = self.coded[mine[r % len(mine)]].tolist()
            for _ in range(max(1, int(len(w) * (1 - self.similarity) / 2))):
                p, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[p : p + (kind != 1)] = [1] * (kind != 0)  # delete, insert, replace
            trials[r, : min(size, len(w))] = w[:size]
        found = np.zeros(len(trials), bool)
        while len(walks) < most and (not walks or found.mean() < target):
            at = np.sort(rng.choice(steps, min(samples, steps), replace=False))
            walk = {"steps": int(at[-1]) + 1, "at": set(at.tolist()), "mult": int(rng.integers(1 << 62)) * 2 + 1}
            sig = self.embed(walk, heads.ravel(), np.arange(len(mine)) * (size + 1), size)
            tried = self.embed(walk, trials.ravel(), np.arange(len(trials)) * (size + 1), size)
            found |= tried == sig[np.arange(len(trials)) % len(mine)]
            by = np.argsort(sig, kind="stable")
            walk |= {"sig": sig[by], "item": np.array(mine)[by]}
            walks.append(walk)
        return {"size": size, "walks": walks, "recall": float(found.mean())}

    @staticmethod
    def embed(walk: dict, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the sampled positions of the walk over ``size`` words from each start.  A 0 ends a text."""
        at, out = starts.astype(np.int32 if len(words) < 1 << 30 else np.int64), np.zeros(len(starts), np.uint64)
        stop, mult = at + at.dtype.type(size), np.uint64(walk["mult"] & (1 << 64) - 1)
        codes = np.arange(int(words.max()) + 1 if len(words) else 1, dtype=np.uint64)
        for j in range(walk["steps"]):
            s = words.take(np.minimum(at, stop))
            s *= at < stop
            if j in walk["at"]:
                out = (out ^ s.astype(np.uint64)) * mult
                out ^= out >> np.uint64(29)
            # the random bit of (step, word): one row at a time, so that memory does not grow with steps and walks
            x = (codes + np.uint64((j + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * mult
            x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
            bits = (x >> np.uint64(63)).astype(at.dtype)
            bits[0] = 0  # a text's end stays
            at += bits.take(s)
        return out

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(start, item) pairs of colliding windows and of whole pieces.  ``words``: all documents' codes, a 0 after each."""
        ahead = np.concatenate([[0], np.cumsum(words > 1)])
        out: set[tuple[int, int]] = set()
        for c in self.classes:
            size = c["size"]
            need = math.ceil(size - (1 - self.similarity) * size * RATIO)
            stop = np.minimum(np.arange(len(words)) + size, len(words))
            live = np.flatnonzero((ahead[stop] - ahead[:-1] >= need) & (words > 0))
            if not len(live):
                continue
            for walk in c["walks"]:
                sig = self.embed(walk, words, live, size)
                left, right = np.searchsorted(walk["sig"], sig, "left"), np.searchsorted(walk["sig"], sig, "right")
                for k in np.flatnonzero(right > left):
                    out.update((int(live[k]), int(i)) for i in walk["item"][left[k] : right[k]])
        for size, (sigs, items, firsts) in self.pieces.items():
            sig = self.piece_hashes(words, size)
            left, right = np.searchsorted(sigs, sig, "left"), np.searchsorted(sigs, sig, "right")
            for p in np.flatnonzero(right > left):
                begin = int(bounds[np.searchsorted(bounds, p, "right") - 1])
                out.update((max(int(p - firsts[k]), begin), int(items[k])) for k in range(left[p], right[p]))
        return out

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, first word, end word, distance): one row per separate place."""
        coded, bounds, at = [], [], 0
        get = self.vocab.get
        for t in texts:
            w = fold(t)
            c = np.fromiter(chain(map(get, w, repeat(1)), (0,)), np.int32, len(w) + 1)
            coded.append(c)
            bounds.append(at)
            at += len(c)
        if not coded:
            return []
        words, bounds = np.concatenate(coded + [np.zeros(1, np.int32)]), np.array(bounds)
        places: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for start, item in sorted(self.candidates(words, bounds)):
            doc = int(np.searchsorted(bounds, start, "right")) - 1
            m = len(self.coded[item])
            most = self.most(m)
            seen = places.setdefault((doc, item), [])
            here = start - bounds[doc]
            near = lambda s, e: s < here + m // 2 and here < e - m // 2  # noqa: B023, E731
            if any(near(s, e) for _, s, e in seen):
                continue  # inside a place that is already found
            # a start is mostly within ``most`` words, and an end as many more; an own place is not given up for a neighbour's
            first, last = int(bounds[doc]), int(bounds[doc]) + len(coded[doc]) - 1
            for room in (2 * most, most):
                low, high = max(first, start - room), min(last, start + m + room)
                if len(self.bags[item].intersection(words[low:high].tolist())) < len(self.bags[item]) - most:
                    break
                while True:
                    d, s, e = best_place(self.coded[item].tolist(), words[low:high].tolist())
                    s, e = low + s, low + e
                    if d > most or not (s == low > first or e == high < last):
                        break
                    low, high = max(first, low - most), min(last, high + most)  # it may go on beyond the part
                if d <= most and (d, s - first, e - first) not in seen:
                    seen.append((d, s - first, e - first))
                if d > most or near(s - first, e - first):
                    break
        return [(doc, item, s, e, d) for (doc, item), found in places.items() for d, s, e in found]


def blocks(items: DataFrame, block_items: int) -> list[list[tuple[object, str]]]:
    """The stated query set, in blocks of bounded size (the driver holds one pass of short items)."""
    out: list[list[tuple[object, str]]] = [[]]
    for r in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if len(out[-1]) >= block_items:
            out.append([])
        out[-1].append((r[0], r[1]))
    return out


def in_blocks(texts: list[str]) -> Iterator[list[int]]:
    """Numbers of texts in runs of about BLOCK_CHARS characters."""
    run, n = [], 0
    for k, t in enumerate(texts):
        run.append(k)
        n += len(t)
        if n >= BLOCK_CHARS:
            yield run
            run, n = [], 0
    if run:
        yield run


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, target_recall: float = 0.95, samples: int = 4, block_items: int = 20_000) -> DataFrame:
    """One row per place: doc_id, item_id, first_word, end_word, distance, edit_similarity."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item = to_arrow_type(item_type)

    def one(block: list[tuple[object, str]]) -> DataFrame:
        index = Index(block, similarity, target_recall, samples)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = []
                for run_ in in_blocks(texts):
                    rows += [(run_[d], *rest) for d, *rest in index.matches([texts[k] for k in run_])]
                if rows:
                    doc, item, s, e, dist = zip(*rows, strict=True)
                    sim = [1 - x / len(index.coded[i]) for x, i in zip(dist, item, strict=True)]
                    cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([index.items[i][0] for i in item], arrow_item), *[pa.array(x, pa.int64()) for x in (s, e, dist)], pa.array(sim, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "first_word", "end_word", "distance", "edit_similarity"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, item_id {item_type.simpleString()}, first_word long, end_word long, distance long, edit_similarity double")

    return reduce(DataFrame.unionAll, [one(b) for b in blocks(items, block_items)])


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8, target_recall: float = 0.95, samples: int = 4, block_items: int = 20_000) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` without a benchmark passage, with their own columns."""
    at = docs.columns.index("text")
    for block in blocks(items, block_items):
        index = Index(block, similarity, target_recall, samples)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                bad: set[int] = set()
                for run_ in in_blocks(texts):
                    bad.update(run_[m[0]] for m in index.matches([texts[k] for k in run_]))
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
