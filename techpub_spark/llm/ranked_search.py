"""Ranked lexical search by Variable-block-max WAND over shards of documents.

A shard is a run of the rows that a task reads, at most ``SHARD`` bytes of text.  For the terms of the
queries it holds posting lists in order of document with the impact of each posting, an integer.  Every
list is cut into blocks of variable length: dynamic programming finds the cuts with the least sum of bound
errors (a block's largest impact times its postings, less their impacts) plus a price per block, for all
lists of a shard side by side.  The pivot test of a query is made for all documents of the shard at once:
a document's bound is the sum of the largest impacts of the blocks that cover it or, in sparse lists, that
hold it.  Documents are scored from the largest bound down, reading only blocks that hold one of them, until
no bound reaches the tenth score.  What is skipped can't be among the ten, so the search is exact; each
shard gives its ten, and the ten of all shards are merged.

Numbers of all documents (N, L, document frequencies) come from one aggregate before.  Queries are taken in
blocks of about ``QUERY_BYTES`` of text, which is what a broadcast holds; a document is never broadcast
nor shuffled.  Style: Arrow batches with numpy; the merge is a window that Spark limits before its shuffle.

Defined results: a null text has no term; an item without terms, or whose terms no document has, gives no
row; every row of the documents and of the items counts on its own, also where ids repeat; equal scores
go by doc_id, null first; an empty table on either side gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .terms import WORDS, pieces, split_terms

TOP, SHARD, QUERY_BYTES = 10, 64 << 20, 4 << 20
#: Price of a block in mean impacts of the shard, and the most postings that the cuts consider in one block.
PRICE, LONGEST = 16, 64
#: A list with fewer than a posting in so many documents moves by its documents, others by their blocks.
SPARSE = 8
#: Postings of a list that are cut together; longer lists are cut there as well.
TOGETHER = 1024


def variable_blocks(impact: np.ndarray, ptr: np.ndarray, price: int, longest: int = LONGEST) -> np.ndarray:
    """First posting of each block (and the end), for lists laid end to end that begin at ``ptr``.

    Minimises, for each list (each ``TOGETHER`` of its postings), the sum over blocks of
    largest impact x postings - impacts + ``price``.
    """
    heads = np.concatenate([np.arange(a, b, TOGETHER) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]).astype(np.int64) if len(ptr) > 1 else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros(1, np.int64)
    n = np.diff(np.append(heads, len(impact)))
    order = np.argsort(-n, kind="stable")
    heads, n = heads[order], n[order]
    width, rows = min(longest, int(n[0])), len(n)
    best = np.zeros((int(n[0]) + 1, rows), np.int64)  # least cost of the first j postings
    back = np.zeros((int(n[0]) + 1, rows), np.int16)
    top = np.zeros((width, rows), np.int64)  # largest impact of a block that begins at posting i, in slot i % width
    for j in range(int(n[0])):
        live = int(np.searchsorted(-n, -j, "left"))  # lists longer than j
        x = impact[heads[:live] + j]
        top[j % width, :live] = 0
        first = max(0, j - width + 1)
        begin = np.arange(first, j + 1)
        slot = begin % width
        now = np.maximum(top[slot, :live], x)
        top[slot, :live] = now
        cost = now * (j + 1 - begin)[:, None]
        cost += best[first : j + 1, :live]
        least = cost.argmin(axis=0)
        best[j + 1, :live] = cost[least, np.arange(live)] + price
        back[j + 1, :live] = first + least
    cut, at = [], n.copy()
    every = np.arange(rows)
    while len(every):
        at[every] = back[at[every], every]
        cut.append(heads[every] + at[every])
        every = every[at[every] > 0]
    return np.append(np.sort(np.concatenate(cut)), len(impact))


def _ranges(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = stops - starts
    return np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


class Shard:
    """Posting lists of a run of documents, in blocks of variable length.

    ``code``, ``doc``: a pair for each occurrence of a query term; ``sizes``: terms of each document.
    """

    def __init__(self, code: np.ndarray, doc: np.ndarray, sizes: np.ndarray, terms: int, n_docs: int, n_terms: int):
        self.docs = len(sizes)
        pair, tf = np.unique(code * self.docs + doc, return_counts=True)
        self.doc = pair % self.docs
        m = 25 + (75 * sizes.astype(np.int64) * n_docs) // max(1, n_terms)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        ptr = np.searchsorted(pair, np.arange(terms + 1) * self.docs)
        price = PRICE * max(1, int(self.impact.mean())) if len(pair) else 1
        self.cut = variable_blocks(self.impact, ptr, price)
        self.bound = np.maximum.reduceat(self.impact, self.cut[:-1]) if len(pair) else np.zeros(0, np.int64)
        self.first, self.last = self.doc[self.cut[:-1]], self.doc[self.cut[1:] - 1]
        self.blocks = np.searchsorted(self.cut[:-1], ptr)
        self.read = 0  # postings that searches have read

    def search(self, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best with a score above 0, best first, ties by document."""
        lo, hi = self.blocks[codes], self.blocks[codes + 1]
        mine, weight = _ranges(lo, hi), np.repeat(weights, hi - lo)
        if not len(mine):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last, top = self.first[mine], self.last[mine], self.bound[mine] * weight
        short = np.repeat((self.cut[hi] - self.cut[lo]) * SPARSE < self.docs, hi - lo)
        bound = np.zeros(self.docs + 1, np.int64)
        np.add.at(bound, first[~short], top[~short])
        np.subtract.at(bound, last[~short] + 1, top[~short])
        bound = np.cumsum(bound[:-1])
        starts, stops = self.cut[mine[short]], self.cut[mine[short] + 1]
        np.add.at(bound, self.doc[_ranges(starts, stops)], np.repeat(top[short], stops - starts))
        score, least, many, done = np.zeros(self.docs, np.int64), 1, k, 0
        order = np.argsort(-bound, kind="stable")
        while done < self.docs and bound[order[done]] >= least:
            some = order[done : done + many]
            some = some[bound[some] >= least]
            self._score(some, mine, weight, first, last, score)
            done, many = done + len(some), many * 4
            if done >= k:
                seen = score[order[:done]]
                least = max(1, int(np.partition(seen, len(seen) - k)[len(seen) - k]))
        seen = order[:done]
        seen = seen[score[seen] >= least]
        seen = seen[np.lexsort((seen, -score[seen]))][:k]
        return seen, score[seen]

    def _score(self, some, mine, weight, first, last, score) -> None:
        """Add the postings of ``some`` documents to ``score``, skipping blocks that hold none of them."""
        live = np.zeros(self.docs + 1, np.int64)
        live[some + 1] = 1
        before = np.cumsum(live)
        hit = np.flatnonzero(before[last + 1] > before[first])
        starts, stops = self.cut[mine[hit]], self.cut[mine[hit] + 1]
        at, w = _ranges(starts, stops), np.repeat(weight[hit], stops - starts)
        self.read += len(at)
        use = live[self.doc[at] + 1] == 1
        np.add.at(score, self.doc[at[use]], w[use] * self.impact[at[use]])


def _coded(part: pa.RecordBatch, column: str, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query term and text of each occurrence of a query term, and the number of all terms of each text."""
    terms, row = split_terms(part.column(column), WORDS)
    found = pc.index_in(terms, value_set=vocabulary)
    use = found.is_valid().to_numpy(zero_copy_only=False)
    return found.drop_null().to_numpy().astype(np.int64), row[use], np.bincount(row, minlength=part.num_rows)


def _counted(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(asked.value["terms"], pa.large_string())
        n_docs, n_terms, df = 0, 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                code, row, sizes = _coded(part, "text", vocabulary)
                n_docs, n_terms = n_docs + int((sizes > 0).sum()), n_terms + int(sizes.sum())
                df += np.bincount(np.unique(code * len(sizes) + row) // max(1, len(sizes)), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n_docs, n_terms]))], names=["term", "n"])

    return run


def _searched(asked, n_docs: int, n_terms: int, k: int, ids: pa.DataType):
    def found(parts: list) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays([p[0] for p in parts])
        order = pc.sort_indices(keys, null_placement="at_start").to_numpy()  # documents in order of their ids, for ties
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        code = np.concatenate([p[1] for p in parts])
        doc = place[np.concatenate([p[2] + b for p, b in zip(parts, base, strict=False)])]
        sizes = np.concatenate([p[3] for p in parts])[order]
        shard = Shard(code, doc, sizes, len(asked.value["terms"]), n_docs, n_terms)
        items, docs, scores = [], [], []
        for i, (codes, weights) in enumerate(asked.value["items"]):
            d, s = shard.search(codes, weights, k)
            items.append(np.full(len(d), i))
            docs.append(order[d])
            scores.append(s)
        items = np.concatenate(items)
        if len(items):
            yield pa.RecordBatch.from_arrays([pa.array(items), keys.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(asked.value["terms"], pa.large_string())
        parts, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                parts.append((part.column("doc_id").cast(ids), *_coded(part, "text", vocabulary)))
                size += part.column("text").nbytes
                if size >= SHARD:
                    yield from found(parts)
                    parts, size = [], 0
        if parts:
            yield from found(parts)

    return run


def _asked(rows: list, ids: list) -> dict:
    """Terms of a block of items, and of each item its terms' numbers and how often each occurs."""
    terms, row = split_terms(pa.array(rows, pa.string()), WORDS)
    coded = terms.dictionary_encode()
    at = np.searchsorted(row, np.arange(len(rows) + 1))
    code = coded.indices.to_numpy().astype(np.int64)
    return {"ids": ids, "terms": coded.dictionary.to_pylist(), "items": [np.unique(code[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]}


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    work = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    asks = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = asks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + total // query_bytes
    out = None
    for block in range(n_blocks):
        rows = asks.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        asked = _asked([r["text"] for r in rows], [r["item_id"] for r in rows])
        if not asked["terms"]:
            continue
        sent = spark.sparkContext.broadcast(asked)
        counts = work.select("text").mapInArrow(_counted(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        known = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
        n_docs, n_terms = known.get(-1, 0), known.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * known.get(t, 0) + 1))) if t in known else 0 for t in range(len(asked["terms"]))], np.int64)
        weighed = asked | {"items": [(codes, times * weight[codes]) for codes, times in asked["items"]]}
        best = work.mapInArrow(_searched(spark.sparkContext.broadcast(weighed), n_docs, n_terms, k, _arrow(work)), f"item long, doc_id {id_type}, score long")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(asked["ids"])), f"item long, item_id {item_type}")
        best = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long") if out is None else out


def _arrow(work: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(work.schema["doc_id"].dataType)
