"""Packing: first-fit decreasing on a tournament tree of bin capacities, in randomised groups.

Documents are encoded where they are read.  A document longer than a sequence is cut into full
sequences and a rest; only (id, start, length, checksum) of each piece is shuffled, never ids or text.
Pieces are dealt by a hash of their document (the same after a lost task, in whatever order its rows come)
over groups of about ``docs_per_group`` documents, and each group is packed on its own: largest piece first, into the first bin with room, found by descending a max tree.

Chosen style: Arrow batches for encoding, ``applyInPandas`` for packing (one group is a few thousand
short rows whatever the table's size).

Defined results: a null or empty text is the end id alone, one piece of length 1; a null doc_id is
kept as such; a repeated row is packed each time; an empty table gives an empty table; a text of any
length is encoded whole.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of the tokenizer's own split; str.split() also splits at x1c to x1f.
SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f\u0130\u03a3]")
#: A stop or comma that ends a word of plain letters: a token of its own wherever white space follows.
STOP = re.compile(r"(?<=[a-zà-öø-ÿ])([.,])(?=\s|$)")

MASK = (1 << 64) - 1


def mixed(a: int, b: int) -> int:
    """A 64-bit mix of two integers (splitmix finaliser)."""
    x = (a * 0x9E3779B97F4A7C15 + b + 0x632BE59BD9B4E019) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, by encoding each distinct word once.

    The tokenizer lowers case and its splitter never joins characters across white space, nor a letter
    with a stop, so the ids of a text are those of its lower-case words in order; the tests hold this
    against whole-text encoding.  Python workers outlive their tasks and take turns, so each keeps its cache
    while other steps run: it holds the last ``most`` to 2 * ``most`` distinct words, whatever the input.
    """

    def __init__(self, path: str, most: int = 1 << 17):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.most, self.seen, self.before = most, {}, {}

    def words(self, text: str) -> list[str]:
        if ODD.search(text) or not unicodedata.is_normalized("NFC", text):
            return [w for w in SPLIT.split(text) if w]
        return STOP.sub(r" \1", text.lower()).split()

    def learn(self, words: set[str]) -> None:
        """Ids of the words, into the cache; those that had to make room before come from there, and stay."""
        missing = [w for w in words if w not in self.seen]
        if len(self.seen) + len(missing) > self.most:
            self.seen, self.before = {}, self.seen
            missing = list(words)
        known = {w: ids for w in missing if (ids := self.before.get(w)) is not None}
        self.seen.update(known)
        new = [w for w in missing if w not in known]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.seen[w] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        words = self.words(text)
        got = list(map(self.seen.get, words))
        if None in got:
            self.learn(set(words))
            got = list(map(self.seen.get, words))
        return b"".join(got)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Bins:
    """Bin capacities under a max tree: the first bin with room is one descent."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and its capacity before."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < length:
                i += 1
        room = tree[i]
        tree[i] = room - length
        bin_no, i = i - self.size, i >> 1
        while i:
            top = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == top:
                break
            tree[i], i = top, i >> 1
        return bin_no, room


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, by first-fit decreasing; ties keep their order."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    bins = Bins(max(1, len(lengths)), capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b, room = bins.put(lengths[i])
        out[i] = (b, capacity - room)
    return out


def encoded_pieces(docs: DataFrame, capacity: int, end_id: int, groups: int, seed: int, vocabulary: str | None) -> DataFrame:
    """Pieces of all documents with their length, checksum and random group."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        enc, equal = encoder(path), Counter()
        for batch in batches:
            keys, starts, lengths, sums, totals, dealt = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = enc.encode(text.as_py() or "") + end
                total = len(ids) // 4
                key = xxhash.xxh3_64_intdigest(ids, xxhash.xxh3_64_intdigest(repr(batch.column(0)[k].as_py()), seed))
                equal[key] += 1  # repeated rows are dealt apart
                for at in range(0, total, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    keys.append(k)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
                    dealt.append(mixed(key, equal[key] * (total + 1) + at) % groups)
            cols = [batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, pa.int64()) for c in (starts, lengths, sums, totals, dealt)]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, pack_group long")


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 2, docs_per_group: int = 4096, seed: int = 17, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    groups = max(1, math.ceil(docs.count() / docs_per_group))
    pieces = encoded_pieces(docs, capacity, end_id, groups, seed, vocabulary)

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "start"], ascending=False, kind="stable")
        placed = pack(rows["length"].tolist(), capacity)
        rows["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        rows["offset"] = [o for _, o in placed]
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pieces.groupBy("pack_group").applyInPandas(place, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padding(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, tokens and padded tokens (a sequence whose length is a power of two needs none)."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.pow(F.lit(2), F.log2("n").cast("int")) == F.col("n")
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("padded"))
