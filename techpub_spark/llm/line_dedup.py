"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines that are equal collapse by a 128-bit hash.  Each different line gets one-permutation MinHash values
over its shingles of ``SHINGLE`` characters (empty bins borrow from the next full one), in ``BANDS`` bands
of ``ROWS`` values: a pair of Jaccard similarity 0.8 meets in some band with probability over 0.98, one of
0.9 with 0.9999.  Pairs that meet are verified by the exact Jaccard similarity of their shingle sets; what
is linked forms components by distributed contraction; the first occurrence in the order of (doc_id,
line) stays, in each component.

Shuffles carry keys.  One scan makes ids and bands of all lines; a second one picks the texts of lines
that met another line, by a bit table of fixed size before the shuffle and an exact join after it.
A line with very many occurrences sends its bands once a task and is counted by a partial aggregate;
buckets are combined in each task before they are dealt.  Chosen style: Arrow batches with numpy for signatures, DataFrame joins for the rest.

Defined results: a line is what stands between line feeds; blank lines are never duplicates and always
stay; a null text has no lines; a line shorter than a shingle is one shingle, so only equal lines match;
rows that repeat the same doc_id and text are one document and keep the same lines; null doc_ids come
first; an empty table gives an empty table; whole texts of any length are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_components, dropped, has_bit, sorted_join, stored, wanted_bits

SHINGLE, BANDS, ROWS, THRESHOLD = 8, 8, 4, 0.8
BINS = BANDS * ROWS
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def shingles(chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines laid end to end, and the line of each.

    ``chars``: code points of all lines; a line shorter than a shingle gives one hash of what it has.
    """
    pad = np.concatenate([chars.astype(np.uint64) + np.uint64(1), np.zeros(SHINGLE, np.uint64)])
    ends = np.cumsum(lengths)
    line = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[line] - np.arange(len(chars))  # characters from here to the line's end
    h = pad
    short = lengths < SHINGLE
    with np.errstate(over="ignore"):
        if short.any():  # rare: no character of the next line may enter
            rows = np.flatnonzero(short)
            small = np.zeros(len(rows), np.uint64)
            for k in range(SHINGLE):
                at = ends[rows] - lengths[rows] + k
                small = small * np.uint64(0x9E3779B97F4A7C15) + np.where(k < lengths[rows], pad[np.minimum(at, len(pad) - 1)], 0).astype(np.uint64)
        for step, mult in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
            h = h[:-step] * np.uint64(mult) + h[step:]
        h = mix(h[: len(chars)].copy())
        full = left >= SHINGLE
        if short.any():
            return np.concatenate([h[full], mix(small)]), np.concatenate([line[full], rows])
    return h[full], line[full]


def signatures(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(lines, BANDS) band hashes."""
    h, line = shingles(chars, lengths)
    n = len(lengths)
    sig = np.full(n * BINS, FULL, np.uint64)
    np.minimum.at(sig, line * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), h)
    sig = sig.reshape(n, BINS)
    out, empty = sig.copy(), sig == FULL
    with np.errstate(over="ignore"):
        for k in range(1, BINS):  # an empty bin borrows from the next full one, marked by the distance
            if not empty.any():
                break
            fill = np.roll(sig, -k, axis=1)
            use = empty & (fill != FULL)
            out[use] = fill[use] + np.uint64(k * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
            empty &= ~use
        sig = out
        bands = np.zeros((n, BANDS), np.uint64)
        for b in range(BANDS):
            x = np.full(n, b + 1, np.uint64)
            for r in range(ROWS):
                x = mix((x ^ sig[:, b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15))
            bands[:, b] = x
    return bands


def token_sets(texts: list[str]) -> list[np.ndarray]:
    """The different shingles of each line, as sorted 64-bit hashes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    h, line = shingles(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), lengths)
    if (lengths < SHINGLE).any():  # their hashes stand at the end
        by = np.argsort(line, kind="stable")
        h, line = h[by], line[by]
    ends = np.searchsorted(line, np.arange(1, len(texts) + 1))
    out = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        x = np.sort(h[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def line_tokens(text: str) -> np.ndarray:
    """The different shingles of a line, as hashes."""
    return token_sets([text])[0]


line_tokens.many = token_sets


def jaccards(left: list[str], right: list[str]) -> list[float]:
    """Jaccard similarity of the shingle sets of each pair, counted over whole sets of 64-bit shingle hashes."""
    number: dict[str, int] = {}
    pairs = [(number.setdefault(a, len(number)), number.setdefault(b, len(number))) for a, b in zip(left, right, strict=True)]
    sets, out = token_sets(list(number)), []
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) < 0.5 * max(len(x), len(y)):
            out.append(0.0)  # at most one half, whatever they share
            continue
        z = np.sort(np.concatenate([x, y]), kind="stable")
        both = int(np.count_nonzero(z[1:] == z[:-1]))
        out.append(both / (len(x) + len(y) - both))
    return out


#: Ids of lines that a task remembers, so that lines it has seen are not sent again.
RECENT = 1 << 17

LINES = "doc_id {}, row_key long, line_no int, id binary, bands array<long>"


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row_key, text) to a row per line that is not blank: its number, id and, once a task, its bands."""
    recent: set[bytes] = set()
    for batch in batches:
        bodies, at = batch.column(2).to_pylist(), 0
        while at < len(bodies):
            owner, number, ids, fresh, texts, size = [], [], [], [], [], 0
            while at < len(bodies) and size < BLOCK:
                for k, line in enumerate((bodies[at] or "").split("\n")):
                    if line.strip(" \t\r\x0b\x0c"):
                        key = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                        if key not in recent:
                            if len(recent) >= RECENT:
                                recent.clear()
                            recent.add(key)
                            fresh.append(len(ids))
                            texts.append(line)
                            size += len(line)
                        owner.append(at)
                        number.append(k)
                        ids.append(key)
                at += 1
            if not ids:
                continue
            count = np.zeros(len(ids) + 1, np.int32)
            values = np.zeros(0, np.uint64)
            if texts:
                chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
                values = signatures(chars, np.array([len(t) for t in texts], np.int64)).ravel()
                count[np.array(fresh) + 1] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(count), pa.int32()), pa.array(values.view(np.int64)))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number, pa.int32()), pa.array(ids, pa.binary()), bands], names=["doc_id", "row_key", "line_no", "id", "bands"])


def _wanted_lines(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[bytes] = set()
        for batch in batches:
            lines = [x for body in batch.column(0).to_pylist() if body for x in body.split("\n")]
            ids = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines]
            keys, texts = [], []
            for i in np.flatnonzero(has_bit(table.value, pa.array(ids, pa.binary()))).tolist():
                if ids[i] not in recent:
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(ids[i])
                    keys.append(ids[i])
                    texts.append(lines[i])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], names=["id", "text"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, sims, at = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], 0
        while at < len(left):
            stop, size = at, 0
            while stop < len(left) and size < BLOCK:
                size += len(left[stop]) + len(right[stop])
                stop += 1
            sims += jaccards(left[at:stop], right[at:stop])
            at = stop
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per line that is not blank: doc_id, row_key, line_no, keeper_doc_id, keeper_line, copies, kept.

    ``threshold`` is at least one half.
    """
    body = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    lines = stored(body.mapInArrow(_line_rows, LINES.format(docs.schema["doc_id"].dataType.simpleString())), "lines")
    members = lines.where("size(bands) > 0").select("id", F.col("bands").alias("buckets"))

    def texts(wanted: DataFrame) -> DataFrame:
        likely = docs.select("text").mapInArrow(_wanted_lines(wanted_bits(wanted)), "id binary, text string")
        return sorted_join(likely, wanted, F.col("id") == F.col("of"), "left_semi").groupBy("id").agg(F.first("text").alias("text"))

    def verify(pairs: DataFrame, met: DataFrame) -> DataFrame:
        left, right = met.toDF("ia", "la"), met.toDF("ib", "lb")
        both = sorted_join(sorted_join(pairs, left, F.col("a") == F.col("ia")), right, F.col("b") == F.col("ib")).select("a", "b", "la", "lb")
        return both.mapInArrow(_compare, "a binary, b binary, sim double")

    apart = lambda x, y: (1 - threshold) / (1 + threshold) * (x + y)
    comp = bucket_components(members, verify, threshold, texts, line_tokens, apart, bound=apart)
    seen = lines.select("doc_id", "row_key", "line_no", "id")
    first = seen.groupBy("id").agg(F.min(F.struct("doc_id", "line_no", "row_key")).alias("first"), F.count("*").alias("n"))
    multi = sorted_join(first, comp, F.col("id") == F.col("node"), "left").where("n > 1 or root is not null").select("id", F.coalesce("root", "id").alias("root"), "first", "n")
    multi = stored(multi, "multi", heavy=True)
    dropped(comp)
    keeper = multi.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("copies")).withColumnRenamed("root", "r")
    known = sorted_join(multi, keeper, F.col("root") == F.col("r")).select(F.col("id").alias("of"), "keeper", "copies")
    own = F.struct("doc_id", "line_no", "row_key")
    return sorted_join(seen, known, F.col("id") == F.col("of"), "left").select(
        "doc_id", "row_key", "line_no",
        F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keeper_doc_id"),
        F.coalesce("keeper.line_no", "line_no").alias("keeper_line"), F.coalesce("copies", F.lit(1)).alias("copies"),
        (F.col("keeper").isNull() | F.col("keeper").eqNullSafe(own)).alias("kept"),
    )


def drop_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: ``docs`` with the repeated lines taken out of their texts; every row stays.

    ``n_chars``, where there is such a column, follows the new text.
    """
    gone = line_classes(docs, threshold).where(~F.col("kept")).groupBy("doc_id", "row_key").agg(F.collect_set("line_no").alias("gone")).toDF("__doc", "__row", "__gone")
    names = [f"c{i}" for i in range(len(docs.columns))]
    work = docs.toDF(*names)
    doc, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    out = sorted_join(work, gone, F.col(doc).eqNullSafe(F.col("__doc")) & (F.xxhash64(doc, text) == F.col("__row")), "left")
    cols = []
    for name, c in zip(names, docs.columns, strict=True):
        col = new if c == "text" else F.char_length(new).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(name)
        cols.append(col.alias(c))
    return out.select(*cols)
