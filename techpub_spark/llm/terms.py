"""Terms of whole texts at byte level: runs of letters (and digits), A to Z lower-cased, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at once; a longer text is a piece of its own.
PIECE = 8 << 20


def _table(digits: bool) -> np.ndarray:
    """Byte to the byte kept in a term; 0 where it separates terms.  Every byte of a non-ASCII character is kept."""
    out = np.zeros(256, np.uint8)
    out[0x80:] = np.arange(0x80, 0x100)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    if digits:
        out[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return out


LETTERS, WORDS = _table(False), _table(True)


def split_terms(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order (large strings), and the number of the text that each is from.

    A null text has none.  UTF-8 marks every byte of a non-ASCII character, so bytes give the same runs as
    code points do.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    low = table[raw]
    inside = low != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[inside].tobytes()))
    return terms, np.searchsorted(bounds, starts, "right") - 1


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with at most ``most`` bytes in a text column, or one longer row."""
    n = np.array([0 if s is None else s for s in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    at = 0
    while at < len(n):
        stop = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
