"""Token counts by offset-mapped attribution.

A whole document is encoded once with a tiktoken vocabulary; tokens are byte strings, so their running
lengths are exact byte spans, mapped to characters.  The spans are interval-joined (a sorted search per
document) to the document's sections.  Rule for tokens that cross a boundary: ``first`` gives a token to
the section that holds its first character, ``last`` to that of its last one, ``share`` splits it by
characters (the shares of a token sum to 1).  A separator between two sections belongs to the earlier one.

Chosen style: Arrow batches without a shuffle: a join of exploded tokens would move every token.

Defined results: a null or empty text is one empty section of no tokens; repeated rows count each;
an empty table gives an empty table; a text of any length is encoded whole, never in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .secrets import encoding

RULES = ("first", "last", "share")


def lines_of(text: str) -> list[tuple[int, int]]:
    """The default sections: character spans of the lines, each with its line end."""
    spans, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        spans.append((at, end))
        at = end
    return spans


def char_of_byte(raw: bytes) -> np.ndarray:
    """For each byte offset 0..len: the characters that start before it."""
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


def attribute(ends: np.ndarray, raw: bytes, spans: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per section: tokens under ``rule``, and tokens that cross its end.  ``ends``: byte end of each token."""
    n = len(spans)
    if not len(ends):
        return np.zeros(n), np.zeros(n, np.int64)
    chars = char_of_byte(raw)
    starts = np.concatenate([[0], ends[:-1]])
    first = np.maximum(chars[np.minimum(starts + 1, len(raw))] - 1, 0)  # the character that the first byte is in
    last = np.maximum(chars[ends] - 1, 0)
    stops = np.array([e for _, e in spans])
    at = lambda x: np.minimum(np.searchsorted(stops, x, side="right"), n - 1)
    f, t = at(first), at(last)
    crossing = np.bincount(f[f != t], minlength=n)
    if rule != "share":
        return np.bincount(f if rule == "first" else t, minlength=n).astype(float), crossing
    out = np.bincount(f[f == t], minlength=n).astype(float)
    for i in np.flatnonzero(f != t):
        whole = last[i] - first[i] + 1
        for k in range(f[i], t[i] + 1):
            out[k] += (min(spans[k][1], last[i] + 1) - max(spans[k][0], first[i])) / whole
    return out, crossing


def count_tokens(docs: DataFrame, rule: str = "first", vocabulary: str | None = None, sections_col: str | None = None) -> DataFrame:
    """One row per section: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    ``sections_col``: an ``array<struct<start,end>>`` column of ascending, gapless character spans; by
    default the lines.  Text beyond the last span is given to the last section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "text", *([sections_col] if sections_col else [])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        enc = encoding(path)
        lens = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)
        for batch in batches:
            keys, out = [], []
            given = batch.column(2).to_pylist() if sections_col else None
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                spans = ([(s["start"], s["end"]) for s in given[k] or []] if given else None) or lines_of(text)
                ends = np.cumsum(lens[np.array(enc.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
                tokens, crossing = attribute(ends, text.encode(), spans, rule)
                keys.append(np.full(len(spans), k))
                out.append((np.arange(len(spans)), [s for s, _ in spans], [e for _, e in spans], tokens, crossing))
            if not out:
                continue
            sec, start, end, tokens, crossing = (np.concatenate(x) for x in zip(*out, strict=True))
            arrays = [batch.column(0).take(pa.array(np.concatenate(keys))), *[pa.array(x, pa.int64()) for x in (sec, start, end)], pa.array(tokens, pa.float64()), pa.array(crossing, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return docs.select(*cols).mapInArrow(count, f"doc_id {id_type}, section long, start_char long, end_char long, n_tokens double, n_crossing long")
