"""Secret scan: base patterns plus a token-efficiency test.

A string that a subword vocabulary must break into very short pieces is unlike text: its ratio of
characters to tokens is low.  Long runs of key characters are encoded with a tiktoken vocabulary;
those under ``max_ratio`` become spans of kind ``opaque``, after the known harmless shapes (digests of
the usual lengths, UUIDs, numbers, and identifiers whose words encode as well as text) are excluded.  Base spans
always stay, digests or not.  Chosen style: one Arrow batch function, no shuffle; memory is one batch.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; an
empty table gives an empty table; whole texts of any length are read, in linear time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "opaque")

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of fewer than 24 never passes, and a longer one is matched whole: the same as the run and its length test.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Words of an identifier.
SEGMENT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Harmless shapes: digests of 32, 40, 56, 64, 96 and 128 digits, UUIDs and numbers.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    r"|[0-9_+/=-]+)"
)


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tiktoken encoding of a rank file, once per worker."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in the contract's order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, taken: list[tuple[int, int, int]], enc, max_ratio: float) -> list[tuple[int, int, int]]:
    """Spans of long runs that the vocabulary encodes at ``max_ratio`` characters a token or fewer."""
    found, starts = [], [s for s, _, _ in taken]
    reach = list(accumulate((e for _, _, e in taken), max))  # how far the spans up to here go
    for m in CANDIDATE.finditer(text):
        if (k := bisect_left(starts, m.end())) and reach[k - 1] > m.start() or KNOWN.fullmatch(m[0]):
            continue
        if len(m[0]) <= max_ratio * len(enc.encode_ordinary(m[0])) and not identifier(m[0], enc, max_ratio):
            found.append((m.start(), 3, m.end()))
    return found


def identifier(run: str, enc, max_ratio: float) -> bool:
    """True if the words between a run's digits and signs encode as well as text: digits alone make it costly."""
    words = SEGMENT.findall(run)
    return sum(map(len, words)) > max_ratio * sum(len(enc.encode_ordinary(w)) for w in words)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, max_ratio: float = 1.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts per base kind, digest of the base spans, and all spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        enc = encoding(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = opaque_spans(text, base, enc, max_ratio)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(told(base).encode()).hexdigest(), told(sorted(base + more)), len(more)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_opaque"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_opaque long")
