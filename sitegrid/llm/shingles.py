"""Word-shingle sets as sorted 64-bit integers, computed for whole Arrow slices at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import mixed

SLICE_BYTES = 1_000_000
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether it belongs to a word, and a random value that ignores the case of A-Z."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    values = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return word, values


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = _U(pow(int(_P), -1, 2**64))
        for k, base in enumerate((_P, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated documents, and the document of each word.

    ``starts`` are the documents' first bytes. A word's hash is its polynomial over the
    random byte values, read off one running sum.
    """
    is_word, values = _tables()
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = starts[starts < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    hashes = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return hashes, np.searchsorted(starts, a, "right") - 1


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first document, hashes, bounds) for slices of a string column.

    ``hashes[bounds[i]:bounds[i + 1]]`` are the distinct shingle hashes of document i of the
    slice, ascending. A document with fewer words than ``size`` has its whole word sequence
    as its one shingle; one without words, or a null one, has none.
    """
    large = pa.types.is_large_string(column.type)
    _, at, body = column.buffers()
    ends = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    null = np.asarray(column.is_null())
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        data, starts = body[ends[i] : ends[j]], ends[i:j] - ends[i]
        words, doc = word_hashes(data, starts)
        if null[i:j].any():
            live = ~null[i:j][doc]
            words, doc = words[live], doc[live]
        yield i, *_distinct(words, doc, j - i, size)
        i = j


def _distinct(words: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    m = max(0, len(words) - size + 1)
    code = np.full(m, _U(size))
    for k in range(size):
        code = code * _P + words[k : k + m]
    whole = doc[:m] == doc[size - 1 : size - 1 + m] if m else np.zeros(0, bool)
    code, owner = mixed(code[whole]), doc[:m][whole]
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    short, short_owner = [], []
    for k in range(1, size):
        those = np.flatnonzero(counts == k)
        if len(those):
            c = np.full(len(those), _U(k))
            for w in range(k):
                c = c * _P + words[first[those] + w]
            short.append(mixed(c))
            short_owner.append(those)
    if short:
        code, owner = np.concatenate([code, *short]), np.concatenate([owner, *short_owner])
        order = np.argsort(owner, kind="stable")
        code, owner = code[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(code[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds
