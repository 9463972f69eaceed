"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.llm.buffers import byte_table, mix64
from plumbline.llm.ngrams import slabs

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_cache: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) <= n:
        _cache["up"], _cache["down"] = _powers(n, _BASE), _powers(n, _INVERSE)
    return _cache["up"], _cache["down"]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word (a run of bytes that aren't white space) and the hash of its
    bytes, A-Z folded to a-z."""
    table = byte_table(41)
    table[65:91] = table[97:123]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return start, mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `words` words; of a shorter
    text the hash of all its words; of a text without words nothing."""
    for _, part, ends in slabs(data, offsets, block=1 << 20):
        # texts meet without white space between them: the words are cut at the texts' ends
        gapped = np.full(len(part) + len(ends), 32, np.uint8)
        at = np.arange(len(part)) + np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        gapped[at] = part
        start, h = word_hashes(gapped)
        first = np.searchsorted(start, ends + np.arange(len(ends)))
        n = max(len(h) - words + 1, 0)
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs = (runs ^ h[k : k + n]) * _BASE + _ODD if n else runs
        runs = mix64(runs)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(runs[a : b - words + 1])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    whole = (whole ^ x) * _BASE + _ODD
                yield mix64(whole)
            else:
                yield np.zeros(0, np.uint64)
