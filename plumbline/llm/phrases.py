"""Parsing of texts into overlapping phrases at rolling-hash triggers.

A trigger is a position whose rolling hash of GRAM bytes is the least (the leftmost of
equals) among all positions of some DEPTH-byte string of the text. Every string of DEPTH
bytes thus has one trigger, at the same place wherever the string occurs. The strings
that share a trigger start side by side; the bytes they cover together are the trigger's
phrase. Phrases overlap, and no phrase is a proper prefix of another with the same
trigger and extent, so strings of two phrases can only be equal if the triggers' grams
are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plumbline.llm.buffers import BLOCK, byte_table, gear_hash, mix64

DEPTH = 100
GRAM_DOUBLINGS = 5
GRAM = 1 << GRAM_DOUBLINGS
_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _tables[name] = np.cumprod(p)
    return _tables["up"], _tables["down"]


@dataclass(frozen=True)
class Phrases:
    """Of a run of texts: row of each phrase, place of its first string in the text, number
    of strings, hash of its trigger's gram, and fingerprint of its bytes."""

    row: np.ndarray
    start: np.ndarray
    strings: np.ndarray
    trigger: np.ndarray
    mark: np.ndarray


class Parser:
    """Parses a run of texts (together at most a few megabytes, or one long text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_table(57)[data] * up[:n], out=self.sums[1:])
        places = n - GRAM + 1
        if places <= 0:
            self.anchor = np.zeros(0, np.int64)
            return
        self.gram = mix64(gear_hash(data, byte_table(53), GRAM_DOUBLINGS)[GRAM - 1 :])
        # high bits of the hash, then the place: the least is the leftmost of the least
        low = np.uint64((1 << max(places, 2).bit_length()) - 1)
        key = (self.gram & ~low) | np.arange(places, dtype=np.uint64)
        width, least = 1, key
        span = DEPTH - GRAM + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        rest = span - width
        if rest:
            least = np.minimum(least[:-rest], least[rest:]) if len(least) > rest else least[:0]
        self.anchor = (least & low).astype(np.int64)  # trigger of the string that starts at each place

    def marks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of data[start:end]."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def phrases(self) -> Phrases:
        n = len(self.anchor)
        # the text in which each string starts, if it ends there too
        inside = np.zeros(n + 1, np.int32)
        last = self.offsets[1:] - DEPTH + 1  # first place of no string
        rows = np.flatnonzero(last > self.offsets[:-1])
        inside[self.offsets[rows]] += 1
        inside[last[rows]] -= 1
        whole = np.cumsum(inside[:n]).astype(bool)
        begins = np.ones(n, bool)
        begins[1:] = (self.anchor[1:] != self.anchor[:-1]) | ~whole[:-1]
        firsts = np.zeros(n, bool)
        firsts[self.offsets[rows]] = True
        start = np.flatnonzero(whole & (begins | firsts))
        # a phrase ends before the next one or where strings stop fitting the text
        row = np.searchsorted(self.offsets, start, "right") - 1
        stop = np.minimum(np.append(start[1:], n), last[row])
        return Phrases(row, start - self.offsets[row], stop - start, self.gram[self.anchor[start]], self.marks(start, stop - 1 + DEPTH))

    def strings(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the strings of phrases (start in the run, number): place, trigger's gram hash
        and fingerprint."""
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return at, self.gram[self.anchor[at]], self.marks(at, at + DEPTH)


__all__ = ["BLOCK", "DEPTH", "GRAM", "Parser", "Phrases"]
