"""Character n-gram presence features and logistic regression on few columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.llm.buffers import BLOCK, byte_table

BITS = 18
ORDERS = (3, 4, 5, 6)
_STEP = np.uint32(0x9E3779B1)


def _folding() -> np.ndarray:
    """Values of the bytes, with A-Z as a-z and white space as one."""
    table = byte_table(23).astype(np.uint32)
    table[65:91] = table[97:123]
    table[9:14] = table[32]
    return table


def hashed_ngrams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of the n-gram that starts at each byte) for each order."""
    folded = _folding()[data]
    h = folded.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(folded) < n:
            return
        h = h[: len(folded) - n + 1] * _STEP + folded[n - 1 :]
        if n in ORDERS:
            yield n, ((h ^ (h >> np.uint32(15))) * _STEP) >> np.uint32(32 - BITS)


def slabs(data: np.ndarray, offsets: np.ndarray, most_rows: int = 1024, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `block` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def present(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
    """rows x columns: whether a text has an n-gram of the column. column: of each
    bucket, or -1. Every byte is looked at; long texts go block by block."""
    out = np.zeros((len(offsets) - 1, columns), bool)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + max(ORDERS) - 1]
        for n, bucket in hashed_ngrams(part):
            col = column[bucket[:BLOCK]]
            hit = np.flatnonzero(col >= 0)
            row = np.searchsorted(offsets, hit + at, "right") - 1
            whole = hit + at + n <= offsets[row + 1]
            out[row[whole], col[hit[whole]]] = True
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def pulled(x: np.ndarray, err: np.ndarray, most: int = 128) -> np.ndarray:
    """x.T @ err, `most` columns at a time: err is in double precision, and x would be copied to it whole."""
    return np.concatenate([x[:, at : at + most].T @ err for at in range(0, x.shape[1], most)] or [np.zeros(0)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Ridge-penalised weighted logistic regression by accelerated gradient steps."""
    x = x.astype(np.float32, copy=False)
    total = weight.sum()
    v = np.random.default_rng(5).normal(size=x.shape[1]).astype(np.float32)
    top = 1.0
    for _ in range(12):
        v = x.T @ (weight * (x @ v)).astype(np.float32)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1.0 / (0.25 * (top / total + 1.0) * 1.1 + ridge)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for k in range(rounds):
        m = k / (k + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        err = (weight * (sigmoid(x @ yw + yb) - y)).astype(np.float32) / total
        pw, pb = w, b
        w = (yw - step * (pulled(x, err) + ridge * yw)).astype(np.float32)
        b = yb - step * float(err.sum())
    return w, b
