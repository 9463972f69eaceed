"""Codes of vectors, prefix trie and nearest neighbours against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bit_codes, conversations, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, score double, block int"


def vector_table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "c", 0.0, 1) for i, v, lab in rows], VECTORS)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [int(np.floor(4096.0 * np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(g) for _, g, _ in kept) // parts))
    kept = [(i, g + [0] * (parts * width - len(g)), lab) for i, g, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[g[p * width : (p + 1) * width] for _, g, _ in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, g, _ in kept:
                part = g[p * width : (p + 1) * width]
                own[nearest(part, books[p])[1]].append(part)
            for k, members in own.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out, by_label = [], defaultdict(int)
    for i, g, lab in kept:
        found = [nearest(g[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, bytes(k for _, k in found).hex(), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), c, e, by_label[lab], sha) for i, c, e, lab in out)


def code_rows(df):
    return sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def test_vector_codes_match_plain_kmeans(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).astype(np.float32) * 0.2, [0, 1, None][k % 3]) for k in range(120)]
    rows += [(3, rows[3][1], 0), (200, rows[0][1], 1), (None, rows[9][1], 1), (201, [0.0] * 16, 5)]
    rows += [(300, None, 0), (301, [0.1] * 15 + [None], 0), (302, [float("nan")] + [0.1] * 15, 0), (303, [float("inf")] + [0.1] * 15, 0)]
    assert code_rows(vector_codes.product_codes(vector_table(spark, rows))) == plain_codes(rows)


@pytest.mark.parametrize("rows", [[(1, [0.5, -0.25], 3)], [(k, [0.01 * k] * (3 + k % 2 * 8), None) for k in range(20)], [(k, [-0.3] * 8, 1) for k in range(30)]])
def test_vector_codes_few_short_and_equal(spark, rows):
    assert code_rows(vector_codes.product_codes(vector_table(spark, rows))) == plain_codes(rows)


def test_vector_codes_without_vectors(spark):
    got = vector_codes.product_codes(vector_table(spark, [(1, None, 1), (2, [1e9] * 8, 1)]))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0


def test_slices_find_the_nearest_entry():
    rng = np.random.default_rng(2)
    for entries in (1, 3, 64):
        book = rng.integers(-50, 50, (entries, 4))
        points = rng.integers(-3000, 3000, (300, 4))
        apart = ((points[:, None] - book[None]) ** 2).sum(2)
        entry, best = vector_codes.Slices(book).nearest(points)
        assert (entry == apart.argmin(1)).all() and (best == apart.min(1)).all()
    with pytest.raises(ValueError):
        vector_codes.Slices(np.zeros((65, 2), np.int64))


def plain_nearest(rows, k, every):
    able = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, v in {(i, tuple(v)): v for i, v in able}.items():
        if q[0] is None or q[0] % every:
            continue
        scored = []
        for i, w in able:
            if i != q[0]:
                n = max(len(v), len(w))
                a, b = np.pad(v, (0, n - len(v))), np.pad(w, (0, n - len(w)))
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += x * y
                scored.append((-total, i is None, i or 0))
        out |= {(q[0], r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])}
    return out


def test_bit_codes_match_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=32).astype(np.float32) * rng.uniform(0.1, 30), 0) for k in range(400)]
    rows += [(1000 + k, rows[7][1], 0) for k in range(60)] + [(1001, rows[7][1], 0)] * 3 + [(None, rows[7][1], 0), (None, rows[8][1], 0)]
    rows += [(20, rows[20][1], 0), (2000, None, 0), (2020, [0.0] * 32, 0), (2040, [float("nan")] * 32, 0), (2060, [None] * 32, 0), (2080, [], 0), (2100, [1.0, -2.0], 0)]
    df = vector_table(spark, rows)
    queries = df.where("vec_id % 20 = 0")
    want = plain_nearest(rows, 20, 20)
    for block in (100, 10_000):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in bit_codes.nearest(df, queries, block=block, confidence=6.0).collect()}
        assert got == want
    # with the production bound some may be missed; the scores of those found are exact
    got = {(r["query_id"], r["vec_id"]) for r in bit_codes.nearest(df, queries, block=100).collect()}
    assert len(got & {(q, i) for q, _, i, _ in want}) >= 0.98 * len(got)


def test_bit_codes_measure_few_exactly(monkeypatch):
    """What passes the codes' wide bound is measured in single precision first."""
    rng = np.random.default_rng(6)
    n, dims, k = 6000, 64, 20
    for size in (np.ones(n), 10.0 ** rng.uniform(-100, 100, n), np.where(np.arange(n) % 2, 1e-30, 1e-32)):
        v = rng.standard_normal((n, dims)) * size[:, None]
        v[7] = v[3007]
        turned, length = bit_codes.unit(v)
        turned = turned @ bit_codes.rotation(dims)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(v.ravel()))
        codes = pa.array([b.tobytes() for b in np.packbits(turned >= 0, axis=1)], pa.binary())
        columns = [pa.array(np.arange(n)), pa.array(np.ones(n, int)), lists, codes, pa.array(length), pa.array(np.abs(turned).sum(axis=1) / np.sqrt(dims))]
        batch = pa.RecordBatch.from_arrays(columns, ["vec_id", "copies", "embedding", "code", "length", "align"])
        block, measured, exact = bit_codes.Block(batch, dims, 6.0, bit_codes.SEED), [], bit_codes.Block.exact
        monkeypatch.setattr(bit_codes.Block, "exact", lambda self, q, at, exact=exact, measured=measured: measured.append(len(at)) or exact(self, q, at))
        for own, (at, score) in zip(range(10), block.search(v[:10], np.arange(10), k), strict=True):
            every = np.cumsum(v * v[own], axis=1)[:, -1]
            want = [x for x in np.lexsort((np.arange(n), -every)) if x != own][:k]
            assert at.tolist() == want and score.tolist() == every[want].tolist()
        monkeypatch.undo()
        assert sum(measured) < 10 * 3 * k


def test_bit_codes_few_and_none(spark):
    df = vector_table(spark, [(0, [1.0], 0), (1, [2.0], 0), (2, [3e38], 0)])
    got = [tuple(r) for r in bit_codes.nearest(df, df.where("vec_id = 0")).collect()]
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 2), (0, 2, 1)]
    assert bit_codes.nearest(df.limit(0), df.limit(0)).count() == 0
    assert bit_codes.nearest(df.where("vec_id = 0"), df).where("query_id = 0").count() == 0


def test_bit_codes_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    want = {(q, i) for q, _, i, _ in plain_nearest(rows, 20, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in bit_codes.op13_bit_codes(spark, sf_dir).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.99 * len(want)


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, node string, id string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, ends, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(own) - 1) * words
            leaves[path[:d]] += not children[path]
    sha = lambda path: hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def trie_rows(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "n", "i") for r in rows], CONVERSATIONS)
    return sorted(tuple(-1 if x is None else x for x in r) for r in conversations.prefix_trie(df, **more).collect())


@pytest.mark.parametrize("width", [2, 6])
def test_trie_matches_brute_force(spark, width):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(90):
        rows += [(c, t, ["user", "assistant"][t % 2], f"w{rng.integers(2)} more") for t in range(rng.integers(1, 12))]
    rows += [(20, 3, "user", None), (40, None, None, ""), (60, 99, "user", "long " * 50_000)]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(13)]  # copies
    rows += [(c, t, "user", f"deep {t}") for c in (300, 301, 320) for t in range(45)]
    rows += [(320, 50, "user", "end"), (None, 1, "user", "none"), (5, 1, "assistant", "again"), (5, 1, "assistant", "again")]
    rows += [(441, 0, "user", "its only turn is shared away"), (443, 0, "user", "x"), (444, 0, None, None)]
    assert [r for r in trie_rows(spark, rows, width=width)] == plain_order(plain_trie(rows))


def plain_order(rows):
    return sorted(tuple(r) for r in rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == [] and trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_runs_are_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN", 7)
    rows = [(c, 0, "user", "one turn") for c in range(100_000, 100_900, 20)]
    assert trie_rows(spark, rows) == plain_order(plain_trie(rows))
