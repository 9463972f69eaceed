"""The classifiers' steps against plain versions, and what bounds their samples."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality, toxicity
from plumbline.llm.ngrams import BITS, hashed_ngrams, sigmoid

DOCS = "doc_id long, text string, lang string, source string, _id string, label string, score string, _m string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", "z", "m") for i, t in rows], DOCS)


def buckets(text):
    return {int(b) for _, found in hashed_ngrams(np.frombuffer(text.encode(), np.uint8)) for b in found}


def test_samples_hold_one_row_a_document(spark):
    rows = [(k, f"text {k}") for k in range(40)] + [(7, f"other {k}") for k in range(600)] + [(8, "text 8")] * 600
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    got = toxicity.sample(docs_of(spark, rows), labels, 20).collect()
    assert len(got) == 20 and len({r["doc_id"] for r in got}) == 20 and sum(r["label"] for r in got) == 10
    again = toxicity.sample(docs_of(spark, rows[::-1]), labels, 20).collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(r["doc_id"], r["text"]) for r in again}


def test_ratios_of_naive_bayes(spark):
    texts = [(1, "awful fool"), (1, "awful day"), (1, "fool, awful"), (0, "a calm day"), (0, "calm sea"), (0, ""), (0, "a fool's calm day")]
    frame = spark.createDataFrame([(k, label, t) for k, (label, t) in enumerate(texts)], "doc_id long, label int, text string")
    counts, per_class = toxicity.class_counts(frame)
    seen = [Counter(b for label, t in texts if label == c for b in buckets(t)) for c in (0, 1)]
    for c in (0, 1):
        assert per_class[c] == sum(label == c for label, _ in texts)
        assert {int(b): int(counts[c, b]) for b in np.flatnonzero(counts[c])} == seen[c]
    best, ratio = toxicity.select_ngrams(counts, per_class, 16)
    n = [sum(label == c for label, _ in texts) for c in (0, 1)]

    def z(b):
        share = [seen[c][b] / n[c] for c in (0, 1)]
        pooled = (seen[0][b] + seen[1][b]) / sum(n)
        return abs(share[1] - share[0]) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n[0] + 1 / n[1])) if seen[0][b] + seen[1][b] >= 3 else 0.0

    every = set(seen[0]) | set(seen[1])
    least = sorted((z(b) for b in every), reverse=True)[15]
    assert all(z(int(b)) >= least - 1e-9 for b in best)
    for b, r in zip(best, ratio, strict=True):
        s = toxicity.SMOOTHING
        assert math.isclose(r, math.log((seen[1][int(b)] + s) / (n[1] + 2 * s)) - math.log((seen[0][int(b)] + s) / (n[0] + 2 * s)), rel_tol=1e-9)


def test_surest_labels_of_all_rows(spark):
    rng = np.random.default_rng(6)
    columns, width = 24, quality.LAYOUT + quality.LANGS + quality.SOURCES
    x, m = rng.integers(0, 2, (500, columns)).astype(np.uint8), rng.normal(size=(500, width)).astype(np.float32)
    ids = [k % 450 for k in range(500)]  # some repeat with other views
    views = spark.createDataFrame([(i, -1, bytearray(np.packbits(a).tobytes()), bytearray(b.tobytes())) for i, a, b in zip(ids, x, m, strict=True)], quality.VIEWS).repartition(5)
    models = {"text": (rng.normal(size=columns).astype(np.float32), 0.3), "meta": (rng.normal(size=width).astype(np.float32), -0.2)}
    centre, spread = rng.normal(size=width).astype(np.float32), np.full(width, 1.5, np.float32)
    known, most = {"text": {1, 2, 3}, "meta": set()}, {1: 9, 0: 5}
    got = quality.surest(views, columns, models, known, most, centre, spread)
    want = {}
    for view, rows in (("text", x.astype(np.float32)), ("meta", (m - centre) / spread)):
        p = sigmoid((rows * models[view][0]).sum(axis=1, dtype=np.float64) + models[view][1])
        for label, sure in ((1, p), (0, 1 - p)):
            best = {}
            for i, s in zip(ids, sure, strict=True):
                if s >= quality.SURE and i not in known[view]:
                    best[i] = max(s, best.get(i, 0))
            want[view, label] = sorted(best, key=lambda i: (-best[i], i))[: most[label]]
    for key, expected in want.items():
        assert [r["doc_id"] for r in got if (r["teacher"], r["label"]) == key] == expected


def test_views_hand_labels_to_each_other(spark):
    """A word marks good texts and a source marks them too, but labelled rows have the word only
    with one source: the text view has to teach the other source to the metadata view."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(900):
        good = bool(rng.integers(2))
        source = ("fine" if good else "poor") if k >= 300 else ("fine" if good and k % 2 else "plain")
        text = " ".join(["w%d" % rng.integers(50) for _ in range(30)] + (["splendid"] * 3 if good else ["rubbish"] * 3))
        rows.append((k, text, "en", source, "x", "y", "z", "m"))
        if k < 300:
            labels.append((k, int(good), 0))
    docs = spark.createDataFrame(rows, DOCS)
    got = quality.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    poor = got.join(docs.where("source = 'poor'").select("doc_id"), "doc_id").agg(F.avg((F.col("meta_score") < 0.5).cast("double"))).first()[0]
    assert poor > 0.9


def test_quality_of_repeated_long_and_clashing(spark):
    rows = [(k, "good words here " * 5 if k % 2 else "bad stuff there " * 5) for k in range(80)] + [(3, "good words here " * 5)] * 200 + [(500, "good words " * 60_000), (None, "bad stuff"), (501, None), (502, "")]
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(80)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for op in (quality.quality, toxicity.toxicity):
        got = op(docs_of(spark, rows), labels).collect()
        assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
        assert all(0 <= r["score"] <= 1 for r in got)


def test_buckets_are_in_range():
    assert all(0 <= b < 1 << BITS for b in buckets("any text at all"))


def test_fit_makes_one_matrix_on_the_driver():
    """12,000 x 1,024 values are 49 MB in single precision; nothing beside them may be as large."""
    import tracemalloc

    import numpy as np

    from plumbline.llm import toxicity
    from plumbline.llm.ngrams import fit_logistic

    rng = np.random.default_rng(1)
    x, scale, y = rng.random((3000, 1024)) < 0.2, rng.normal(size=1024), rng.integers(0, 2, 3000)
    want = fit_logistic(x * scale, y, np.ones(3000), 1e-4, rounds=3)
    tracemalloc.start()
    got = fit_logistic(toxicity.scaled(x, scale), y, np.ones(3000), 1e-4, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[0], want[0], atol=1e-6) and abs(got[1] - want[1]) < 1e-6
    assert peak < 1.6 * 4 * x.size
