import collections
import hashlib
import re

import numpy as np
import pytest

from plumbline.llm import exact_dedup, jaccard_join, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, recipe string, spans string"


def table(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, None, None, "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def long_text(seed, words=400):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(words))


def test_exact_groups(spark):
    big = long_text(1, 4000)
    texts = [None, "", "a", "a", big, big + "!", big, "ä", " a"]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(table(spark, texts)).collect()}
    assert [got[k]["keep_id"] for k in range(9)] == [1, 1, 3, 3, 6, 5, 6, 7, 8]
    assert [got[k]["group_size"] for k in range(9)] == [2, 2, 2, 2, 2, 1, 2, 1, 1]
    assert [got[k]["kept"] for k in range(9)] == [False, True, False, True, False, True, True, True, True]
    for k, t in enumerate(texts):
        assert got[k]["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_rows(spark):
    docs = table(spark, ["a", "a", "a", "b", None], [1, 2, 2, 3, None])
    kept = exact_dedup.exact_dedup(docs)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"]) == [(2, "a"), (3, "b")]
    assert kept.columns == docs.columns and kept.count() == 3
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_clashing_identifiers_get_another_seed(spark):
    docs = table(spark, [f"text number {k}" for k in range(12)])
    assert exact_dedup.exact_groups(docs, width=2).where("not kept").count() == 0
    with pytest.raises(ValueError, match="clash"):
        exact_dedup.exact_groups(table(spark, [f"text {k}" for k in range(600)]), width=1)


def near_brute(texts):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_texts():
    rng = np.random.default_rng(7)
    base = long_text(3, 120).split()
    texts = [None, "", "  \t", "one two", "ONE two", "a b c d e", "A B C D E", long_text(9, 3000)]
    for _ in range(30):  # near copies, some beyond the limit
        w = list(base)
        for at in rng.choice(len(w), rng.integers(1, 6), replace=False):
            w[at] = "edit%d" % rng.integers(1e6)
        texts.append(" ".join(w))
    passage = " ".join(long_text(5, 30).split())
    texts += [long_text(50 + k, 60) + " " + passage for k in range(12)]
    texts += [" ".join(base)] * 5
    w = long_text(11, 200).split()
    for k in range(12):  # a chain: each links with the next ones only
        for at in range(16 * k, 16 * k + 12, 6):
            w[at] = f"step{k}{at}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("left", [0.001, 16])
def test_near_duplicates_match_brute_force(spark, left):
    texts = near_texts()
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(table(spark, texts), left).collect()}
    sizes, components = near_brute(texts)
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert [got[k]["component_id"] for k in range(len(texts))] == components


def test_marks_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 40, 700, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[n // 8 :], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])
        apart = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in jaccard_join.marks(a) ^ jaccard_join.marks(b))
        assert apart <= len(np.setxor1d(a, b)) and (n > 1000 or apart >= n // 12)


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Each text holds two of twelve passages, so it shares half of its set with twenty others."""
    passages = [long_text(200 + k, 30) for k in range(12)]
    texts = [passages[a] + " " + passages[b] for a in range(12) for b in range(a)]
    made, linked = [], jaccard_join.linked
    monkeypatch.setattr(jaccard_join, "linked", lambda pairs, sets: made.append(pairs.count()) or linked(pairs, sets))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(table(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == near_brute(texts)[1] and sum(made) <= len(texts)


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0
    rows = jaccard_join.near_duplicates(table(spark, ["a b c d e f", "a b c d e f", None], [4, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["doc_id"]) == [(False, 4)]


def test_first_of_groups_keeps_other_texts_of_a_doc_id(spark):
    x, y = long_text(1, 50), long_text(2, 50)
    docs = table(spark, [x, x, y, None, None], [1, 2, 2, 3, None]).withColumnRenamed("spans", "_doc_id").withColumnRenamed("recipe", "mark")
    kept = jaccard_join.first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, x), (2, y), (3, ""), (0, "")])


def test_frequency_levels_add_up_in_steps(spark, monkeypatch):
    docs = table(spark, near_texts()).repartition(5)
    profiles = jaccard_join.set_profiles(docs).cache()
    once = jaccard_join.frequency_levels(profiles)
    monkeypatch.setattr(jaccard_join, "FAN", 2)
    assert (jaccard_join.frequency_levels(profiles) == once).all()


def removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                cover[s] += 1
                cover[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 64])
def test_passages_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SAMPLE_STEP", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_IN_SAMPLE", hot)
    line = long_text(2, 40)
    texts = [None, "", "x" * 99, "a" * 100, "a" * 350, "ab" * 300, line, line + "é", "é" * 120]
    texts += [long_text(20 + k, 30) + "\n" + line[: 120 + k] + "\n" + long_text(40 + k, 25) for k in range(10)]
    texts += [texts[-1], long_text(99, 6000), long_text(99, 6000)[500:9000]]
    got = {r["doc_id"]: r for r in suffix_dedup.passage_dedup(table(spark, texts), keep_bytes=True).collect()}
    want = removed(texts)
    assert [(got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) for k in range(len(texts))] == want
    assert hashlib.sha256(got[6]["kept"]).hexdigest() == want[6][3]


def test_suffix_ranks_are_alphabetical():
    data = np.frombuffer(b"banana bandana band ban" * 9, np.uint8)
    for depth in (1, 3, 8, 100):
        strings = [bytes(data[k : k + depth]).ljust(depth, b"\0") for k in range(len(data))]
        order = {t: k for k, t in enumerate(sorted(set(strings)))}
        rank = suffix_dedup.suffix_ranks(data, depth)
        assert [order[t] for t in strings] == np.unique(rank, return_inverse=True)[1].tolist()


def test_passages_of_nothing(spark):
    assert suffix_dedup.passage_dedup(table(spark, ["a"]).limit(0)).count() == 0
    text = long_text(1, 60)
    rows = suffix_dedup.passage_dedup(table(spark, [text, text, text], [None, 5, 5])).collect()
    assert collections.Counter(r["n_removed"] for r in rows) == {0: 3}
