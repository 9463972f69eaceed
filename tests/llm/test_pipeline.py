import collections

import corpus_pipeline
import pytest
from plumbline.llm import exact_dedup, jaccard_join, mixing, toxicity
from plumbline.llm.buffers import documents, durable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, copies string, mark string, flag string, text_sha256 string, label string, score string"
NEAR = "one two three four five six seven eight nine ten " * 3 + " ".join(f"w{k}" for k in range(60))
TEXTS = [
    (1, "a b c"), (2, "a b c"), (2, "a b c"), (2, "another text"), (3, None), (4, ""), (None, "a b c"), (None, "x y"),
    (10, NEAR), (11, NEAR + " more"), (11, "far from it"), (12, NEAR.upper()), (20, "long " * 60_000), (20, "long " * 60_000),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s%d" % ((i or 0) % 3) if i != 4 else None, 0, *["z"] * 7) for i, t in rows], SCHEMA)


def pairs(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_exact_stage(spark):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append((i, t))
    got = exact_dedup.exact_dedup(table(spark, TEXTS))
    assert {(i, t or "") for i, t in pairs(got)} == {(max(i if i is not None else -1 for i, _ in g) if g != [(None, t)] else None, t) for t, g in groups.items()}
    assert max(pairs(got).values()) == 1 and got.columns == table(spark, TEXTS).columns


def test_near_stage(spark):
    got = pairs(jaccard_join.first_of_groups(table(spark, TEXTS)))
    gone = collections.Counter(TEXTS) - got
    assert gone == collections.Counter([(2, "a b c"), (2, "a b c"), (11, NEAR + " more"), (12, NEAR.upper())])


def test_mixing_stage(spark):
    docs = table(spark, TEXTS)
    taken = collections.defaultdict(int)
    for r in mixing._taken(docs, mixing.WEIGHTS, mixing.EPOCHS).collect():
        if r["taken"]:
            key = r["doc_id"], r["source"], r["mark"]
            taken[key] = max(taken[key], int(r["taken"] / r["size"] + 0.5))
    got = mixing.mixed_documents(docs)
    keyed = collections.Counter((r["doc_id"], r["source"], r["mark"]) for r in got.select(*mixing._row_key(got)).collect())
    rows = collections.Counter((r["doc_id"], r["source"], r["mark"]) for r in docs.select(*mixing._row_key(docs)).collect())
    assert keyed == collections.Counter({k: n * rows[k] for k, n in taken.items() if n}) and got.columns == docs.columns


def test_toxic_stage(spark):
    docs = table(spark, [*TEXTS, *[(100 + k, f"you awful fool {k}") for k in range(60)], *[(200 + k, f"a calm day {k}") for k in range(60)]])
    labels = spark.createDataFrame([(100 + k, 1, 1) for k in range(60)] + [(200 + k, 1, 0) for k in range(60)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(docs, labels).where("predicted = 0")
    got = toxicity.drop_toxic(docs, labels)
    assert collections.Counter(r["doc_id"] for r in scored.collect()) == collections.Counter(i for (i, _), n in pairs(got).items() for _ in range(n))
    assert not {100 + k for k in range(60)} & {i for i, _ in pairs(got)} and {200 + k for k in range(60)} <= {i for i, _ in pairs(got)}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, sf_dir, stage):
    docs = table(spark, TEXTS).limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, sf_dir).count() == 0


def test_stages_pass_documents_on(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        if name != "source_mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
        if name == "jaccard_join":
            assert jaccard_join.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
