import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import audio, licences, line_dedup, mixing, packing, quality, toxicity
from plumbline.llm.licence_texts import TEXTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "t") for i, t, s in rows], SCHEMA)


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    words = ["The", "don't", "Über", "x1y", "<|endoftext|>", "a.b,", "naïve!", "​", "😀", "CAFÉ́", "end.", "WORD,"]
    texts = [None, "", " \n\t", "<|ENDOFTEXT|> <|endoftext|>"] + [" ".join(rng.choice(words, rng.integers(1, 900))) for _ in range(40)] + ["word " * 9000]
    out = packing.pack(table(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(7, texts[7], "s")]), group=8).toPandas()
    once = out.drop_duplicates(["doc_id", "piece"])
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = once[once.doc_id == k].sort_values("piece")
        parts = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        assert mine.ids_crc32.tolist() == [zlib.crc32(p.tobytes()) for p in parts]
        assert mine.length.tolist() == [len(p) for p in parts] and mine.start.tolist() == [2048 * j for j in range(len(parts))]
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packing.pack(table(spark, [(1, "a", "s")]).limit(0)).count() == 0


def test_local_search_beats_best_fit():
    # best fit leaves three bins; an exchange of one for two closes two
    lengths = [6, 5, 4, 3, 2]
    bins = packing.local_search([[0, 3], [1, 4], [2]], lengths, 10)
    assert len(bins) == 2 and all(sum(lengths[i] for i in b) == 10 for b in bins)
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 2049, 300).tolist()
        packed = packing.pack_lengths(n)
        assert sorted(i for b in packed for i in b) == list(range(300)) and max(sum(n[i] for i in b) for b in packed) <= 2048


def test_audio(spark):
    texts = [None, "", "a" * 64, "b" * 65, "voice " * 4000]
    rows = {r["doc_id"]: r for r in audio.audio_features(table(spark, [(k, t, "s") for k, t in enumerate(texts)]), media=True, tensors=True).collect()}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        pad = b + bytes(-len(b) % 64 if b else 64)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert audio.read_wav(bytes(r["media"])) == pad and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        t = audio.read_tensors(bytes(r["tensors"]))
        assert sum(t.column("frames").to_pylist()) == r["n_frames"] and t.schema.field("log_mel").type.shape == [64, 24]
    assert rows[0]["feature"] == rows[1]["feature"]


def test_resampling_is_blind_to_blocks_and_keeps_a_tone():
    t = np.arange(4000)
    x = (128 + 100 * np.sin(2 * np.pi * 500 * t / audio.RATE)).astype(np.uint8)
    y = audio.resample(x, 0, 1600)
    assert np.array_equal(y[400:], audio.resample(x, 400, 1600))
    want = 100 / 128 * np.sin(2 * np.pi * 500 * np.arange(1600) / audio.OUT_RATE)
    assert np.abs(y - want)[20:-20].max() < 0.03
    assert audio.hysteresis(np.array([0, 5, 9, 5, 0, 0, 5, 0, 0, 0], float)).tolist() == [[1, 4]]


def test_mixing_matches_plain_python(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join("w" * int(rng.integers(1, 60))), s) for k, s in enumerate(rng.choice(["a", "b", "c", "d"], 200, p=[0.7, 0.1, 0.1, 0.1]).tolist())]
    rows += [(900, None, None), (901, "x y z", None), (902, "", "b")]
    got = mixing.mix(table(spark, rows)).toPandas().set_index("doc_id")
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert got["size"].to_dict() == size
    sources = sorted({s for _, _, s in rows if s}) + [None]
    total = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    full, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in sources if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / w for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    for i, _, s in rows:
        assert got.loc[i, "source_size"] == total[s] and got.loc[i, "target"] == pytest.approx(target[s])
        assert 0 <= got.loc[i, "taken"] <= 3 * size[i]
    for s in sources:
        taken = sum(got.loc[i, "taken"] for i, _, x in rows if x == s)
        assert abs(taken - target[s]) <= max(2, 0.002 * sum(total.values()))
    assert mixing.mix(table(spark, [(1, "a", "s")]).limit(0)).count() == 0
    kept = mixing.mixed_documents(table(spark, rows))
    assert kept.columns == table(spark, rows[:1]).columns and kept.where("source = 'b'").count() > 0


def test_mixing_serves_sources_far_below_a_slot(spark):
    # 20 million words are 76 to one of 2**18 slots; the small sources' targets are 9 to 60 words
    big = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100_000).alias("text"), F.element_at(F.array(F.lit("a"), F.lit("z")), (F.col("id") % 2 + 1).cast("int")).alias("source"))
    small = spark.range(1000, 1018).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") - 997).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    docs = big.unionAll(small).cache()
    by_source = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    rows = {r["source"]: r for r in by_source.collect()}
    assert len(rows) == 20 and all(r["target"] > 0 for r in rows.values())
    assert {s: r["taken"] for s, r in rows.items() if abs(r["taken"] - r["target"]) > 2} == {}
    assert mixing.mixed_documents(docs).select("source").distinct().count() == 20


def test_schedule_is_the_listed_one(spark):
    """Counts of slots are those of the slots one by one, whose sources alternate evenly."""
    sizes = spark.createDataFrame([("a", 900), ("b", 300), (None, 37), ("c", 60)], "source string, size long")
    targets = mixing.source_targets(sizes)
    plan = {r["source"]: (r["n_slots"], r["slots"]) for r in mixing.schedule(targets).collect()}
    slots = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.slot_sources(targets).collect())
    n = 1597  # the least Fibonacci number of 1297 words or more
    t = {r["source"]: r for r in targets.collect()}
    points = [k * 987 % n / n for k in range(n)]
    listed, ranks = [], dict.fromkeys(plan, 0)
    for k, u in enumerate(points):
        s = max((s for s in plan if t[s]["start_at"] / 1297 <= u + 1e-12), key=lambda s: t[s]["start_at"])
        listed.append((k, s, ranks[s]))
        ranks[s] += 1
    assert slots == listed and {s: (n, ranks[s]) for s in plan} == plan
    for s in plan:  # any run holds the sources in their proportions
        share = ranks[s] / n
        assert all(abs(sum(x == s for _, x, _ in slots[a : a + 200]) - 200 * share) <= 4 for a in range(0, n - 200, 50))
    assert mixing.slot_sources(targets.limit(0)).count() == 0


def test_documents_give_the_blocks_of_listed_slots(spark, monkeypatch):
    """Slot by slot in plain Python; a slot that isn't there takes nothing."""
    rng = np.random.default_rng(8)
    rows = [(k, "w " * int(rng.integers(0, 90)), s) for k, s in enumerate(rng.choice(["a", "b", None], 150, p=[0.8, 0.15, 0.05]).tolist())]
    docs = table(spark, rows)
    got = mixing.mix(docs).toPandas().set_index("doc_id")
    size = got["size"].to_dict()
    total, n = sum(size.values()), next(f for f in mixing.FIBONACCI if f * mixing.SLOT_WORDS >= sum(size.values()))
    before = mixing.FIBONACCI[mixing.FIBONACCI.index(n) - 1]
    start, shares = 0.0, []
    for s in ["a", "b", None]:
        target = next(got.loc[i, "target"] for i, _, x in rows if x == s)
        shares.append((s, math.ceil(start * n / total), n if s is None else math.ceil((start + target) * n / total), int(target + 0.5)))
        start += target
    stream = {s: [i for _, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s) for _ in range(size[i])] * 3 for s, *_ in shares}
    ranks, taken = dict.fromkeys(stream, 0), dict.fromkeys(size, 0)

    def take(s, words):
        block = stream[s][: words][ranks[s] * total // n : (ranks[s] + 1) * total // n]
        ranks[s] += 1
        for i in block:
            taken[i] += 1

    for slot in range(n):
        s, *_, words = next(x for x in shares if x[1] <= slot * before % n < x[2])
        take(s, words)
    for s, *_, words in shares:
        while ranks[s] * total // n < words:
            take(s, words)
    assert got["taken"].to_dict() == taken
    whole = mixing.slot_sources
    monkeypatch.setattr(mixing, "slot_sources", lambda *args: whole(*args).where("not (source <=> 'a' and rank = 0)"))
    first = total // n  # the words of a's first block
    fewer = mixing.mix(docs).toPandas().set_index("doc_id")["taken"].to_dict()
    lost = {i: taken[i] - fewer[i] for i in taken if taken[i] != fewer[i]}
    assert lost == {i: stream["a"][:first].count(i) for i in stream["a"][:first]}


def test_line_dedup(spark):
    page = lambda k: f"<html><nav>Menu</nav><p>  text {k} </p><p>same</p><p>same</p><script>x='</p>'</script></html>"
    rows = [(k, "http://User@Host.example:80/a?b", page(k)) for k in range(4)] + [(9, "http://other.example/", page(1)), (10, None, None), (10, "no url", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r["page_id"], r["host"]): r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0, "host.example"]["text"] == "text 0" and got[0, "host.example"]["n_dropped"] == 3
    assert got[9, "other.example"]["text"] == "Menu\ntext 1\nsame\nsame"
    assert got[10, ""]["n_lines"] == 0 and len(got) == 6
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_licences(spark):
    mit = TEXTS["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + mit.upper().replace(",", " ;"), "s"),
        (2, mit + " and more", "s"),
        (3, "Released under the mit LICENCE\nother line\nLicensed under CC BY 4.0!", "s"),
        (4, None, "s"),
        (5, "© 2021 X", "s"),
        (6, "word " * 50_000, "s"),
    ]
    got = {r["doc_id"]: r for r in licences.scan_licences(table(spark, rows), licences.known_licences(spark)).collect()}
    assert got[1]["license_id"] == "MIT" and {got[k]["license_id"] for k in (2, 3, 4, 5, 6)} == {None}
    assert got[3]["notices"] == ["MIT", "CC-BY-4.0"] and got[4]["notices"] == []
    assert licences.scan_licences(table(spark, rows).limit(0), licences.known_licences(spark)).count() == 0


def labelled_docs(spark, n=400):
    rng = np.random.default_rng(8)
    plain = ["the", "river", "bank", "stone", "garden", "light", "winter"]
    rows = []
    for k in range(n):
        w = rng.choice(plain, 40).tolist()
        if k % 5 == 0:
            w[int(rng.integers(40))] = "horrible"
        rows.append((k, " ".join(w), "s"))
    labels = spark.createDataFrame([(k, 1 - int(k % 5 == 0), int(k % 5 == 0)) for k in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return table(spark, [*rows, (n, None, "s"), (n + 1, "", "s"), (n + 2, "horrible " * 3, None)]), labels


def test_toxicity_learns_on_its_own_folds(spark):
    docs, labels = labelled_docs(spark)
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    assert [got.loc[k, "held_out"] for k in range(50)] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)]
    right = [got.loc[k, "predicted"] == int(k % 5 == 0) for k in range(400) if got.loc[k, "held_out"]]
    assert np.mean(right) > 0.98 and got.score.between(0, 1).all()
    assert got.loc[402, "predicted"] == 1 and got.loc[400, "score"] == got.loc[401, "score"]
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 322) < 8
    assert set(toxicity.toxicity(docs, labels.limit(0)).toPandas().predicted) == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_quality(spark):
    docs, labels = labelled_docs(spark)
    got = quality.quality(docs, labels).toPandas().set_index("doc_id")
    right = [got.loc[k, "predicted"] == 1 - int(k % 5 == 0) for k in range(400) if got.loc[k, "held_out"]]
    assert np.mean(right) > 0.95
    assert set(quality.quality(docs, labels.limit(0)).toPandas().predicted) == {1}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_licences_of_spread_out_texts(spark):
    texts = [TEXTS["MIT"], TEXTS["MIT"] + "\n" * 3000, TEXTS["MIT"].replace(", ", "," + "\n" * 500), TEXTS["MIT"].replace(", ", ",\r\n")]
    found = licences.scan_licences(table(spark, [(k, t, "s") for k, t in enumerate(texts)]), licences.known_licences(spark))
    assert [r["license_id"] for r in found.collect()] == ["MIT"] * 4
