"""Collections as a partitioned source and sink."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from plumbline.sources import collections as docs
from plumbline.sources import shards

ROWS = [
    (s, c, p, c + 0.1, p / 3, -1e-300, None if c % 2 else float(p), f'c"{c}' if c else None, c == 2)
    for s, n in (("a/b ü", 7), ("plain", 2))
    for c in range(n)
    for p in (10, 2, 30 + c)
]


def document(collections, version="1"):
    return json.dumps({"vc_pointcollections_json_version": version, "collections": collections})


def test_round_trip_in_bounded_documents(spark, tmp_path):
    points = spark.createDataFrame(ROWS, shards.SCHEMA).withColumn("more", F.lit(1))
    path = str(tmp_path / "out")
    shards.write_sharded(points, path, points_per_document=4)
    back = shards.read_sharded(spark, path)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, points.drop("more").collect()))
    files = list(pathlib.Path(path).rglob("*.json"))
    held = [json.loads(f.read_text())["collections"] for f in files]
    assert all(len(h) <= 2 for h in held) and sum(map(len, held)) == 9
    # documents say the same to the other reader, and ids are in order
    assert all(list(map(int, c["points"])) == sorted(map(int, c["points"])) for h in held for c in h.values())
    texts = spark.createDataFrame([(str(f.parent), f.read_text()) for f in files], "source string, value string")
    assert docs.flatten(texts).count() == len(ROWS)
    assert not list(pathlib.Path(path).glob("_temporary*")) and (pathlib.Path(path) / "_SUCCESS").exists()
    # append adds, overwrite replaces
    shards.write_sharded(points.where("source = 'plain'"), path)
    assert shards.read_sharded(spark, path).count() == len(ROWS) + 6
    assert docs.duplicate_ids(shards.read_sharded(spark, path)).count() == 6
    shards.write_sharded(points.where("source = 'plain'"), path, mode="overwrite")
    assert shards.read_sharded(spark, path).count() == 6


def test_nothing_shows_of_a_failed_job(spark, tmp_path):
    path = str(tmp_path / "out")
    points = spark.createDataFrame(ROWS, shards.SCHEMA)
    shards.write_sharded(points, path)
    twice = points.unionAll(points.limit(1))
    nowhere = points.withColumn("x", F.when(F.col("cid") == 1, float("nan")).otherwise(F.col("x")))
    anonymous = points.withColumn("pid", F.when(F.col("cid") == 1, F.col("pid")))
    for bad, why in ((twice, "duplicate point id"), (nowhere, "no valid point"), (anonymous, "no valid point")):
        with pytest.raises(Exception, match=why):
            shards.write_sharded(bad, path, mode="overwrite")
    assert shards.read_sharded(spark, path).count() == len(ROWS)
    assert not list(pathlib.Path(path).glob("_temporary*"))


@pytest.mark.parametrize(
    "text, why",
    [
        (document({}, "2"), "unsupported version"),
        (document({"1": {"points": {}}, "01": {"points": {}}}), "duplicate collection id"),
        (document({"1": {"points": {"1": {"p": [0, 0, 0]}, "01": {"p": [0, 0, 0]}}}}), "duplicate point id"),
        ('{"vc_pointcollections_json_version": "1", "collections": {"1": {"points": {"5": {"p": [0,0,0]}, "5": {"p": [1,0,0]}}}}}', "duplicate point id"),
        (document({"x": {"points": {}}}), "is no id"),
        (document({"1": {"points": {"1": {"p": [1, 2]}}}}), "invalid point"),
        (document({"1": {"points": {"1": {"p": [1, float("nan"), 3]}}}}), "invalid point"),
        (document({"1": {"points": {"1": {"p": [1, 2, 3], "wind_a": float("inf")}}}}), "invalid point"),
    ],
)
def test_bad_documents(spark, tmp_path, text, why):
    (tmp_path / "bad.json").write_text(text)
    (tmp_path / "good.json").write_text(document({"7": {"name": "n", "points": {"10": {"p": [0, 0, 0], "wind_a": 1.0}, "2": {"p": [1, 0, 0]}}}}))
    with pytest.raises(Exception, match=why):
        shards.read_sharded(spark, str(tmp_path)).count()
    rest = shards.read_sharded(spark, str(tmp_path), strict=False)
    assert [r["pid"] for r in rest.where("source like '%good.json'").orderBy("pid").collect()] == [2, 10]
    assert rest.where("source not like '%good.json'").count() <= 1


def test_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    shards.write_sharded(spark.createDataFrame([], shards.SCHEMA), path)
    assert shards.read_sharded(spark, path).count() == 0
    (tmp_path / "out" / "e.json").write_text(document({}))
    assert shards.read_sharded(spark, path).count() == 0


def test_documents_share_partitions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    points = spark.createDataFrame(ROWS, shards.SCHEMA)
    shards.write_sharded(points, path, points_per_document=1)
    sizes = {str(f): f.stat().st_size for f in pathlib.Path(path).rglob("*.json")}
    reader = shards.CollectionReader({"path": path})
    assert len(sizes) == 9 and len(reader.partitions()) == 1
    assert sorted(map(repr, shards.read_sharded(spark, path).collect())) == sorted(map(repr, points.collect()))
    monkeypatch.setattr(shards, "OPEN_COST", 0)
    monkeypatch.setattr(shards, "PARTITION_BYTES", 2 * max(sizes.values()))
    held = [p.held for p in reader.partitions()]
    assert sorted(f for h in held for f, _ in h) == sorted(sizes) and 2 <= len(held) < 9
    assert all(sum(sizes[f] for f, _ in h) <= 2 * max(sizes.values()) for h in held)
    monkeypatch.setattr(shards, "PARTITION_BYTES", 1)
    assert len(reader.partitions()) == 9
