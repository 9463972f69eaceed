"""Point-collection documents: JSON with a version, collections by id and points by id."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
SCHEMA = """struct<vc_pointcollections_json_version: string, collections: map<string, struct<
    name: string, metadata: struct<winding_is_absolute: boolean>, color: array<double>,
    points: map<string, struct<p: array<double>, wind_a: double>>>>>"""


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _once(column: str, what: Column, where: Column) -> Column:
    """True if no two keys of a map are equal as numbers; an error otherwise."""
    numbers = F.transform(F.map_keys(column), lambda k: F.coalesce(k.try_cast("bigint").cast("string"), k))
    fine = F.coalesce(F.size(F.array_distinct(numbers)) == F.size(numbers), F.lit(True))
    return F.when(fine, True).otherwise(F.raise_error(F.concat(what, where)).cast("boolean"))


def flatten(documents: DataFrame, strict: bool = True) -> DataFrame:
    """source, cid, pid, x, y, z, wind_a, name, is_absolute from documents (source, value).

    strict: a wrong version, coordinates that aren't three finite numbers, an annotation that
    isn't finite, or ids that are equal as numbers fail the job. Otherwise such documents,
    points or annotations are left out. NaN annotations become null either way."""
    d = documents.select("source", F.from_json("value", SCHEMA).alias("d"))
    version = F.col("d.vc_pointcollections_json_version")
    if strict:
        d = d.where(F.when(version.eqNullSafe(VERSION), True).otherwise(F.raise_error(F.concat(F.lit("unsupported version in "), "source")).cast("boolean")))
    else:
        d = d.where(version == VERSION)
    if strict:
        d = d.where(_once("d.collections", F.lit("duplicate collection id in "), F.col("source")))
    c = d.select("source", F.explode("d.collections").alias("cid", "c"))
    if strict:
        c = c.where(_once("c.points", F.lit("duplicate point id in "), F.concat_ws(" ", "source", "cid")))
    p = c.select("source", F.expr("try_cast(cid as bigint)").alias("cid"), "c.name", F.coalesce("c.metadata.winding_is_absolute", F.lit(False)).alias("is_absolute"), F.explode("c.points").alias("pid", "q"))
    xyz = (F.size("q.p") == 3) & _finite(F.get("q.p", 0)) & _finite(F.get("q.p", 1)) & _finite(F.get("q.p", 2))
    wind = F.col("q.wind_a")
    p = p.withColumn("pid", F.expr("try_cast(pid as bigint)"))
    good = xyz & F.col("cid").isNotNull() & F.col("pid").isNotNull()
    if strict:
        good &= wind.isNull() | _finite(wind)
        p = p.where(F.when(good, True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("invalid point in"), "source", "cid", "pid")).cast("boolean")))
    else:
        p = p.where(good)
    out = p.select("source", "cid", "pid", F.get("q.p", 0).alias("x"), F.get("q.p", 1).alias("y"), F.get("q.p", 2).alias("z"), F.when(_finite(wind), wind).alias("wind_a"), "name", "is_absolute")
    return out


def duplicate_ids(points: DataFrame) -> DataFrame:
    """Ids that occur more than once after reading as numbers ("1" and "01")."""
    return points.groupBy("source", "cid", "pid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_collections(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Points of the documents under path, one file each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return flatten(files, strict)


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of an axis document's control points, at least two."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "struct<control_points: array<struct<x: double, y: double, z: double>>>")["control_points"]).alias("c")).select("c.*")
    if rows.count() < 2:
        raise ValueError("an axis needs two control points")
    return rows


def to_documents(points: DataFrame) -> DataFrame:
    """source, value: the points as documents again, ids in order, absent annotations left out."""
    q = F.struct(F.array("x", "y", "z").alias("p"), F.col("wind_a"))
    c = points.groupBy("source", "cid").agg(
        F.first("name").alias("name"),
        F.struct(F.max("is_absolute").alias("winding_is_absolute")).alias("metadata"),
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("pid", q.alias("q")))), lambda e: F.struct(e["pid"].cast("string").alias("k"), e["q"].alias("v")))).alias("points"),
    )
    body = F.map_from_entries(F.collect_list(F.struct(F.col("cid").cast("string").alias("k"), F.struct("name", "metadata", "points").alias("v"))))
    return c.groupBy("source").agg(body.alias("collections")).select("source", F.to_json(F.struct(F.lit(VERSION).alias("vc_pointcollections_json_version"), "collections")).alias("value"))


def write_collections(points: DataFrame, path: str) -> None:
    """One text file per source, in the folder of its name."""
    to_documents(points).write.partitionBy("source").text(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path (last part), length and SHA-256 of files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, state of files against a manifest (name, sha256): ok, changed, missing or undeclared."""
    m = manifest.select("name", F.col("sha256").alias("want"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "undeclared").when(F.col("sha256") == F.col("want"), "ok").otherwise("changed")
    return digests.join(m, "name", "full").select("name", state.alias("state"))


def manifest_rows(text: str) -> list[tuple[str, str]]:
    """(name, sha256) of the lines of a checksum file."""
    pairs = (line.split(None, 1) for line in text.splitlines() if line.strip())
    return [(PurePosixPath(name.strip().lstrip("*")).name, digest) for digest, name in pairs]


def report(values: dict) -> str:
    """A report document with its keys in order."""
    return json.dumps(values, sort_keys=True, indent=1)
