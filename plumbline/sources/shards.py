"""Point-collection documents as a partitioned source and sink: `spark.read.format("collections")`.

Documents are read some to a partition, by their sizes. When written, tasks stream points into documents of a
bounded number of points and nothing shows before the job commits, so lost or repeated tasks
leave neither holes nor copies. A collection is never split: one that is larger than the bound
has a document of its own, written point by point, and is read in one task.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from plumbline.sources.collections import VERSION

SCHEMA = "source string, cid bigint, pid bigint, x double, y double, z double, wind_a double, name string, is_absolute boolean"
_ARROW = pa.schema([("source", pa.string()), ("cid", pa.int64()), ("pid", pa.int64()), *[(c, pa.float64()) for c in ("x", "y", "z", "wind_a")], ("name", pa.string()), ("is_absolute", pa.bool_())])
_BATCH = 8192
#: Points of a document, unless option pointsPerDocument says otherwise.
POINTS_PER_DOCUMENT = 1_000_000
#: Bytes of a partition's documents, each counted as OPEN_COST more; a larger document is alone.
PARTITION_BYTES = 32 << 20
OPEN_COST = 64 << 10


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _number(key: str, strict: bool, where: str) -> int | None:
    try:
        n = int(key)
        if -(1 << 63) <= n < 1 << 63:
            return n
    except ValueError:
        pass
    if strict:
        raise ValueError(f"{key!r} is no id in {where}")
    return None


def _entries(pairs: list | None, strict: bool, what: str, where: str) -> Iterator[tuple[int, object]]:
    """Entries by number. Ids equal as numbers are refused if strict, else the first one stays."""
    seen: set[int] = set()
    for key, value in pairs or []:
        n = _number(key, strict, where)
        if n in seen and strict:
            raise ValueError(f"duplicate {what} id {n} in {where}")
        if n is not None and n not in seen:
            seen.add(n)
            yield n, value


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def points_of(text: str, source: str, strict: bool = True) -> Iterator[tuple]:
    """The rows of a document. strict: another version, ids that are no numbers or are equal as
    such, and coordinates or annotations that aren't finite raise; otherwise such documents
    and points are left out, and such annotations are null."""
    doc = dict(json.loads(text, object_pairs_hook=list))
    if doc.get("vc_pointcollections_json_version") != VERSION:
        if strict:
            raise ValueError(f"unsupported version in {source}")
        return
    for cid, pairs in _entries(doc.get("collections"), strict, "collection", source):
        body = dict(pairs or [])
        absolute = bool(dict(body.get("metadata") or []).get("winding_is_absolute"))
        for pid, q in _entries(body.get("points"), strict, "point", f"{source} {cid}"):
            point = dict(q or [])
            xyz, wind = point.get("p") or [], point.get("wind_a")
            good = len(xyz) == 3 and all(map(_finite, xyz))
            if strict and not (good and (wind is None or _finite(wind))):
                raise ValueError(f"invalid point in {source} {cid} {pid}")
            if good:
                yield (source, cid, pid, *map(float, xyz), float(wind) if _finite(wind) else None, body.get("name"), absolute)


@dataclass
class _Documents(InputPartition):
    """Paths with their sources."""

    held: list[tuple[str, str]]


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.strict = options.get("strict", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """The documents under path, but for those of jobs that haven't committed. The source is what
        a folder source=... on the way names, else the file's path."""
        files, root = _files(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[InputPartition] = []
        held, size = [], 0
        for f in sorted(found, key=lambda f: f.path):
            parts = f.path[len(root) :].strip("/").split("/")
            if f.is_file and f.path.endswith(".json") and not any(p.startswith(("_", ".")) for p in parts):
                named = [unquote(p[len("source=") :]) for p in parts if p.startswith("source=")]
                if held and size + f.size + OPEN_COST > PARTITION_BYTES:
                    out.append(_Documents(held))
                    held, size = [], 0
                held.append((f.path, named[0] if named else f.path))
                size += f.size + OPEN_COST
        return [*out, _Documents(held)] if held else out

    def read(self, partition: _Documents | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no documents
            return
        files = _files(self.path)[0]
        batch: list[tuple] = []
        for path, source in partition.held:
            with files.open_input_stream(path) as f:
                text = f.read().decode("utf-8")
            for row in points_of(text, source, self.strict):
                batch.append(row)
                if len(batch) == _BATCH:
                    yield _arrow(batch)
                    batch = []
        if batch:
            yield _arrow(batch)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class CollectionWriter(DataSourceWriter):
    """Rows of a task must come in order of source, cid and pid, and a collection's in one task, as
    write_sharded sees to."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.most = int(options.get("pointsPerDocument", POINTS_PER_DOCUMENT))
        self.job = uuid.uuid4().hex

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, root = _files(self.path)
        return files, root.rstrip("/"), f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator) -> _Written:
        files, root, hidden = self._places()
        at = {c: i for i, c in enumerate(self.columns)}
        files.create_dir(hidden, recursive=True)
        moves: list[tuple[str, str]] = []
        out, source, cid, pid, n = None, None, None, None, 0
        for row in iterator:
            s, c, p, name, absolute = (row[at[k]] for k in ("source", "cid", "pid", "name", "is_absolute"))
            xyz, wind = [row[at[k]] for k in ("x", "y", "z")], row[at["wind_a"]]
            if None in (s, c, p) or not all(map(_finite, xyz)) or not (wind is None or _finite(wind)):
                raise ValueError(f"no valid point: {s} {c} {p}")
            if (s, c, p) == (source, cid, pid):
                raise ValueError(f"duplicate point id {p} in {s} {c}")
            fresh = (s, c) != (source, cid)
            if out is not None and (s != source or (fresh and n >= self.most)):
                out.write(b"}}}}")
                out.close()
                out = None
            if out is None:
                file, n = f"{uuid.uuid4().hex}.json", 0
                moves.append((f"{hidden}/{file}", f"{root}/source={quote(s, safe='')}/{file}"))
                out = files.open_output_stream(moves[-1][0])
                out.write(('{"vc_pointcollections_json_version": %s, "collections": {' % json.dumps(VERSION)).encode())
            if fresh:
                head = {"name": name, "metadata": {"winding_is_absolute": bool(absolute)}}
                out.write((("}}, " if n else "") + json.dumps(str(c)) + ": " + json.dumps(head)[:-1] + ', "points": {').encode())
            point = {"p": xyz} if wind is None else {"p": xyz, "wind_a": wind}
            out.write((("" if fresh else ", ") + json.dumps(str(p)) + ": " + json.dumps(point)).encode())
            source, cid, pid, n = s, c, p, n + 1
        if out is not None:
            out.write(b"}}}}")
            out.close()
        return _Written(moves)

    def commit(self, messages) -> None:
        files, root, hidden = self._places()
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith("source=") and not f.is_file:
                    files.delete_dir(f.path)
        for m in messages:
            for here, there in m.moves if m else []:
                files.create_dir(there.rsplit("/", 1)[0], recursive=True)
                files.move(here, there)
        self._clear(files, hidden)
        files.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages) -> None:
        files, _, hidden = self._places()
        self._clear(files, hidden)

    def _clear(self, files: fs.FileSystem, hidden: str) -> None:
        """The job's own folder goes, with what attempts left that didn't count."""
        if files.get_file_info(hidden).type == fs.FileType.Directory:
            files.delete_dir(hidden)


class CollectionSource(DataSource):
    """Options: path; strict (true); pointsPerDocument."""

    @classmethod
    def name(cls) -> str:
        return "collections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        return CollectionReader(self.options)

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options, schema.names, overwrite)


def read_sharded(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The points of the documents under path, as flatten gives them. A bad document or point fails
    the job, or is left out if not strict. Ids are unique within a document;
    collections.duplicate_ids looks at all documents of a source."""
    spark.dataSource.register(CollectionSource)
    return spark.read.format("collections").option("strict", str(strict).lower()).load(path)


def write_sharded(points: DataFrame, path: str, points_per_document: int = POINTS_PER_DOCUMENT, mode: str = "append") -> None:
    """points (the columns of SCHEMA; others are left out) as documents in folders source=...; a
    document ends with the collection that reaches points_per_document. A point that occurs
    twice, or that has no id or no finite place, fails the job and nothing is written. mode:
    append or overwrite."""
    points.sparkSession.dataSource.register(CollectionSource)
    p = points.select(*_ARROW.names).repartition("source", "cid").sortWithinPartitions("source", "cid", "pid")
    p.write.format("collections").option("pointsPerDocument", points_per_document).mode(mode).save(path)
