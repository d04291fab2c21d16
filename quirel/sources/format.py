"""Spark's data source "pdf": spark.read.format("pdf"), readStream and write, with filters and columns pushed into the parser.

A row is an object: path, doc_id, obj_num, gen, type, json, data, error. Filters on path, obj_num and type are decided
before files are opened or objects parsed, and a schema without `data` (see `read`) decodes no stream. Paths are those that pyarrow's file systems reach (local and mounted folders, HDFS, S3, GCS);
for others there is read_pdf, which reads through Spark.
"""

from __future__ import annotations

import fnmatch
import operator
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .objects import object_rows, object_type

SCHEMA = "path string, doc_id long, obj_num long, gen int, type string, json string, data binary, error string"
#: Bytes of files that a partition reads, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 64 << 20, 1 << 20
#: Rows of an Arrow batch.
ROWS = 2000

_COMPARED = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


def _system(path: str):
    """(file system, its path) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, pattern: str = "*.pdf", recursive: bool = True) -> list[tuple[str, int, int]]:
    """(path as Spark writes it, size, time of change in nanoseconds) of a file, or of those below a folder whose names fit, in order of paths."""
    from pyarrow import fs

    system, root = _system(path)
    prefix = "file:" if isinstance(system, fs.LocalFileSystem) else path[: path.index("://") + 3]
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(root, recursive=recursive)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    return sorted((prefix + i.path, i.size, i.mtime_ns or 0) for i in found)


def packed(files: Iterable[tuple[str, int]], limit: int) -> list[list[str]]:
    """Paths in groups of at most `limit` bytes (a larger file is a group of its own), each file counted with OPEN_BYTES, the largest first."""
    groups: list[list[str]] = []
    held = limit + 1
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if held + size + OPEN_BYTES > limit:
            groups.append([])
            held = 0
        groups[-1].append(path)
        held += size + OPEN_BYTES
    return groups


class _Test:
    """A pushed filter on one column."""

    def __init__(self, f: Filter):
        self.column = f.attribute[0]
        self.value = f.value
        self.compare: Callable = (lambda a, b: a in b) if isinstance(f, In) else _COMPARED[type(f)]

    def __call__(self, value) -> bool:
        return value is not None and self.compare(value, self.value)


def _doc_id(path: str) -> int:
    """Spark's xxhash64 of a path."""
    import xxhash

    n = xxhash.xxh64_intdigest(path.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


class _Rows:
    """Reads partitions of paths as Arrow batches of the asked columns."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.tests = schema, {k.lower(): v for k, v in options.items()}, []

    def _limit(self) -> int:
        return int(self.options.get("maxpartitionbytes", PARTITION_BYTES))

    def _files(self) -> list[tuple[str, int, int]]:
        return listed(self.options["path"], self.options.get("pathglobfilter", "*.pdf"), self.options.get("recursivefilelookup", "true").lower() == "true")

    def _split(self, files: list[tuple[str, int, int]]) -> list[InputPartition]:
        tests = [t for t in self.tests if t.column == "path"]
        return [InputPartition(g) for g in packed([(p, n) for p, n, _ in files if all(t(p) for t in tests)], self._limit())] or [InputPartition([])]

    def _objects(self, path: str) -> Iterator[dict]:
        names = set(self.schema.names)
        system, at = _system(path)
        with system.open_input_stream(at) as f:
            data = f.read()
        numbers = [t for t in self.tests if t.column == "obj_num"]
        kinds = [set(t.value) if isinstance(t.value, (tuple, list)) else {t.value} for t in self.tests if t.column == "type"]
        types = set.intersection(*kinds) if kinds else None
        head = {"path": path, "doc_id": _doc_id(path)}
        for number, text, body, error, gen in object_rows(data, (lambda n: all(t(n) for t in numbers)) if numbers else None, types, "data" in names):
            # A file that can't be read has no number and no type, so no filter on these lets it through.
            if (numbers or kinds) and number is None:
                continue
            kind = object_type(_parsed(text)) if text and "type" in names else None
            yield {**head, "obj_num": number, "gen": gen, "type": kind, "json": text, "data": body, "error": error}

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        rows: list[dict] = []
        size = 0
        for path in partition.value:
            for row in self._objects(path):
                rows.append(row)
                size += len(row.get("data") or b"") + len(row.get("json") or "")
                if len(rows) >= ROWS or size > PARTITION_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def _parsed(text: str):
    import json

    return json.loads(text)


class PdfReader(_Rows, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self._split(self._files())


class PrunedReader(PdfReader):
    """Also takes filters; those that it can't decide go back to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            equality = isinstance(f, (EqualTo, In))
            if column == "path" and (equality or type(f) in _COMPARED) or column == "obj_num" and (equality or type(f) in (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or column == "type" and equality:
                self.tests.append(_Test(f))
            else:
                yield f


class PdfStream(_Rows, DataSourceStreamReader):
    """Files by time of change and path: a batch takes those behind the last one's, at most maxFilesPerTrigger if that is given (a run of
    availableNow is one batch). Files must be moved into place whole, with a new time."""

    def __init__(self, schema: StructType, options: dict):
        super().__init__(schema, options)
        self.last = None

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[tuple[str, int, int]]:
        found = sorted(self._files(), key=lambda f: (f[2], f[0]))
        return [f for f in found if (start["time"], start["path"]) < (f[2], f[0]) and (end is None or (f[2], f[0]) <= (end["time"], end["path"]))]

    def latestOffset(self) -> dict:
        new = self._between(self.last or self.initialOffset(), None)
        new = new[: int(self.options.get("maxfilespertrigger", len(new)))]
        if new:
            self.last = {"time": new[-1][2], "path": new[-1][0]}
        return self.last or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last or end, end, key=lambda o: (o["time"], o["path"]))
        return self._split(self._between(start, end))

    def commit(self, end: dict) -> None:
        pass


class PdfWriter(DataSourceWriter):
    """Rows (doc_id, content) become files doc_id.pdf. A file is written beside its place and moved there, so a task that runs twice leaves it whole."""

    def __init__(self, schema: StructType, options: dict):
        if not {"doc_id", "content"} <= set(schema.names):
            raise ValueError("rows to write as files have the columns doc_id and content")
        self.path = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        for r in rows:
            path, part = f"{root}/{r.doc_id}.pdf", f"{root}/_{r.doc_id}-{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(bytes(r.content or b""))
            system.move(part, path)
        return WriterCommitMessage()


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PrunedReader if self.options.get("pushdown", "true").lower() == "true" else PdfReader)(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PdfStream(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PdfWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)


def read(spark: SparkSession, path: str, *columns: str, **options) -> DataFrame:
    """The objects below path with the named columns only (all, without names): what isn't named is neither decoded nor sent."""
    register(spark)
    known = {c.split()[0]: c for c in SCHEMA.split(", ")}
    return spark.read.format("pdf").schema(", ".join(known[c] for c in columns or known)).options(**options).load(path)


def as_objects(rows: DataFrame) -> DataFrame:
    """Rows of the format as the table that the operators work on."""
    return rows.select("doc_id", "obj_num", F.parse_json("json").alias("value"), "data", "error", "gen")
