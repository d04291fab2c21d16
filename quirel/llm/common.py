"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Side tables are broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 200_000
#: Rows that a task holds as Python objects at a time, and characters after which it stops adding rows.
CHUNK_ROWS, CHUNK_CHARS = 64, 500_000
#: Rows of an Arrow batch.
BATCH_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir; a temporary one only where that is unset and the driver runs all tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="quirel-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, and lost executors cost no recomputation.

    files: its rows are dealt to so many files, however many tasks make them. Each file costs a store some calls, and Hadoop's local file system
    some processes, which until they run a program of their own are counted with all of the executor's memory.
    """
    spark = df.sparkSession
    df = df.repartition(files) if files else df
    path = shared_dir(spark, what)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() has written, once nothing that is still to be computed reads them."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast where they are at most BROADCAST_ROWS, so that what they are joined to stays where it is."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that no other column's name can clash with a result's."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded rows and characters (a single longer row is a slice of its own)."""
    values = batch.column(column)
    sizes = (pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)).to_pylist()
    begin = held = 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= CHUNK_ROWS or held + (n or 0) > CHUNK_CHARS):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_texts(df: DataFrame, column: str, make: Callable[[], Callable[[list], dict]], added: str, drop: bool = True, as_bytes: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns `added` (a DDL string) that Python makes of `column`, in Arrow batches without a shuffle.

    make() runs once a task and returns a function from a list of values to a dict of lists;
    the function also gets the lists of the columns `also`. df must have no column named as an added one.
    With drop, `column` and `also` aren't returned. Where the session has Spark's own number of rows in an Arrow batch, it is
    set to BATCH_ROWS: ten thousand texts and what is made of them would be held at once.
    """
    if df.sparkSession.conf.get(_BATCH) == "10000":
        df.sparkSession.conf.set(_BATCH, BATCH_ROWS)
    new = _parse_datatype_string(added)
    kept = [f for f in df.schema.fields if not (drop and f.name in (column, *also))]
    schema = StructType([*kept, *new.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            for part in chunks(batch, column):
                values = part.column(column)
                made = apply((values.cast(pa.binary()) if as_bytes else values).to_pylist(), *[part.column(n).to_pylist() for n in also])
                arrays = [part.column(n).cast(arrow.field(n).type) for n in names]
                arrays += [pa.array(made[f.name], type=arrow.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        # The worker lives on for other tasks; what this one needed goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
