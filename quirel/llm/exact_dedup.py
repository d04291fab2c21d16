"""Exact dedup by a log-structured merge index of text digests.

Each task's digests are a memtable; it is flushed as a run: a Parquet file sorted
by digest with a Bloom filter on it, in the shared folder. Compaction merges
the runs into one row per digest with its count and the smallest (or largest)
identifier. Only texts whose digest occurs more than once are compared, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, columns, shared_dir, stored, text_or_empty


class DigestIndex:
    """Runs of (digest, n, id) below one folder; ids are the smallest or largest of a digest."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.path, self.best = spark, path or shared_dir(spark, "digests"), F.min if keep == "smallest" else F.max
        self.runs: list[str] = []
        self.schema = None

    def _write(self, rows: DataFrame) -> None:
        self.schema = self.schema or rows.schema
        run = f"{self.path}/run-{len(self.runs):05d}-{shared_dir(self.spark, '').rpartition('-')[2][:8]}"
        (
            rows.sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(run)
        )
        self.runs.append(run)

    def flush(self, digests: DataFrame) -> None:
        """Adds rows (digest, id): one sorted file per task, nothing is shuffled."""
        self._write(digests.select("digest", F.lit(1).cast("long").alias("n"), "id"))

    def entries(self) -> DataFrame:
        """One row per digest over all runs."""
        return self.spark.read.schema(self.schema).parquet(*self.runs).groupBy("digest").agg(F.sum("n").alias("n"), self.best("id").alias("id"))

    def compact(self) -> None:
        """Merges all runs into one, which keeps the best identifier of each digest."""
        merged, old = self.entries(), len(self.runs)
        self._write(merged)
        self.runs = self.runs[old:]

    def lookup(self, digests: list[int]) -> DataFrame:
        """Entries of a few digests; files without them are skipped by their filters and bounds."""
        return self.entries().where(F.col("digest").isin(digests))

    def repeated(self) -> DataFrame:
        """Digests that occur more than once."""
        return self.entries().where("n > 1").select("digest")


def _hits(index: DigestIndex, rows: DataFrame, how: str) -> DataFrame:
    """rows whose digest repeats (left_semi) or doesn't (left_anti); the digests are broadcast only if few."""
    hits = index.repeated()
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(hits) if few else hits, "digest", how)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, text_sha256, keep_id, group_size, kept.

    Null text counts as empty. Rows that repeat an id and its text are counted
    in group_size, and one of them is kept. Null ids lose to others;
    a group of null ids alone keeps one row with a null keep_id. Other columns
    are ignored whatever their names. No rows give no rows.
    """
    best = F.min if keep == "smallest" else F.max
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))
    rows = rows.withColumn("digest", F.xxhash64("body"))
    index = DigestIndex(docs.sparkSession, keep=keep)
    index.flush(rows.select("digest", "id"))
    index.compact()

    single = _hits(index, rows, "left_anti").select("id", F.sha2("body", 256).alias("text_sha256"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # Byte verification: hits are grouped by their texts, copies of a task are merged before the shuffle. The groups
    # are a table of their own, so that the rows of a text with many copies are split over tasks when they meet it.
    hits = _hits(index, rows, "left_semi").select("digest", "body", "id")
    groups = stored(hits.groupBy("digest", "body").agg(best("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    found = hits.join(groups, ["digest", "body"]).select("id", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    heads = F.col("id").eqNullSafe(F.col("keep_id"))
    turn = F.row_number().over(Window.partitionBy("text_sha256").orderBy("id"))
    columns_ = ("id", "text_sha256", "keep_id", "group_size")
    found = found.where(~heads).select(*columns_, F.lit(False).alias("kept")).unionByName(found.where(heads).select(*columns_, (turn == 1).alias("kept")))
    return single.unionByName(found).withColumnRenamed("id", id_col)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows whose text another row keeps; see exact_duplicates for ties and nulls.

    Texts of which there is one pass through unshuffled; only the others are joined to their group's kept id.
    """
    best = F.min_by if keep == "smallest" else F.max_by
    named = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = docs.toDF(*named).withColumn("digest", F.xxhash64(text_or_empty(named[at[1]])))
    index = DigestIndex(docs.sparkSession, keep=keep)
    index.flush(rows.select("digest", F.col(named[at[0]]).alias("id")))
    index.compact()
    single = _hits(index, rows, "left_anti").select(*named)
    rest = [n for i, n in enumerate(named) if i != at[1]]
    # Null ids come last in either order; of equal ids the remaining columns decide.
    order = F.struct(F.col(named[at[0]]).isNull() if keep == "smallest" else F.col(named[at[0]]).isNotNull(), named[at[0]], *[F.xxhash64(*rest)])
    kept = _hits(index, rows, "left_semi").groupBy("digest", text_or_empty(named[at[1]]).alias("body")).agg(best(F.struct(*named), order).alias("row")).select("row.*")
    return single.unionByName(kept).toDF(*docs.columns)
