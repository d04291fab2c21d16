"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, few, stored

#: Amounts by which a source's draws can be turned.
TURNS = 64
#: What separates words: the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) of rows (source, size): tokens are aggregated per source first.

    Sources by code point, null last, weigh as listed, repeating. A target stops at `most`
    times its source's size; the excess is reshared by weight until none is above. That
    ends where the sources in order of size per weight are cut once: a prefix is full, the others share
    the rest by weight. Windows here run over one small row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    cut = (
        totals.withColumn("weight", weight)
        .withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("full", F.lit(most) * F.col("source_size") * F.col("weights") <= F.col("left") * F.col("weight"))
        .withColumn("from", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "left", "weights"))).over(everything))
    )
    own = F.col("from.left") * F.col("weight") / F.col("from.weights")
    target = F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(F.least(own, F.lit(most) * F.col("source_size")))
    return cut.select("source", "source_size", target.cast("double").alias("target"))


def _drawn(id_col):
    """A number from 0 to under TURNS: a hash of the id, equal on every run and cluster."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0 / TURNS)


def _copies(draw):
    """floor(rate) plus one Bernoulli copy, taken where the draw, turned by the source's turn, is below the rate's fraction."""
    place = (F.floor(draw) + F.col("turn")) % TURNS
    taken = (place < F.col("full")) | ((place == F.col("full")) & (draw - F.floor(draw) < F.col("part")))
    return (F.floor("rate") + F.when(taken, 1).otherwise(0)).cast("long")


def source_rates(sizes: DataFrame, **targets) -> DataFrame:
    """(source, source_size, target, rate, full, part, turn) of rows (source, size, draw).

    full + part is the rate's fraction in units of 1 / TURNS. Independent draws of few documents miss the target by chance, so each
    source's draws are all turned by the same amount, the one of TURNS that brings its words nearest to the target
    (the smallest such). The turn is chosen from the draws themselves, so a document's chance of a further copy is
    near the fraction, not exactly it; with few documents in a source it may be decided. Words are summed by source and unit of the draw first.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = (F.col("rate") - F.floor("rate")) * TURNS
    plan = source_targets(sizes, **targets).withColumn("rate", rate).withColumn("full", F.floor(fraction)).withColumn("part", fraction - F.col("full"))
    plan = stored(plan, "targets")
    rows = sizes.withColumnRenamed("source", "of").join(few(plan), F.col("of").eqNullSafe(F.col("source")))
    draw = F.col("draw")
    units = rows.groupBy("source", F.floor(draw).alias("unit")).agg(F.sum("size").alias("whole"), F.sum(F.when(draw - F.floor(draw) < F.col("part"), F.col("size")).otherwise(0)).alias("below"))
    units = units.groupBy("source").agg(F.collect_list(F.struct("unit", "whole", "below")).alias("units")).withColumnRenamed("source", "of")
    joined = plan.join(few(stored(units, "units")), F.col("of").eqNullSafe(F.col("source")), "left")

    def missed(turn):
        place = lambda u: (u["unit"] + turn) % TURNS
        taken = F.aggregate("units", F.lit(0).cast("long"), lambda total, u: total + F.when(place(u) < F.col("full"), u["whole"]).when(place(u) == F.col("full"), u["below"]).otherwise(0))
        return F.struct(F.abs(taken - (F.col("target") - F.floor("rate") * F.col("source_size"))).alias("missed"), turn.alias("turn"))

    turn = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TURNS - 1)), missed))["turn"]
    return joined.select("source", "source_size", "target", "rate", "full", "part", turn.alias("turn"))


def _planned(rows: DataFrame, plan: DataFrame, id_at: str, source_at: str) -> DataFrame:
    plan = few(stored(plan.withColumnRenamed("source", "plan_source"), "plan"))
    joined = rows.join(plan, F.col(source_at).eqNullSafe(F.col("plan_source")), "left")
    return joined.withColumn("copies", _copies(F.col("draw") if id_at == "draw" else _drawn(F.col(id_at))))


def _sizes(docs: DataFrame, id_at: str, source_at: str, text_at: str) -> DataFrame:
    """(id, source, size, draw), written once: all that the plan needs of a text is its number of words."""
    return stored(docs.select(F.col(id_at).alias("id"), F.col(source_at).alias("source"), word_count(F.col(text_at)).alias("size"), _drawn(F.col(id_at)).alias("draw")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken.

    Null text has size 0, very long ones are counted whole, a null source is a source of its own, rows that repeat an id
    and a source get the same draw. Sources without words have target 0. Sources of equal size per weight are
    filled by code point. Other columns are ignored, whatever their names. No rows give no rows.
    """
    sizes = _sizes(columns(docs, id_col, source_col, text_col).toDF("c0", "c1", "c2"), "c0", "c1", "c2")
    planned = _planned(sizes, source_rates(sizes, **targets), "draw", "source")
    return planned.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **targets) -> DataFrame:
    """The mix itself: docs with each row emitted as many times as mix() takes it; the columns are those of docs."""
    named = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: named[docs.columns.index(n)] for n in (id_col, source_col, text_col)}
    rows = docs.toDF(*named)
    sizes = _sizes(rows, at[id_col], at[source_col], at[text_col])
    planned = _planned(rows, source_rates(sizes, **targets), at[id_col], at[source_col])
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*named).toDF(*docs.columns)
