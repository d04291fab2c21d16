"""Filter interaction audit: what each filter of a chain removes under every order, from signed parity sums.

A document's failing filters are a mask of five bits. A part's counts of masks are found through their
Walsh-Hadamard transform: 32 sums over its documents, each with the sign of a parity of the mask. The
transform is inverted exactly, and all orders and the Shapley values are functions of the 32 counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, columns, few, stored, text_or_empty
from .mixing import WORD

#: The filters by letter; a filter's bit in a mask is its place here.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(body: Column) -> Column:
    """The mask of the filters A to D, which look at one text alone."""
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    tests = (
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * (F.length(body) - F.length(F.translate(body, _CAPITALS, ""))) > 3 * F.length(body),
        body.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for bit, fails in enumerate(tests):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask


def _with_copies(rows: DataFrame) -> DataFrame:
    """rows (id, mask, digest, ...) with the bit of E where a smaller id has the same text.

    Texts with copies are few or many. Up to BROADCAST_ROWS of them are broadcast; else only those that have more than a
    BROADCAST_ROWS-th of all rows each, of which there can't be more, and the others meet their rows by a shuffle
    in which no key is large.
    """
    groups = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("last"), F.count("*").alias("n")).where("last > least").drop("last")
    groups = stored(groups, "copied-texts")

    def marked(part: DataFrame, side: DataFrame) -> DataFrame:
        return part.join(side.select("digest", "least"), "digest", "left")

    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = marked(rows, F.broadcast(groups))
    else:
        large = groups["n"] > rows.count() // BROADCAST_ROWS
        hot = F.broadcast(groups.where(large))
        found = rows.join(hot.select("digest", "least"), "digest").unionByName(marked(rows.join(hot, "digest", "left_anti"), groups.where(~large)))
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return found.withColumn("mask", F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).drop("digest", "least")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of each row of docs; texts are scanned once, and what is kept of one is its digest."""
    rows = columns(docs, id_col, text_col, part_col).toDF("id", "text", "part")
    body = text_or_empty("text")
    rows = rows.select("id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), own_failures(body).alias("mask"), F.unhex(F.sha2(body, 256)).alias("digest"))
    return _with_copies(stored(rows, "failures"))


def parity_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(*keys, sums): for each k under 32 the sum over rows of the sign of the parity of mask & k; one row per key leaves a task."""
    sign = lambda k: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(k))) % 2)
    sums = rows.groupBy(*keys).agg(*[F.sum(sign(k)).cast("long").alias(f"s{k}") for k in range(MASKS)])
    return sums.select(*keys, F.array(*[f"s{k}" for k in range(MASKS)]).alias("sums"))


def cells(sums: Column) -> Column:
    """Counts of the masks from their 32 parity sums; the division leaves no rest."""
    signed = lambda m: F.aggregate(
        F.transform(sums, lambda s, k: F.when(F.bit_count(k.bitwiseAND(m)) % 2 == 0, s).otherwise(-s)), F.lit(0).cast("long"), lambda total, s: total + s
    )
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(signed(m), len(FILTERS)))


def _total(counts: str, term) -> Column:
    """Sum over masks of term(count, mask)."""
    return F.aggregate(F.transform(counts, term), F.lit(0).cast("long"), lambda total, x: total + x)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text counts as empty, a null part is the part "". Very long texts are read whole. A null id is
    no copy of others nor they of it; rows that repeat an id are counted each, and aren't copies of each other. A document
    is good or toxic if any row of labels says so; labels of unknown ids and null labels have no effect. Other columns of both tables are ignored,
    whatever their names. No rows give no rows.
    """
    known = columns(labels, id_col, "quality", "toxic").toDF("of", "quality", "toxic").where("quality = 1 or toxic = 1")
    known = known.groupBy("of").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failure_masks(docs, id_col, text_col, part_col)
    rows = rows.join(few(known), F.col("id") == F.col("of"), "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    found = parity_sums(rows, "part", "good", "toxic").select("part", "good", "toxic", cells(F.col("sums")).alias("counts"))
    held = lambda which: [F.sum(F.when(which, F.col("counts")[m]).otherwise(0)) for m in range(MASKS)]
    parts = found.groupBy("part").agg(F.array(*held(F.lit(True))).alias("every"), F.array(*held(F.col("good"))).alias("good"), F.array(*held(F.col("toxic"))).alias("toxic"))

    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, _ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before, letter = F.expr("substring(filter_order, 1, step - 1)"), F.expr("substring(filter_order, step, 1)")
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"earlier": bits(before), "own": bits(letter)})
    fails = lambda m, of: m.bitwiseAND(F.col(of)) != 0
    here = lambda n, m: F.when(fails(m, "own") & ~fails(m, "earlier"), n).otherwise(0)
    return steps.select(
        "part",
        "filter_order",
        "step",
        _total("every", lambda n, m: F.when(~fails(m, "own") & ~fails(m, "earlier"), n).otherwise(0)).alias("kept"),
        _total("every", here).alias("removed"),
        _total("every", lambda n, m: F.when(fails(m, "own") & fails(m, "earlier"), n).otherwise(0)).alias("redundant"),
        _total("every", lambda n, m: F.when(m == F.col("own"), n).otherwise(0)).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        # The filter is the first of those that fail in a 1 / failures of the 120 orders.
        _total("every", lambda n, m: F.when(fails(m, "own"), n * F.element_at(F.array(*[F.lit(len(_ORDERS) // i) for i in range(1, 6)]), F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0)).alias("shapley"),
    )
