"""SimHash near-dedup: fingerprints, and a self-join of the binary trie that holds them.

The join walks pairs of trie nodes together, level by level: a pair carries the number of
bits in which its two prefixes differ, and goes no further once that exceeds the error budget.
Three differing bits leave one at most in one half of the fingerprint, so two tries are
walked, one of the fingerprints and one of them with their halves exchanged, and in
each the first half has a budget of one bit. That keeps the pairs of a level near
(nodes x depth) where a single trie with the whole budget has (nodes x depth ** 3).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, discard, few, map_texts, stored, text_or_empty
from .components import components

BITS, SHINGLE, SEED, MOST = 64, 3, 42, 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """64-bit hashes of the word shingles, in their order; a text with fewer words is one shingle, one without words none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(width, len(words))
    begins = np.concatenate(([0], ends[: len(words) - width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(begins, ends[width - 1 :].tolist())], dtype="<u8")


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed integer; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, as a signed integer; 0 without words."""
    return folded(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `fp` in place of the text; copies of a fingerprint aren't merged."""

    def make():
        return lambda texts: {"fp": [fingerprint(t) for t in texts]}

    return map_texts(docs, text_col, make, "fp long", as_bytes=True)


def _level(tries: DataFrame, depth: int) -> DataFrame:
    """Nodes of a level: (trie, node, leaves, leaf); a node with one leaf stands for its whole path."""
    prefix = F.shiftrightunsigned("key", BITS - depth) if depth < BITS else F.col("key")
    return tries.groupBy("trie", prefix.alias("node")).agg(F.count("*").alias("leaves"), F.min("key").alias("leaf"))


def trie_links(keys: DataFrame, most: int = MOST, step: int = 8, files: int | None = None) -> DataFrame:
    """Pairs (a, b) of different keys that differ in at most `most` bits; keys: one column `key` of distinct 64-bit numbers.

    A level takes `step` bits. A pair of nodes is joined to the children of the one, and each child to those
    of the other that an error mask within the room left gives, both by equality. A pair
    of nodes with one leaf each is compared at once and leaves the walk; it ends when no pair is left. files: see stored.
    """
    half, first, levels = BITS // 2, most // 2, []
    swapped = F.shiftleft("key", half).bitwiseOR(F.shiftrightunsigned("key", half))
    tries = stored(keys.select(F.lit(0).alias("trie"), "key").unionByName(keys.select(F.lit(1).alias("trie"), swapped.alias("key"))), "tries", files)
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= k]) for k in range(most + 1)])
    pairs, links = None, []
    for depth in range(step, BITS + 1, step):
        level = _level(tries, depth)
        child = level.select("trie", F.col("node").alias("a"), F.shiftrightunsigned("node", step).alias("up_a") if depth > step else F.lit(0).cast("long").alias("up_a"), F.col("leaves").alias("leaves_a"), F.col("leaf").alias("leaf_a"))
        grown = child.withColumns({"up_b": F.lit(0).cast("long"), "errors": F.lit(0)}) if pairs is None else pairs.join(child, ["trie", "up_a"])
        room = F.lit(first if depth <= half else most) - F.col("errors")
        grown = grown.where(room >= 0).select("*", F.explode(F.element_at(masks, room + 1)).alias("mask"))
        low = F.col("a").bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("mask"))
        grown = grown.select("trie", "a", "leaves_a", "leaf_a", F.shiftleft("up_b", step).bitwiseOR(low).alias("b"), (F.col("errors") + F.bit_count("mask")).alias("errors"), (F.col("up_a") == F.col("up_b")).alias("same")).where("not same or a <= b").drop("same")
        other = level.select("trie", F.col("node").alias("b"), F.col("leaves").alias("leaves_b"), F.col("leaf").alias("leaf_b"))
        apart = F.bit_count(F.col("leaf_a").bitwiseXOR(F.col("leaf_b")))
        alone = (F.col("leaves_a") == 1) & (F.col("leaves_b") == 1)
        met = stored(grown.join(other, ["trie", "b"]).where(~alone | (F.col("leaf_a") != F.col("leaf_b")) & (apart <= most)).withColumn("done", alone), f"level{depth}", files)
        levels.append(met)
        links.append(met.where("done").select("trie", "leaf_a", "leaf_b"))
        pairs = met.where("not done").select("trie", F.col("a").alias("up_a"), F.col("b").alias("up_b"), "errors")
        if pairs.isEmpty():
            break
    found = links[0]
    for x in links[1:]:
        found = found.unionByName(x)
    back = lambda c: F.when(F.col("trie") == 0, F.col(c)).otherwise(F.shiftleft(c, half).bitwiseOR(F.shiftrightunsigned(c, half)))
    a, b = back("leaf_a"), back("leaf_b")
    found = stored(found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "trie-links", files)
    discard(tries, *levels)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, links (of its fingerprint to others).

    component_id is the smallest id that links reach, itself included. A null text
    or one without words has fingerprint zero, which links like any other. Rows that repeat an id or a text share a
    fingerprint; they count as one class, and only classes are linked. Null ids are ignored
    as representatives. Other columns are ignored. No rows give no rows.
    """
    rows = columns(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("body"))
    rows = stored(fingerprints(rows, "body"), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    links = trie_links(classes.select(F.col("fp").alias("key")), most)
    member = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    linked = classes.join(member.withColumnRenamed("node", "fp"), "fp").join(degree, "fp")
    roots = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(roots, "root").select("fp", F.col("component_id").alias("linked_id"), "links")
    classes = classes.join(linked, "fp", "left").select("fp", F.when(F.col("links").isNull(), F.col("first")).otherwise(F.col("linked_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    # Both sides come from tables, so that a fingerprint which many rows have is split over tasks.
    return rows.join(stored(classes, "classes"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row of each group that links connect: that of the smallest id, and of rows that share it that of the smallest fingerprint.

    A row goes only if its own fingerprint is in a group with a row that stays, so rows that repeat an id with texts of
    two groups can both stay; of rows that repeat id and fingerprint one stays. Null ids all stay. Null, empty and
    long texts are treated as near_duplicates does; no rows give no rows.
    """
    key = F.col(f"`{id_col}`")
    named = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (named[docs.columns.index(n)] for n in (id_col, text_col))
    rows = stored(map_texts(docs.where(key.isNotNull()).toDF(*named).withColumn("body", text_or_empty(text_at)), "body", lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]}, "fp long", as_bytes=True), "fingerprinted")
    member = components(trie_links(rows.select(F.col("fp").alias("key")).distinct(), most)).withColumnRenamed("node", "fp")
    held = rows.select(F.col(id_at).alias("id"), "fp").distinct().join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = stored(held.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("k")).select(F.col("k.id").alias(id_at), F.col("k.fp").alias("fp")), "kept")
    stays = rows.join(few(kept), [id_at, "fp"], "left_semi").dropDuplicates([id_at, "fp"]).select(*named)
    return stays.toDF(*docs.columns).unionByName(docs.where(key.isNull()))
