"""Near-dedup by exact Jaccard similarity of word shingles, for the corpus pipeline.

Fingerprints only link the nearest copies early. What makes the result whole is a prefix join: in any
fixed order of all shingles, two sets of Jaccard similarity t or more share one of each other's first
n - ceil(t * n) + 1 shingles, so all pairs meet there. Rarest shingles go first, by frequencies over a fixed share of the
documents; those decide the cost, never the result. Every pair that meets is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, discard, few, map_texts, stored, text_or_empty
from .components import components
from .simhash import MOST, folded, shingle_hashes, trie_links

#: Words of a shingle, and the least similarity of a link in fifths.
WIDTH, FIFTHS = 5, 4
#: Words of 64 parities of a set.
WORDS = 16
#: One document in so many counts for the order of the shingles, in which a frequent one stands in so many of those, and so many are held last.
ORDER_SHARE, ORDER_LEAST, ORDER_SHINGLES = 4, 3, 1_000_000
#: Documents for which a table of links, classes or ids gets another file, and files of postings for one of those.
FILE_ROWS, POSTS = 200_000, 4


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH)).view("<i8")


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat most over a fixed share of the rows, sorted, and how often they do."""
    sample = rows.where(F.pmod(F.xxhash64("id", "digest"), F.lit(ORDER_SHARE)) == 0).select("body")
    found = map_texts(sample, "body", lambda: lambda texts: {"s": [shingle_set(t) for t in texts]}, "s array<long>", as_bytes=True)
    counts = found.select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= ORDER_LEAST)
    counts = counts.orderBy(F.desc("n"), "s").limit(ORDER_SHINGLES).toPandas().sort_values("s")
    return counts["s"].to_numpy("<i8"), counts["n"].to_numpy("<i4")


def _parities(found: np.ndarray) -> np.ndarray:
    """Bits that tell of each of 64 * WORDS buckets whether an odd number of the set's shingles fall into it."""
    odd = np.bincount(found.view("<u8") % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def shingles(rows: DataFrame) -> DataFrame:
    """rows with cls (digest of the set of shingles), fp, size, bits, head (the prefix that is joined) in place of body."""
    carried = rows.sparkSession.sparkContext.broadcast(_common(rows))

    def make():
        known, often = carried.value

        def apply(texts):
            out: dict[str, list] = {"cls": [], "fp": [], "size": [], "bits": [], "head": []}
            for t in texts:
                hashes = shingle_hashes(t, WIDTH)
                found = np.unique(hashes).view("<i8")
                n = len(found)
                rank = np.zeros(n, "<i8")
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    rank = np.where(known[at] == found, often[at], 0)
                out["cls"].append(xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63))
                out["fp"].append(folded(hashes))
                out["size"].append(n)
                out["bits"].append(_parities(found))
                out["head"].append(found[np.lexsort((found, rank))][: n - (FIFTHS * n + 4) // 5 + 1])
            return out

        return apply

    return map_texts(rows, "body", make, "cls long, fp long, size int, bits array<long>, head array<long>", as_bytes=True)


def _may_link(a: str, b: str, places: bool = True):
    """What two sets must meet whose similarity is 4/5 or more, so that a pair without it needn't be made.

    They have at least c = (size_a + size_b) * 4/9 shingles in common. So neither's first common shingle stands
    behind all but c of its own, and at most size_a + size_b - 2c shingles are in one of them alone, each of which changes one parity.
    """
    sizes = F.col(f"size_{a}") + F.col(f"size_{b}")
    common = F.floor((4 * sizes + 8) / 9)
    apart = sum((F.bit_count(F.col(f"bits_{a}")[i].bitwiseXOR(F.col(f"bits_{b}")[i])) for i in range(1, WORDS)), F.bit_count(F.col(f"bits_{a}")[0].bitwiseXOR(F.col(f"bits_{b}")[0])))
    met = (common <= F.least(f"size_{a}", f"size_{b}")) & (apart <= sizes - 2 * common)
    for n in (a, b) if places else ():
        met = (F.col(f"pos_{n}") <= F.col(f"size_{n}") - common) & met
    return met


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity: 5 * common >= FIFTHS * (all of a + all of b - common)."""
    side = lambda n: sets.select(F.col("cls").alias(n), F.col("set").alias(f"set_{n}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    whole = pairs.where("a <> b").distinct().join(side("a"), "a").join(side("b"), "b")
    return whole.where((5 + FIFTHS) * common >= FIFTHS * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def _checked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, files: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by their whole sets; only the texts of those classes are read for that."""
    pairs = stored(pairs.where("a <> b").distinct(), "pairs", files)
    wanted = stored(classes.select("cls", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi"), "wanted", files)
    bodies = texts.join(few(wanted.select("digest")), "digest", "left_semi").dropDuplicates(["digest"])
    sets = map_texts(bodies, "body", lambda: lambda found: {"set": [shingle_set(t) for t in found]}, "set array<long>", as_bytes=True)
    sets = stored(sets.join(wanted, "digest").select("cls", "set"), "sets")
    links = stored(_verified(pairs, sets), "links", files)
    discard(pairs, wanted, sets)
    return links


def links_of(rows: DataFrame, texts: DataFrame, files: int) -> DataFrame:
    """(a, b): links between the classes of shingles()'s rows, whose components are those of all similar pairs; texts: (digest, body).

    Pairs of a large group of copies would be its size squared. So each class is first compared to one other for each
    of its prefix's shingles, that which has the shingle foremost: in a group of copies those with the fewest changes. Then
    only pairs that the links found don't yet connect are compared. files: how many the smaller tables are written to.
    """
    classes = stored(rows.groupBy("cls").agg(F.min("fp").alias("fp"), F.min("digest").alias("digest"), F.first("size").alias("size"), F.first("bits").alias("bits")), "classes", files)
    heads = rows.select("cls", "size", F.posexplode("head").alias("pos", "token")).where("size > 0")
    same = Window.partitionBy("token")
    heads = heads.withColumns({"least": F.min("cls").over(same), "most": F.max("cls").over(same)})
    posts = stored(heads.where("least < most").select("token", "cls", "size", "pos").distinct(), "posts", POSTS * files)

    # Fingerprints' links, and of each token the class that has it foremost.
    of = lambda n: classes.select(F.col("cls").alias(n), F.col("size").alias(f"size_{n}"), F.col("bits").alias(f"bits_{n}"))
    first = classes.groupBy("fp").agg(F.min("cls").alias("first"))
    ends = trie_links(first.select(F.col("fp").alias("key")), MOST, files=files)
    end = lambda n: first.select(F.col("fp").alias(f"fp_{n}"), F.col("first").alias(n))
    near = ends.toDF("fp_a", "fp_b").join(end("a"), "fp_a").join(end("b"), "fp_b").select("a", "b")
    near = near.unionByName(classes.join(first, "fp").select(F.col("cls").alias("a"), F.col("first").alias("b")))
    lead = posts.groupBy("token").agg(F.min(F.struct("pos", "cls", "size")).alias("lead"))
    common = F.floor((4 * (F.col("size") + F.col("lead.size")) + 8) / 9)
    met = posts.join(lead, "token").where((F.col("pos") <= F.col("size") - common) & (F.col("lead.pos") <= F.col("lead.size") - common))
    tried = stored(near.unionByName(met.select(F.col("cls").alias("a"), F.col("lead.cls").alias("b"))).where("a <> b").distinct(), "tried", files)
    links = _checked(tried.join(of("a"), "a").join(of("b"), "b").where(_may_link("a", "b", places=False)).select("a", "b"), classes, texts, files)
    discard(tried, ends)

    # What is left: pairs in different components that meet in a token.
    member = components(links, files=files).withColumnRenamed("node", "cls")
    held = stored(posts.join(member, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "held")
    groups = held.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots"))
    open_ = held.join(few(stored(groups.where("roots > 1").drop("roots"), "groups", files)), "token").join(classes.select("cls", "bits"), "cls")
    open_ = stored(open_, "open")
    side = lambda n: open_.select("token", "major", *[F.col(c).alias(f"{c}_{n}") for c in ("cls", "size", "pos", "root", "bits")])
    a, b = side("a").where("root_a <> major"), side("b").drop("major")
    pairs = a.join(b, (a["token"] == b["token"]) & (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("major")) | (F.col("cls_a") < F.col("cls_b"))) & _may_link("a", "b"))
    rest = _checked(pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), classes, texts, files)
    # Dealt anew, so that a task contracts links of both.
    found = stored(links.unionByName(rest), "all-links", files)
    discard(posts, held, open_, classes, links, rest)
    return found


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group that links of similarity 0.8 or more connect: that of the smallest id, and of its smallest digest.

    Texts with the same shingles are one group, those without words among them. A row goes only if its own text is in
    a group with a row that stays, so rows that repeat an id with texts of two groups can both stay. Null ids all stay.
    """
    key, digest = F.col(f"`{id_col}`"), F.xxhash64(text_or_empty(text_col))
    rows = columns(docs, id_col, text_col).where(key.isNotNull()).select(key.alias("id"), digest.alias("digest"), text_or_empty(text_col).alias("body"))
    texts = rows.select("digest", "body")
    rows = stored(shingles(rows), "shingles")
    files = 1 + rows.count() // FILE_ROWS
    member = components(links_of(rows, texts, files), files=files).withColumnRenamed("node", "cls")
    held = stored(rows.select("id", "digest", "cls").join(member, "cls", "left").select("id", "digest", F.coalesce("root", "cls").alias("root")), "groups", files)
    kept = held.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("k")).select("k.*")
    named = lambda keys: few(stored(keys.distinct().toDF("kept id", "kept digest"), "keys", files))
    marked = docs.where(key.isNotNull()).withColumn("kept digest of", digest)
    same = (key == F.col("kept id")) & (F.col("kept digest of") == F.col("kept digest"))
    stays = marked.join(named(held.select("id", "digest").join(kept, ["id", "digest"], "left_anti")), same, "left_anti")
    # Only rows that repeat both id and text are dealt out to leave one of each.
    repeated = named(held.groupBy("id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"))
    once = stays.join(repeated, same, "left_semi").dropDuplicates([id_col, "kept digest of"])
    return stays.join(repeated, same, "left_anti").unionByName(once).drop("kept digest of").unionByName(docs.where(key.isNull()))
