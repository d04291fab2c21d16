"""The page tree as joins over the objects table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.plans.stages import materialize

#: Levels of the tree by mode; "strict" goes deeper than the others.
LEVELS = {"strict": 256, "lenient": 64, "navigation": 64}


def ref(value: Column, path: str) -> Column:
    """Object number that a reference at a path holds."""
    return F.try_variant_get(value, f"{path}.r[0]", "long")


def get_name(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"{path}.n", "string")


def catalogs(objects: DataFrame) -> DataFrame:
    """(doc_id, root, catalog, info_num): the trailer's catalogue."""
    trailer = objects.where("obj_num = 0").select("doc_id", ref(F.col("value"), "$.Root").alias("root"), ref(F.col("value"), "$.Info").alias("info_num"))
    return trailer.join(objects.select("doc_id", F.col("obj_num").alias("root"), F.col("value").alias("catalog")), ["doc_id", "root"])


def follow(rows: DataFrame, objects: DataFrame, column: str, hops: int = 1) -> DataFrame:
    """rows with the VARIANT `column` replaced by what it refers to, where it is a reference; `column`_num keeps the number."""
    for hop in range(hops):
        at = rows.withColumn("_num", ref(F.col(column), "$"))
        held = objects.where("obj_num > 0").select("doc_id", F.col("obj_num").alias("_num"), F.col("value").alias("_value"))
        rows = at.join(held, ["doc_id", "_num"], "left").withColumn(column, F.coalesce("_value", column)).drop("_value")
        number = F.col("_num") if hop == 0 else F.coalesce(f"{column}_num", "_num")
        rows = rows.withColumn(f"{column}_num", number).drop("_num")
    return rows


#: Entries of a node that may be references to what counts.
FOLLOWED = ("Kids", "MediaBox", "Rotate", "Contents")


def tree_nodes(objects: DataFrame, untyped: bool) -> DataFrame:
    """(doc_id, obj_num, value, held): what may be a node of a page tree, with its FOLLOWED entries as JSON.

    An entry that refers to an array or a number is replaced by that; a reference to a stream stays one. One join
    serves all entries, and only references take part in it.
    """
    kind = get_name(F.col("value"), "$.Type")
    nodes = objects.where("obj_num > 0").select("doc_id", "obj_num", "value").where(kind.isin("Page", "Pages") | (kind.isNull() if untyped else F.lit(False)))
    at = F.create_map(*[x for k in FOLLOWED for x in (F.lit(k), ref(F.col("value"), f"$.{k}"))])
    refs = nodes.select("doc_id", F.col("obj_num").alias("holder"), F.explode(at).alias("key", "obj_num")).where("obj_num is not null")
    plain = F.try_variant_get("value", "$", "array<variant>").isNotNull() | F.try_variant_get("value", "$", "double").isNotNull()
    targets = objects.where("data is null and obj_num > 0").where(plain).select("doc_id", "obj_num", F.to_json("value").alias("target"))
    far = refs.join(targets, ["doc_id", "obj_num"]).groupBy("doc_id", F.col("holder").alias("obj_num")).agg(F.map_from_entries(F.collect_list(F.struct("key", "target"))).alias("far"))
    own = lambda k: F.coalesce(F.element_at("far", k), F.to_json(F.try_variant_get("value", f"$.{k}", "variant")))
    held = F.struct(*[own(k).alias(k) for k in FOLLOWED])
    return nodes.join(far, ["doc_id", "obj_num"], "left").select("doc_id", "obj_num", "value", held.alias("held"))


def _items(json: Column) -> Column:
    """The entries of an array in JSON; null for anything else."""
    return F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")


def page_tree(objects: DataFrame, mode: str = "lenient") -> DataFrame:
    """(doc_id, obj_num, parent, depth, path, is_leaf, value, held, resources, media_box, rotate): every node that is reached.

    A level of the tree is one join. A node that its own ancestors hold, and one of an unknown type, is left out; in
    navigation mode a node without a type counts as inner. What pages inherit comes down with the walk. Kids that
    aren't an array lead nowhere.
    """
    nodes = materialize(tree_nodes(objects, mode == "navigation"))
    start = catalogs(objects).select("doc_id", ref(F.col("catalog"), "$.Pages").alias("obj_num"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<int>").alias("path"), F.array().cast("array<long>").alias("above"))
    start = start.withColumns({c: F.lit(None).cast("string") for c in ("resources", "media_box", "rotate")})
    found, front = [], start
    for depth in range(LEVELS[mode]):
        own = {"resources": F.to_json(F.try_variant_get("value", "$.Resources", "variant")), "media_box": F.col("held.MediaBox"), "rotate": F.col("held.Rotate")}
        level = front.join(nodes, ["doc_id", "obj_num"]).withColumns({k: F.coalesce(v, k) for k, v in own.items()})
        kind = get_name(F.col("value"), "$.Type")
        kind = F.coalesce(kind, F.lit("Pages")) if mode == "navigation" else kind
        level = materialize(level.withColumn("is_leaf", kind == "Page").where(kind.isin("Page", "Pages")).withColumn("depth", F.lit(depth)))
        found.append(level)
        below = level.where("not is_leaf").select("doc_id", "obj_num", "path", "above", "resources", "media_box", "rotate", F.posexplode(_items(F.col("held.Kids"))).alias("place", "kid"))
        front = below.select("doc_id", ref(F.col("kid"), "$").alias("kid_num"), F.col("obj_num").alias("parent"), F.concat("path", F.array("place")).alias("path"), F.concat("above", F.array("obj_num")).alias("above"), "resources", "media_box", "rotate")
        front = front.where(~F.array_contains("above", F.col("kid_num"))).withColumnRenamed("kid_num", "obj_num")
        if front.isEmpty():
            break
    out = found[0]
    for level in found[1:]:
        out = out.unionByName(level)
    return out.drop("above")


def pages(objects: DataFrame, mode: str = "lenient") -> DataFrame:
    """(doc_id, page_index, page_obj, width, height, rotate, resources, contents): leaves in tree order; a page met twice counts once.

    Without a media box a page is 595 by 842. contents are the object numbers of its streams.
    """
    leaves = page_tree(objects, mode).where("is_leaf")
    once = leaves.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "obj_num").orderBy("path"))).where("turn = 1")
    box = F.from_json("media_box", "array<double>")
    single = ref(F.try_parse_json("held.Contents"), "$")
    several = F.transform(_items(F.col("held.Contents")), lambda c: ref(c, "$"))
    return once.select(
        "doc_id",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("page_index"),
        F.col("obj_num").alias("page_obj"),
        F.coalesce(F.get(box, 2) - F.get(box, 0), F.lit(595.0)).alias("width"),
        F.coalesce(F.get(box, 3) - F.get(box, 1), F.lit(842.0)).alias("height"),
        F.coalesce(F.col("rotate").try_cast("double").try_cast("int"), F.lit(0)).alias("rotate"),
        "resources",
        F.coalesce(F.when(single.isNotNull(), F.array(single)), several, F.array().cast("array<long>")).alias("contents"),
        "value",
    )


def hierarchy_issues(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_num, severity, message): counts that differ from the leaves below, parents that aren't the walk's, kids that lead nowhere."""
    tree = page_tree(objects, "navigation")
    inner = tree.where("not is_leaf").select("doc_id", "obj_num", F.col("path").alias("top"), F.try_variant_get("value", "$.Count", "long").alias("stated"))
    # Each leaf counts once for each beginning of its path, so leaves and inner nodes meet by equality.
    tops = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    under = tree.where("is_leaf and size(path) > 0").select("doc_id", F.explode(tops).alias("top")).groupBy("doc_id", "top").agg(F.count("*").alias("leaves"))
    counted = inner.join(under, ["doc_id", "top"], "left").withColumn("leaves", F.coalesce("leaves", F.lit(0)))
    wrong = counted.where("stated is null or stated <> leaves").select("doc_id", "obj_num", F.lit("error").alias("severity"), F.concat(F.lit("Count "), F.coalesce(F.col("stated").cast("string"), F.lit("missing")), F.lit(" over "), F.col("leaves").cast("string"), F.lit(" pages")).alias("message"))
    parent = ref(F.col("value"), "$.Parent")
    strays = tree.where(F.col("parent").isNotNull() & ~parent.eqNullSafe(F.col("parent"))).select("doc_id", "obj_num", F.lit("error").alias("severity"), F.lit("Parent is another node").alias("message"))
    listed = _items(F.col("held.Kids"))
    kids = tree.where("not is_leaf").select("doc_id", F.col("obj_num").alias("holder"), F.explode(listed).alias("kid")).select("doc_id", "holder", ref(F.col("kid"), "$").alias("obj_num"))
    odd = tree.where("not is_leaf and held.Kids is not null").where(listed.isNull()).select("doc_id", "obj_num", F.lit("error").alias("severity"), F.lit("Kids isn't an array").alias("message"))
    lost = kids.join(objects.select("doc_id", "obj_num"), ["doc_id", "obj_num"], "left_anti").select("doc_id", "obj_num", F.lit("error").alias("severity"), F.lit("Kid isn't there").alias("message"))
    bare = tree.where(F.col("is_leaf") & F.col("media_box").isNull()).select("doc_id", "obj_num", F.lit("warning").alias("severity"), F.lit("MediaBox is missing").alias("message"))
    return wrong.unionByName(strays).unionByName(lost).unionByName(odd).unionByName(bare)
