"""Writers of what hangs together by references: name and number trees, outlines, attachments, links, information.

Trees are built from their leaves up: rows in key order are cut into leaves by row number, bounds come from minima and maxima,
and levels are made until each document has one node left. Sibling lists come from lag and lead.
Results are rows (doc_id, obj_num, body) for writer.assemble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions.strings import iso_to_date
from quirel.plans.stages import materialize, written

from .writer import literal_string, name, stream, text_string

#: Entries of a leaf and kids of an inner node.
FAN = 64


def _ref(number: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(" 0 R"))


def _joined(order: str, text: Column) -> Column:
    """Aggregate: texts in the order of a column, separated by spaces."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"]), " ")


def _tree(entries: DataFrame, first: int, fan: int, leaf: str, shown) -> DataFrame:
    """Nodes of a tree over (doc_id, key, value) with keys in order of the column `key`; shown(key) is a key as it stands in a file."""
    # Of entries with one key the smallest value counts; keys are numbered within their document.
    once = entries.groupBy("doc_id", "key").agg(F.min("value").alias("value"))
    rows = once.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    pair = F.concat(shown(F.col("key")), F.lit(" "), F.col("value"))
    level = rows.groupBy("doc_id", "n", F.floor(F.col("at") / fan).alias("at")).agg(F.min("key").alias("low"), F.max("key").alias("high"), _joined("at", pair).alias("items"))
    level = materialize(level.withColumns({"depth": F.lit(0), "begin": F.lit(first).cast("long"), "nodes": F.ceil(F.col("n") / fan)}))
    found = level
    while True:
        # What has more than one node on this level gets a level above it, numbered behind it.
        wide = level.where("nodes > 1")
        if wide.isEmpty():
            break
        kid = _ref(F.col("begin") + F.col("at"))
        above = wide.groupBy("doc_id", "n", "depth", "begin", "nodes", F.floor(F.col("at") / fan).alias("up")).agg(F.min("low").alias("low"), F.max("high").alias("high"), _joined("at", kid).alias("items"))
        level = materialize(above.select("doc_id", "n", F.col("up").alias("at"), "low", "high", "items", (F.col("depth") + 1).alias("depth"), (F.col("begin") + F.col("nodes")).alias("begin"), F.ceil(F.col("nodes") / fan).alias("nodes")))
        found = found.unionByName(level)
    limits = F.when(F.col("nodes") > 1, F.concat(F.lit("/Limits ["), shown(F.col("low")), F.lit(" "), shown(F.col("high")), F.lit("] "))).otherwise("")
    kind = F.when(F.col("depth") == 0, f"/{leaf}").otherwise("/Kids")
    body = F.concat(F.lit("<< "), limits, kind, F.lit(" ["), F.col("items"), F.lit("] >>"))
    return found.select("doc_id", (F.col("begin") + F.col("at")).cast("long").alias("obj_num"), body.alias("body"), (F.col("nodes") == 1).alias("is_root"), "depth")


def name_tree(entries: DataFrame, first: int, fan: int = FAN) -> DataFrame:
    """(doc_id, obj_num, body, is_root, depth) of rows (doc_id, key BINARY, value): a balanced name tree of each document, numbered from `first`.

    Keys are in order of their bytes; of equal ones the smallest value counts. value is an object's text. A null or empty key is a key like others.
    """
    keyed = entries.select("doc_id", F.coalesce("key", F.lit(b"")).alias("key"), "value")
    return _tree(keyed, first, fan, "Names", lambda key: F.concat(F.lit("<"), F.hex(key), F.lit(">")))


def number_tree(entries: DataFrame, first: int, fan: int = FAN) -> DataFrame:
    """(doc_id, obj_num, body, is_root, depth) of rows (doc_id, key LONG, value): as name_tree, in order of numbers; rows without a key are left out."""
    return _tree(entries.select("doc_id", F.col("key").cast("long").alias("key"), "value").where("key is not null"), first, fan, "Nums", lambda key: key.cast("string"))


def root_refs(tree: DataFrame) -> DataFrame:
    """(doc_id, root): a reference to each document's root node."""
    return tree.where("is_root").select("doc_id", _ref(F.col("obj_num")).alias("root"))


def outline_objects(items: DataFrame, first: int) -> DataFrame:
    """(doc_id, obj_num, body) of rows (doc_id, item, parent, place, title, dest, is_open): bookmarks, and their root as object `first`.

    item is a number from 1 on, once in a document, and `first` + item becomes its object; parent is null at the top; place orders the items of one parent, equal
    places by item. dest is an object's text or null. Next, Prev, First and Last come from windows and minima; counts
    go up a level at a time, past open items only. Items whose parent isn't there, or that lead back to themselves, are left out.
    """
    rows = items.select("doc_id", F.col("item").cast("long").alias("item"), F.coalesce(F.col("parent").cast("long"), F.lit(0)).alias("parent"), "place", "title", F.concat(F.lit(" /Dest "), "dest").alias("dest"), F.coalesce("is_open", F.lit(True)).alias("is_open"))
    rows = written(rows, "bookmarks")
    # Down from the top to know what is reached and how deep it lies; then up again with the counts. Texts don't take part.
    slim = rows.select("doc_id", "item", "parent", "is_open")
    levels = [slim.where("parent = 0")]
    while True:
        below = materialize(slim.join(levels[-1].select("doc_id", F.col("item").alias("parent")), ["doc_id", "parent"]).select(*slim.columns))
        if below.isEmpty():
            break
        levels.append(below)
    shown, counts = None, None
    for level in reversed(levels):
        level = level.withColumn("under", F.lit(0).cast("long")) if shown is None else level.join(shown, ["doc_id", "item"], "left").withColumn("under", F.coalesce("under", F.lit(0).cast("long")))
        level = materialize(level)
        # An item shows itself, and what is under it where it is open.
        shown = level.groupBy("doc_id", F.col("parent").alias("item")).agg(F.sum(1 + F.when(F.col("is_open"), F.col("under")).otherwise(0)).alias("under"))
        counts = level.select("doc_id", "item", "under") if counts is None else counts.unionByName(level.select("doc_id", "item", "under"))
    counted = written(rows.join(counts, ["doc_id", "item"]), "counted-bookmarks")
    siblings = Window.partitionBy("doc_id", "parent").orderBy("place", "item")
    at = lambda n: _ref(first + n)
    entry = lambda key, n: F.coalesce(F.concat(F.lit(f" /{key} "), at(n)), F.lit(""))
    order = F.struct("place", "item")
    ends = counted.groupBy("doc_id", F.col("parent").alias("item")).agg(F.min_by("item", order).alias("head"), F.max_by("item", order).alias("last"))
    linked = counted.withColumns({"prev": F.lag("item").over(siblings), "next": F.lead("item").over(siblings)}).join(ends, ["doc_id", "item"], "left")
    count = F.when(F.col("under") > 0, F.concat(F.lit(" /Count "), F.when(F.col("is_open"), F.col("under")).otherwise(-F.col("under")).cast("string"))).otherwise("")
    body = F.concat(F.lit("<< /Title "), text_string(F.coalesce("title", F.lit(""))), F.lit(" /Parent "), at(F.col("parent")), entry("Prev", F.col("prev")), entry("Next", F.col("next")), entry("First", F.col("head")), entry("Last", F.col("last")), count, F.coalesce("dest", F.lit("")), F.lit(" >>"))
    tops = shown.join(ends, ["doc_id", "item"])
    root = F.concat(F.lit("<< /Type /Outlines"), entry("First", F.col("head")), entry("Last", F.col("last")), F.lit(" /Count "), F.col("under").cast("string"), F.lit(" >>"))
    return linked.select("doc_id", (first + F.col("item")).alias("obj_num"), body.alias("body")).unionByName(tops.select("doc_id", F.lit(first).cast("long").alias("obj_num"), root.alias("body")))


def attachment_objects(files: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Objects and (doc_id, root) of rows (doc_id, key BINARY, name, data, mime, modified, description): embedded files under a name tree.

    data has a character for each byte; mime, modified and description may be null. Of files with one key in a document the
    first by name counts. A file is two objects, numbered from `first` in order of keys, and the tree follows behind them.
    """
    # Whole rows aren't ordered by their data: only what names them takes part.
    turn = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("name"))
    once = files.withColumn("key", F.coalesce("key", F.lit(b""))).withColumn("_turn", turn).where("_turn = 1").drop("_turn")
    rows = materialize(once.withColumn("at", (F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1).cast("long")))
    spec = first + 2 * F.col("at")
    part = lambda key, value: F.coalesce(F.concat(F.lit(f" /{key} "), value), F.lit(""))
    about = F.concat(F.lit("<< /Type /Filespec /F "), literal_string(F.col("name")), F.lit(" /UF "), text_string(F.col("name")), part("Desc", text_string(F.col("description"))), F.lit(" /EF << /F "), _ref(spec + 1), F.lit(" >> >>"))
    held = stream(F.col("data"), F.concat(F.lit("/Type /EmbeddedFile"), part("Subtype", F.concat(F.lit("/"), F.regexp_replace("mime", "/", "#2F"))), F.lit(" /Params << /Size "), F.length("data").cast("string"), part("ModDate", literal_string(iso_to_date(F.col("modified")))), F.lit(" >>")))
    objects = rows.select("doc_id", F.explode(F.array(F.struct(spec.alias("obj_num"), about.alias("body")), F.struct((spec + 1).alias("obj_num"), held.alias("body")))).alias("o")).select("doc_id", "o.*")
    most = rows.agg(F.max("at")).first()[0]
    tree = name_tree(rows.select("doc_id", "key", _ref(spec).alias("value")), first + 2 * (1 + (most or 0)))
    return objects.unionByName(tree.select("doc_id", "obj_num", "body")), root_refs(tree)


def info_body(title=None, author=None, subject=None, keywords=None, creator=None, producer=None, created=None, modified=None, custom: dict[str, Column] | None = None) -> Column:
    """An information dictionary's text of columns; what is null is left out. created and modified are timestamps, keywords an array of strings."""
    texts = {"Title": title, "Author": author, "Subject": subject, "Creator": creator, "Producer": producer, **(custom or {})}
    parts = [F.concat(F.lit(f" /{key} "), text_string(value)) for key, value in texts.items() if value is not None]
    parts += [F.concat(F.lit(" /Keywords "), text_string(F.array_join(keywords, ",")))] if keywords is not None else []
    parts += [F.concat(F.lit(f" /{key} "), literal_string(iso_to_date(value))) for key, value in (("CreationDate", created), ("ModDate", modified)) if value is not None]
    return F.concat(F.lit("<<"), *[F.coalesce(p, F.lit("")) for p in parts], F.lit(" >>"))


def link_body(rect: Column, uri: Column | None = None, dest: Column | None = None) -> Column:
    """A link annotation's text: rect an array of four numbers; uri, or else dest, an object's text, says where it leads."""
    to = F.concat(F.lit(" /A << /S /URI /URI "), literal_string(uri), F.lit(" >>")) if uri is not None else F.lit(None)
    other = F.concat(F.lit(" /Dest "), dest) if dest is not None else F.lit(None)
    return F.concat(F.lit("<< /Type /Annot /Subtype /Link /Rect ["), F.array_join(F.transform(rect, lambda x: x.cast("string")), " "), F.lit("]"), F.coalesce(to, other, F.lit("")), F.lit(" >>"))


def note_body(rect: Column, contents: Column, subtype: str = "Text", modified: Column | None = None, key: Column | None = None) -> Column:
    """An annotation's text with contents, and optionally a time (timestamp) and a name of its own."""
    parts = [F.lit(" /Contents "), text_string(F.coalesce(contents, F.lit("")))]
    parts += [F.coalesce(F.concat(F.lit(" /M "), literal_string(iso_to_date(modified))), F.lit(""))] if modified is not None else []
    parts += [F.coalesce(F.concat(F.lit(" /NM "), literal_string(key)), F.lit(""))] if key is not None else []
    return F.concat(F.lit("<< /Type /Annot"), F.concat(F.lit(" /Subtype "), name(F.lit(subtype))), F.lit(" /Rect ["), F.array_join(F.transform(rect, lambda x: x.cast("string")), " "), F.lit("]"), *parts, F.lit(" >>"))
