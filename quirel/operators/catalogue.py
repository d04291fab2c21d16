"""What a document's catalogue leads to: trees, names, links, labels, layers, files and metadata, by joins over objects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirel.functions.strings import date_to_iso, page_label, text_string, variant_text
from quirel.plans.stages import materialize

from .pages import catalogs, follow, pages, ref
from .reading import reading_rows

#: Levels of name and number trees, outline levels, items of a level, beads of a thread, actions of a chain.
TREE_DEPTH, OUTLINE_DEPTH, LEVEL_ITEMS, BEADS, CHAIN = 32, 64, 10_000, 10_000, 32


def tree_entries(objects: DataFrame, start: DataFrame, leaf: str) -> DataFrame:
    """(doc_id, path, key, entry): entries of name trees (leaf "Names") or number trees ("Nums") in tree order; start: (doc_id, node)."""
    front = follow(start, objects, "node").withColumns({"path": F.array().cast("array<int>"), "above": F.array(F.coalesce("node_num", F.lit(0).cast("long")))})
    found = None
    for _ in range(TREE_DEPTH):
        front = materialize(front)
        pairs = F.try_variant_get("node", f"$.{leaf}", "array<variant>")
        level = front.select("doc_id", "path", pairs.alias("p")).where("size(p) > 1").select("doc_id", "path", F.posexplode(F.expr("transform(sequence(0, size(p) div 2 - 1), i -> struct(p[2 * i] AS key, p[2 * i + 1] AS entry))")).alias("place", "e"))
        level = level.select("doc_id", F.concat("path", F.array(F.lit(0), "place")).alias("path"), "e.key", "e.entry")
        found = level if found is None else found.unionByName(level)
        below = front.select("doc_id", "path", "above", F.posexplode(F.try_variant_get("node", "$.Kids", "array<variant>")).alias("place", "node"))
        below = follow(below.withColumn("path", F.concat("path", F.array(F.lit(1), "place"))).drop("place"), objects, "node")
        front = below.where(~F.coalesce(F.array_contains("above", F.col("node_num")), F.lit(False))).withColumn("above", F.concat("above", F.array(F.coalesce("node_num", F.lit(0)))))
        if front.isEmpty():
            break
    return found


def tree_lookup(objects: DataFrame, start: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, key, entry, visited): what probes (doc_id, key BINARY) find in name trees; entry is null for names that aren't there.

    All probes go down together, a level a join; a kid is joined only where its Limits hold the probe, and `visited` counts a
    probe's nodes. A kid without Limits may hold anything. Of several equal names the first in tree order counts. Keys compare by bytes. Repeated
    probes are answered once.
    """
    once = materialize(probes.select("doc_id", F.hex("key").alias("key")).distinct())
    front = follow(start, objects, "node").join(once, "doc_id").select("doc_id", "key", "node", F.col("node_num"), F.array().cast("array<int>").alias("path"), F.array(F.coalesce("node_num", F.lit(0).cast("long"))).alias("above"))
    raw = lambda column, path: F.upper(F.try_variant_get(column, f"{path}.s", "string"))
    hits, visits = None, None
    for _ in range(TREE_DEPTH):
        front = materialize(front)
        pairs = F.try_variant_get("node", "$.Names", "array<variant>")
        count = F.when(F.size(pairs) > 1, F.floor(F.size(pairs) / 2)).otherwise(0).cast("int")
        match = F.filter(F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda i: F.struct(i.alias("at"), F.upper(F.try_variant_get(F.get(pairs, 2 * i), "$.s", "string")).alias("key"))), lambda e: e["key"] == F.col("key"))
        place = F.get(match, F.lit(0))["at"]
        level = front.select("doc_id", "key", F.concat("path", F.array(F.lit(0), place)).alias("path"), F.get(pairs, 2 * place + 1).alias("entry")).where("entry is not null")
        seen = front.groupBy("doc_id", "key").agg(F.count("*").alias("visited"))
        hits, visits = (level, seen) if hits is None else (hits.unionByName(level), visits.unionByName(seen))
        # Each node's kids are fetched once, for all probes that are at it.
        at = front.where(F.try_variant_get("node", "$.Kids", "variant").isNotNull())
        nodes = at.groupBy("doc_id", "path").agg(F.first("node").alias("node"), F.first("above").alias("above"))
        kids = nodes.select("doc_id", "path", "above", F.posexplode(F.try_variant_get("node", "$.Kids", "array<variant>")).alias("place", "node"))
        kids = follow(kids, objects, "node").where(~F.coalesce(F.array_contains("above", F.col("node_num")), F.lit(False)))
        kids = kids.select("doc_id", F.col("path").alias("up"), F.concat("path", F.array(F.lit(1), "place")).alias("path"), F.concat("above", F.array(F.coalesce("node_num", F.lit(0)))).alias("above"), "node", "node_num", raw("node", "$.Limits[0]").alias("low"), raw("node", "$.Limits[1]").alias("high"))
        p, k = at.select("doc_id", "key", F.col("path").alias("up")).alias("p"), kids.alias("k")
        inside = (F.col("p.doc_id") == F.col("k.doc_id")) & (F.col("p.up") == F.col("k.up")) & F.coalesce(F.col("k.low") <= F.col("p.key"), F.lit(True)) & F.coalesce(F.col("p.key") <= F.col("k.high"), F.lit(True))
        front = p.join(k, inside).select("p.doc_id", "p.key", "k.node", "k.node_num", "k.path", "k.above")
        if front.isEmpty():
            break
    first = hits.groupBy("doc_id", "key").agg(F.min_by("entry", "path").alias("entry"))
    found = once.join(visits.groupBy("doc_id", "key").agg(F.sum("visited").alias("visited")), ["doc_id", "key"], "left").join(first, ["doc_id", "key"], "left")
    return found.select("doc_id", F.unhex("key").alias("key"), "entry", F.coalesce("visited", F.lit(0)).alias("visited"))


def from_catalog(objects: DataFrame, path: str, name: str = "node") -> DataFrame:
    """(doc_id, name): the value at a catalogue path of one or two keys, references followed at each."""
    rows = catalogs(objects).select("doc_id", F.col("catalog").alias(name))
    for key in path.split("."):
        rows = follow(rows.select("doc_id", F.try_variant_get(name, f"$.{key}", "variant").alias(name)).where(F.col(name).isNotNull()), objects, name)
    return rows


def page_index(objects: DataFrame) -> DataFrame:
    return pages(objects, "navigation").select("doc_id", "page_obj", "page_index")


# ---- destinations and links ----


def destination(dest: str, pages_by_obj: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with dest_page, dest_kind and dest_args of an explicit destination array in `dest`; unknown pages give nulls."""
    kind = F.try_variant_get(dest, "$[1].n", "string")
    numbers = F.array(*[F.try_variant_get(dest, f"$[{i}]", "double") for i in range(2, 6)])
    zoom = F.when(kind == "XYZ", F.transform(F.slice(numbers, 1, 3), lambda x, i: F.when((i == 2) & (x == 0), F.lit(None)).otherwise(x)))
    size = F.when(kind.isin("Fit", "FitB"), 0).when(kind.isin("FitH", "FitV", "FitBH", "FitBV"), 1).when(kind == "FitR", 4)
    args = F.coalesce(zoom, F.slice(numbers, F.lit(1), F.coalesce(size, F.lit(0))))
    good = kind.isin("XYZ", "Fit", "FitB", "FitH", "FitV", "FitBH", "FitBV") | ((kind == "FitR") & ~F.exists(numbers, lambda x: x.isNull()))
    rows = rows.withColumn("_page", ref(F.col(dest), "$[0]"))
    rows = rows.join(pages_by_obj.select("doc_id", F.col("page_obj").alias("_page"), F.col("page_index").alias("dest_page")), ["doc_id", "_page"], "left").drop("_page")
    known = F.col("dest_page").isNotNull() & F.coalesce(good, F.lit(False))
    return rows.withColumns({"dest_kind": F.when(known, kind), "dest_args": F.when(known, args), "dest_page": F.when(known, F.col("dest_page"))})


def named_destinations(objects: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, raw_name, name, dest_page, dest_kind, dest_args): the name tree's, and the old dictionary's where the tree has none; index is page_index's, if it is there already."""
    tree = tree_entries(objects, from_catalog(objects, "Names.Dests"), "Names").select("doc_id", F.upper(F.try_variant_get("key", "$.s", "string")).alias("raw_name"), "entry", F.lit(0).alias("rank"))
    old = from_catalog(objects, "Dests").select("doc_id", F.explode(F.try_variant_get("node", "$", "map<string,variant>")).alias("k", "entry")).select("doc_id", F.hex(F.encode("k", "UTF-8")).alias("raw_name"), "entry", F.lit(1).alias("rank"))
    both = follow(tree.unionByName(old).where("raw_name is not null"), objects, "entry").drop("entry_num")
    first = both.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "raw_name").orderBy("rank"))).where("turn = 1")
    dests = first.select("doc_id", "raw_name", text_string(F.unhex("raw_name")).alias("name"), F.coalesce(F.try_variant_get("entry", "$.D", "variant"), F.col("entry")).alias("dest"))
    return destination("dest", page_index(objects) if index is None else index, dests).drop("dest")


def annotations(objects: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_index, seq, obj_num, subtype, rect, contents, name, modified, flags, value): the annotations of all pages (leaves, if they are there already)."""
    listed = (pages(objects, "navigation") if leaves is None else leaves).select("doc_id", "page_index", F.try_variant_get("value", "$.Annots", "variant").alias("annots"))
    listed = follow(listed.where("annots is not null"), objects, "annots")
    single = listed.select("doc_id", "page_index", F.posexplode(F.try_variant_get("annots", "$", "array<variant>")).alias("seq", "value"))
    found = follow(single, objects, "value")
    return found.select(
        "doc_id", "page_index", "seq", F.col("value_num").alias("obj_num"), F.try_variant_get("value", "$.Subtype.n", "string").alias("subtype"), F.try_variant_get("value", "$.Rect", "array<double>").alias("rect"),
        variant_text(F.col("value"), "$.Contents").alias("contents"), variant_text(F.col("value"), "$.NM").alias("name"), date_to_iso(variant_text(F.col("value"), "$.M")).alias("modified"), F.coalesce(F.try_variant_get("value", "$.F", "long"), F.lit(0)).alias("flags"), "value",
    )


def links(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, rect, uri, dest_name, dest_page, dest_kind): link annotations, names joined to their destinations."""
    # One walk of the page tree serves annotations, direct and named destinations.
    leaves = materialize(pages(objects, "navigation").select("doc_id", "page_obj", "page_index", "value"))
    index = leaves.select("doc_id", "page_obj", "page_index")
    found = annotations(objects, leaves).where("subtype = 'Link'")
    found = follow(found.withColumn("action", F.try_variant_get("value", "$.A", "variant")), objects, "action")
    target = F.coalesce(F.try_variant_get("value", "$.Dest", "variant"), F.when(F.try_variant_get("action", "$.S.n", "string") == "GoTo", F.try_variant_get("action", "$.D", "variant")))
    found = found.withColumns({"dest": target, "uri": text_string(F.unhex(F.try_variant_get("action", "$.URI.s", "string")))})
    raw = F.coalesce(F.upper(F.try_variant_get("dest", "$.s", "string")), F.hex(F.encode(F.try_variant_get("dest", "$.n", "string"), "UTF-8")))
    named = named_destinations(objects, index).select("doc_id", F.col("raw_name").alias("_raw"), F.col("dest_page").alias("named_page"), F.col("dest_kind").alias("named_kind"))
    direct = destination("dest", index, found.withColumn("_raw", raw)).join(named, ["doc_id", "_raw"], "left")
    return direct.select("doc_id", "page_index", "seq", "rect", "uri", text_string(F.unhex("_raw")).alias("dest_name"), F.coalesce("dest_page", "named_page").alias("dest_page"), F.coalesce("dest_kind", "named_kind").alias("dest_kind"))


def _outline_items(objects: DataFrame) -> DataFrame:
    return objects.where(F.try_variant_get("value", "$.Title", "variant").isNotNull() & F.try_variant_get("value", "$.Parent.r[0]", "long").isNotNull())


def _outline_order(objects: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, obj_num, node_id, parent_id, depth) of the items that are reached within the limits."""
    pointer = lambda k: F.coalesce(ref(F.col("value"), f"$.{k}"), F.lit(0)).alias(k.lower())
    links_ = items.select("doc_id", "obj_num", pointer("First"), pointer("Next"))
    roots = from_catalog(objects, "Outlines").select("doc_id", F.lit(0).cast("long").alias("obj_num"), F.coalesce(ref(F.col("node"), "$.First"), F.lit(0)).alias("first"), F.lit(0).cast("long").alias("next"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        at = {n: (f, x) for n, f, x in zip(rows["obj_num"], rows["first"], rows["next"])}
        out, seen = [], set()
        stack = [(at[0][0], -1, 0, 1)] if 0 in at else []
        while stack:
            num, parent, depth, place = stack.pop()
            if num not in at or num == 0 or num in seen or depth > OUTLINE_DEPTH or place > LEVEL_ITEMS:
                continue
            seen.add(num)
            out.append((num, len(out), parent, depth))
            stack.append((at[num][1], parent, depth, place + 1))
            stack.append((at[num][0], len(out) - 1, depth + 1, 1))
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "obj_num": [o[0] for o in out], "node_id": [o[1] for o in out], "parent_id": [o[2] for o in out], "depth": [o[3] for o in out]})

    return links_.unionByName(roots).groupBy("doc_id").applyInPandas(walk, "doc_id long, obj_num long, node_id long, parent_id long, depth int")


def outline_issues(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_num, severity, message): bookmarks that outline() doesn't reach, behind the limits of a level or of depth, or by a broken chain."""
    items = _outline_items(objects).select("doc_id", "obj_num", "value")
    lost = items.join(_outline_order(objects, items), ["doc_id", "obj_num"], "left_anti")
    return lost.select("doc_id", "obj_num", F.lit("error").alias("severity"), F.lit("bookmark isn't reached").alias("message"))


def outline(objects: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, depth, title, count, dest_name, dest_page, dest_kind): bookmarks in reading order.

    Items are joined to nothing but their own first and next pointers, which a small function follows for one document at a time.
    """
    items = _outline_items(objects)
    order = _outline_order(objects, items)
    found = order.join(items.select("doc_id", "obj_num", "value"), ["doc_id", "obj_num"])
    action = follow(found.withColumn("action", F.try_variant_get("value", "$.A", "variant")), objects, "action")
    dest = F.coalesce(F.try_variant_get("value", "$.Dest", "variant"), F.try_variant_get("action", "$.D", "variant"))
    raw = F.coalesce(F.upper(F.try_variant_get("dest", "$.s", "string")), F.hex(F.encode(F.try_variant_get("dest", "$.n", "string"), "UTF-8")))
    index = materialize(page_index(objects))
    named = named_destinations(objects, index).select("doc_id", F.col("raw_name").alias("_raw"), F.col("dest_page").alias("named_page"), F.col("dest_kind").alias("named_kind"))
    placed = destination("dest", index, action.withColumn("dest", dest).withColumn("_raw", raw)).join(named, ["doc_id", "_raw"], "left")
    return placed.select("doc_id", "node_id", F.when(F.col("parent_id") >= 0, F.col("parent_id")).alias("parent_id"), "depth", variant_text(F.col("value"), "$.Title").alias("title"), F.coalesce(F.try_variant_get("value", "$.Count", "long"), F.lit(0)).alias("count"), text_string(F.unhex("_raw")).alias("dest_name"), F.coalesce("dest_page", "named_page").alias("dest_page"), F.coalesce("dest_kind", "named_kind").alias("dest_kind"))


def outline_descendants(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, descendants): in reading order a node's descendants are the run of deeper nodes behind it.

    One pass over a document with the open nodes on a stack; nodes aren't joined to nodes.
    """

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node_id")
        ids, depths = rows["node_id"].tolist(), rows["depth"].tolist()
        below, open_ = [0] * len(ids), []
        for i, depth in enumerate([*depths, -1]):
            while open_ and depths[open_[-1]] >= depth:
                at = open_.pop()
                below[at] = i - at - 1
            open_.append(i)
        return pd.DataFrame({"doc_id": rows["doc_id"], "node_id": ids, "descendants": below})

    return nodes.select("doc_id", "node_id", "depth").groupBy("doc_id").applyInPandas(count, "doc_id long, node_id long, descendants long")


# ---- labels and layers ----


def label_ranges(objects: DataFrame) -> DataFrame:
    """(doc_id, start, style, prefix, first): ranges of page labels; of those with one start the first in tree order counts."""
    found = follow(tree_entries(objects, from_catalog(objects, "PageLabels"), "Nums"), objects, "entry").withColumn("start", F.try_variant_get("key", "$", "long")).where("start >= 0")
    first = found.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("path"))).where("turn = 1")
    return first.select("doc_id", "start", F.try_variant_get("entry", "$.S.n", "string").alias("style"), variant_text(F.col("entry"), "$.P").alias("prefix"), F.greatest(F.coalesce(F.try_variant_get("entry", "$.St", "long"), F.lit(1)), F.lit(1)).alias("first"))


def page_labels(objects: DataFrame) -> DataFrame:
    """(doc_id, page_index, label): an as-of join of pages to the last range that starts at or before them."""
    numbered = page_index(objects).select("doc_id", "page_index")
    ranges = label_ranges(objects).select("doc_id", F.col("start").cast("int").alias("page_index"), F.struct("start", "style", "prefix", "first").alias("range"))
    joined = numbered.join(ranges.select("doc_id").distinct(), "doc_id", "left_semi").join(ranges, ["doc_id", "page_index"], "left")
    held = joined.withColumn("range", F.last("range", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page_index")))
    value = F.col("range.first") + F.col("page_index") - F.col("range.start")
    return held.select("doc_id", "page_index", F.when(F.col("range").isNull(), (F.col("page_index") + 1).cast("string")).otherwise(page_label(F.col("range.style"), F.col("range.prefix"), value)).alias("label"))


def page_label_map(objects: DataFrame) -> DataFrame:
    """(doc_id, labels): a map from page to label."""
    return page_labels(objects).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_index", "label"))).alias("labels"))


def appearances(found: DataFrame) -> DataFrame:
    """(doc_id, page_index, seq, normal, rollover, down, states): which appearances annotations have, and their states' names, each once, sorted."""
    sides = {"normal": "N", "rollover": "R", "down": "D"}
    names = F.concat(*[F.coalesce(F.when(F.try_variant_get("value", f"$.AP.{k}.r", "variant").isNull(), F.map_keys(F.try_variant_get("value", f"$.AP.{k}", "map<string,variant>"))), F.array().cast("array<string>")) for k in sides.values()])
    has = [F.try_variant_get("value", f"$.AP.{k}", "variant").isNotNull().alias(n) for n, k in sides.items()]
    return found.select("doc_id", "page_index", "seq", *has, F.array_sort(F.array_distinct(names)).alias("states"))


def layers(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_num, name, visible): optional content groups with the default configuration's base state, then ON, then OFF."""
    held = from_catalog(objects, "OCProperties")
    groups = held.select("doc_id", F.explode(F.try_variant_get("node", "$.OCGs", "array<variant>")).alias("g")).select("doc_id", ref(F.col("g"), "$").alias("obj_num")).distinct()
    config = follow(held.select("doc_id", F.try_variant_get("node", "$.D", "variant").alias("config")), objects, "config")
    listed = lambda key: config.select("doc_id", F.explode(F.try_variant_get("config", f"$.{key}", "array<variant>")).alias("g")).select("doc_id", ref(F.col("g"), "$").alias("obj_num"), F.lit(True).alias(f"is_{key.lower()}")).distinct()
    base = config.select("doc_id", (F.coalesce(F.try_variant_get("config", "$.BaseState.n", "string"), F.lit("ON")) != "OFF").alias("base"))
    named = objects.select("doc_id", "obj_num", variant_text(F.col("value"), "$.Name").alias("name"))
    joined = groups.join(named, ["doc_id", "obj_num"]).join(base, "doc_id", "left").join(listed("ON"), ["doc_id", "obj_num"], "left").join(listed("OFF"), ["doc_id", "obj_num"], "left")
    return joined.select("doc_id", "obj_num", "name", F.when(F.col("is_off"), False).when(F.col("is_on"), True).otherwise(F.coalesce("base", F.lit(True))).alias("visible"))


def layer_configurations(objects: DataFrame) -> DataFrame:
    """(doc_id, config, name, base, on, off, locked, radio): the default configuration as 0 and the others from 1 on; groups are object numbers, radio lists of them."""
    held = from_catalog(objects, "OCProperties")
    others = follow(held.select("doc_id", F.try_variant_get("node", "$.Configs", "variant").alias("configs")).where("configs is not null"), objects, "configs")
    others = others.select("doc_id", F.posexplode(F.try_variant_get("configs", "$", "array<variant>")).alias("config", "value")).withColumn("config", F.col("config") + 1)
    rows = follow(held.select("doc_id", F.lit(0).alias("config"), F.try_variant_get("node", "$.D", "variant").alias("value")).unionByName(others).where("value is not null"), objects, "value")
    numbers = lambda v, path: F.array_compact(F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), lambda g: ref(g, "$")))
    radio = F.transform(F.coalesce(F.try_variant_get("value", "$.RBGroups", "array<variant>"), F.array().cast("array<variant>")), lambda g: numbers(g, "$"))
    return rows.select("doc_id", "config", variant_text(F.col("value"), "$.Name").alias("name"), F.coalesce(F.try_variant_get("value", "$.BaseState.n", "string"), F.lit("ON")).alias("base"), numbers("value", "$.ON").alias("on"), numbers("value", "$.OFF").alias("off"), numbers("value", "$.Locked").alias("locked"), F.filter(radio, lambda g: F.size(g) > 0).alias("radio"))


def layers_by_configuration(objects: DataFrame, configurations: DataFrame) -> DataFrame:
    """(doc_id, config, obj_num, name, visible, locked): each group under each configuration: base state, then ON, then OFF; a base of Unchanged is on."""
    groups = from_catalog(objects, "OCProperties").select("doc_id", F.explode(F.try_variant_get("node", "$.OCGs", "array<variant>")).alias("g")).select("doc_id", ref(F.col("g"), "$").alias("obj_num")).distinct()
    named = objects.select("doc_id", "obj_num", variant_text(F.col("value"), "$.Name").alias("name"))
    both = groups.join(named, ["doc_id", "obj_num"]).join(configurations.drop("name"), "doc_id")
    has = lambda c: F.array_contains(c, F.col("obj_num"))
    return both.select("doc_id", "config", "obj_num", "name", F.when(has("off"), False).when(has("on"), True).otherwise(F.col("base") != "OFF").alias("visible"), has("locked").alias("locked"))


def switched_layers(states: DataFrame, configurations: DataFrame, picks: DataFrame) -> DataFrame:
    """states after picks (doc_id, config, seq, obj_num, on), in the order of seq: a group is as it was picked last.

    A group that is turned on turns off the others of its radio groups, so of several the last one stays on. Locked groups don't
    answer to picks of their own. Picks and radio groups meet by equality on their members, and a group's last event is an aggregate.
    """
    free = picks.join(states.where("locked").select("doc_id", "config", "obj_num"), ["doc_id", "config", "obj_num"], "left_anti")
    members = configurations.select("doc_id", "config", F.posexplode("radio").alias("radio", "all")).select("doc_id", "config", F.explode("all").alias("obj_num"), "all")
    others = free.where("on").join(members, ["doc_id", "config", "obj_num"]).select("doc_id", "config", "seq", F.explode(F.array_except("all", F.array("obj_num"))).alias("obj_num"), F.lit(False).alias("on"))
    events = free.select("doc_id", "config", "seq", "obj_num", "on").unionByName(others)
    last = events.groupBy("doc_id", "config", "obj_num").agg(F.max_by("on", F.struct("seq", "on")).alias("last"))
    return states.join(last, ["doc_id", "config", "obj_num"], "left").withColumn("visible", F.coalesce("last", "visible")).drop("last")


def membership_visible(members: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, member_id, visible) of rows (doc_id, member_id, policy, obj_num) by AllOn, AnyOn, AllOff or AnyOff; without groups it is visible."""
    known = members.join(states.select("doc_id", "obj_num", "visible"), ["doc_id", "obj_num"], "left")
    agg = known.where("obj_num is not null").groupBy("doc_id", "member_id").agg(F.bool_and(F.coalesce("visible", F.lit(False))).alias("all_on"), F.bool_or(F.coalesce("visible", F.lit(False))).alias("any_on"))
    each = members.select("doc_id", "member_id", F.coalesce("policy", F.lit("AnyOn")).alias("policy")).distinct().join(agg, ["doc_id", "member_id"], "left")
    rule = F.when(F.col("policy") == "AllOn", F.col("all_on")).when(F.col("policy") == "AllOff", ~F.col("any_on")).when(F.col("policy") == "AnyOff", ~F.col("all_on")).otherwise(F.col("any_on"))
    return each.select("doc_id", "member_id", F.coalesce(rule, F.lit(True)).alias("visible"))


def visibility_expressions(objects: DataFrame) -> DataFrame:
    """(doc_id, member_id, node): the expressions of memberships, as arrays of an operator and its operands."""
    held = objects.select("doc_id", F.col("obj_num").alias("member_id"), F.try_variant_get("value", "$.VE", "variant").alias("node"))
    return follow(held.where("node is not null"), objects, "node").select("doc_id", "member_id", "node")


def expression_visible(expressions: DataFrame, states: DataFrame) -> DataFrame:
    """(doc_id, member_id, visible) of rows (doc_id, member_id, node) and layer states (doc_id, obj_num, visible).

    Operands are unfolded a level at a time and folded up again by boolean aggregates. An unknown layer
    is hidden, And of nothing holds, Or of nothing doesn't, Not takes its first operand and is void without one.
    A member whose expression is void has no row.
    """
    key = ["doc_id", "member_id"]
    front = expressions.select(*key, F.array().cast("array<int>").alias("path"), "node")
    levels, leaves = [], None
    for _ in range(TREE_DEPTH + 1):
        front = materialize(front)
        if front.isEmpty():
            break
        op = F.try_variant_get("node", "$[0].n", "string")
        levels.append(front.select(*key, "path", op.alias("op")).where(F.col("op").isin("And", "Or", "Not")))
        items = front.where(op.isin("And", "Or", "Not")).select(*key, "path", F.posexplode(F.expr("slice(try_variant_get(node, '$', 'array<variant>'), 2, 2147483647)")).alias("place", "node"))
        items = items.select(*key, F.concat("path", F.array("place")).alias("path"), "node")
        found = items.select(*key, "path", ref(F.col("node"), "$").alias("obj_num")).where("obj_num is not null")
        leaves = found if leaves is None else leaves.unionByName(found)
        front = items.where(F.try_variant_get("node", "$", "array<variant>").isNotNull())
    if leaves is None:
        return expressions.select(*key, F.lit(True).alias("visible")).limit(0)
    values = leaves.join(states.select("doc_id", "obj_num", "visible"), ["doc_id", "obj_num"], "left").select(*key, "path", F.coalesce("visible", F.lit(False)).alias("visible"))
    for depth in range(len(levels) - 1, -1, -1):
        below = values.where(F.size("path") == depth + 1).select(*key, F.slice("path", 1, depth).alias("path"), F.element_at("path", -1).alias("place"), "visible")
        folded = below.groupBy(*key, "path").agg(F.bool_and("visible").alias("every"), F.bool_or("visible").alias("some"), F.min_by("visible", "place").alias("first"))
        rule = F.when(F.col("op") == "And", F.coalesce("every", F.lit(True))).when(F.col("op") == "Or", F.coalesce("some", F.lit(False))).otherwise(~F.col("first"))
        up = levels[depth].join(folded, [*key, "path"], "left").select(*key, "path", rule.alias("visible")).where("visible is not null")
        values = values.where(F.size("path") <= depth).unionByName(up)
    return values.select(*key, "visible")


# ---- files, metadata, claims ----


def attachments(objects: DataFrame) -> DataFrame:
    """(doc_id, seq, name, mime, modified, relationship, bytes): embedded files in the tree's order."""
    specs = follow(tree_entries(objects, from_catalog(objects, "Names.EmbeddedFiles"), "Names"), objects, "entry")
    number = F.coalesce(ref(F.col("entry"), "$.EF.UF"), ref(F.col("entry"), "$.EF.F"))
    streams = objects.where("data is not null").select("doc_id", F.col("obj_num").alias("file_num"), F.col("value").alias("file"), "data")
    found = specs.withColumn("file_num", number).join(streams, ["doc_id", "file_num"])
    name = F.coalesce(variant_text(F.col("entry"), "$.UF"), variant_text(F.col("entry"), "$.F"), text_string(F.unhex(F.try_variant_get("key", "$.s", "string"))))
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("seq"), name.alias("name"), F.try_variant_get("file", "$.Subtype.n", "string").alias("mime"), date_to_iso(variant_text(F.col("file"), "$.Params.ModDate")).alias("modified"), F.try_variant_get("entry", "$.AFRelationship.n", "string").alias("relationship"), F.col("data").alias("bytes"))


#: The standard keys of the information dictionary.
INFO = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "created_at", "ModDate": "modified_at"}


def metadata(objects: DataFrame) -> DataFrame:
    """(doc_id, title, …, keywords ARRAY, created_at, modified_at, custom MAP) of the information dictionary."""
    trailer = objects.where("obj_num = 0").select("doc_id", F.try_variant_get("value", "$.Info", "variant").alias("info"))
    held = follow(trailer.where("info is not null"), objects, "info")
    text = lambda k: variant_text(F.col("info"), f"$.{k}")
    values = {out: date_to_iso(text(k)) if "Date" in k else F.filter(F.transform(F.split(text(k), ","), F.trim), lambda x: x != "") if k == "Keywords" else text(k) for k, out in INFO.items()}
    every = F.try_variant_get("info", "$", "map<string,variant>")
    custom = F.transform_values(F.map_filter(every, lambda k, _: ~k.isin(*INFO, "Trapped")), lambda _, v: variant_text(v, "$"))
    return held.select("doc_id", *[c.alias(n) for n, c in values.items()], custom.alias("custom"))


#: Fields of a metadata packet and the tags that hold them.
XMP = {"title": "dc:title", "creator": "dc:creator", "description": "dc:description", "subject": "dc:subject", "rights": "dc:rights", "format": "dc:format", "create_date": "xmp:CreateDate", "modify_date": "xmp:ModifyDate", "metadata_date": "xmp:MetadataDate", "creator_tool": "xmp:CreatorTool", "producer": "pdf:Producer", "keywords": "pdf:Keywords", "document_id": "xmpMM:DocumentID", "instance_id": "xmpMM:InstanceID", "part": "pdfaid:part", "conformance": "pdfaid:conformance"}


def xmp_fields(packet: Column) -> dict[str, Column]:
    """A packet's fields by element, else by attribute; the first item of lists, all items of subject."""

    def plain(t: Column) -> Column:
        for mark, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(mark), F.lit(c))
        return F.trim(t)

    def one(tag: str) -> Column:
        inside = F.regexp_extract(packet, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        item = F.regexp_extract(inside, r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>", 1)
        attribute = F.regexp_extract(packet, rf"{tag}\s*=\s*[\"']([^\"']*)[\"']", 1)
        value = F.when(inside.contains("<rdf:li"), item).when(inside != "", inside).otherwise(attribute)
        return plain(F.when(value != "", value))

    fields = {n: one(t) for n, t in XMP.items()}
    bag = F.regexp_extract(packet, r"(?s)<dc:subject(?:\s[^>]*)?>(.*?)</dc:subject>", 1)
    fields["subject"] = F.transform(F.regexp_extract_all(bag, F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), 1), plain)
    return fields


def xmp(objects: DataFrame) -> DataFrame:
    held = from_catalog(objects, "Metadata").select("doc_id", F.col("node_num").alias("obj_num")).join(objects.select("doc_id", "obj_num", "data"), ["doc_id", "obj_num"])
    packet = F.make_valid_utf8(F.col("data").cast("string"))
    return held.select("doc_id", *[c.alias(n) for n, c in xmp_fields(packet).items()])


def pdfa(objects: DataFrame) -> DataFrame:
    """(doc_id, signals, declared, inconsistencies, sound): archive claims against what the catalogue holds; a missing language is noted but sound."""
    has = lambda c, p: F.try_variant_get(c, p, "variant").isNotNull()
    trailer = objects.where("obj_num = 0").select("doc_id", has("value", "$.Encrypt").alias("encrypted"), has("value", "$.ID").alias("has_id"))
    signals = catalogs(objects).select("doc_id", has("catalog", "$.Metadata").alias("has_metadata"), has("catalog", "$.OutputIntents").alias("has_intent"), F.coalesce(F.try_variant_get("catalog", "$.MarkInfo.Marked", "boolean"), F.lit(False)).alias("marked"), has("catalog", "$.StructTreeRoot").alias("has_structure"), has("catalog", "$.Lang").alias("has_language"))
    both = signals.join(trailer, "doc_id").join(xmp(objects).select("doc_id", "part", F.upper("conformance").alias("level")), "doc_id", "left")
    declared = F.col("part").isNotNull()
    tagged = declared & (F.col("level") == "A")
    wrong = lambda test, text: F.when(test, F.lit(text))
    problems = F.array_compact(F.array(wrong(declared & F.col("encrypted"), "encrypted"), wrong(declared & ~F.col("has_id"), "no ID"), wrong(declared & ~F.col("has_intent"), "no output intent"), wrong(tagged & ~F.col("marked"), "not marked"), wrong(tagged & ~F.col("has_structure"), "no structure")))
    notes = F.array_compact(F.array(wrong(tagged & ~F.col("has_language"), "no language")))
    return both.select("doc_id", "has_metadata", "has_intent", "marked", "has_structure", "has_language", "encrypted", "has_id", F.when(declared, F.concat(F.lit("PDF/A-"), "part", F.coalesce(F.lower("level"), F.lit("")))).alias("declared"), F.concat(problems, notes).alias("inconsistencies"), (F.size(problems) == 0).alias("sound"))


def signatures(objects: DataFrame) -> DataFrame:
    """(doc_id, field_num, sub_filter, byte_range, contents, signed_at, is_timestamp): signature fields with values; a field of the form may have its type from any field above it."""
    fields = objects.where(F.try_variant_get("value", "$.V.r[0]", "long").isNotNull()).select("doc_id", F.col("obj_num").alias("field_num"), F.try_variant_get("value", "$.FT.n", "string").alias("own"), ref(F.col("value"), "$.V").alias("obj_num"))
    inherited = form_fields(objects).where("kind = 'Sig' and field_num is not null").select("doc_id", "field_num", "kind").dropDuplicates(["doc_id", "field_num"])
    signed = fields.join(inherited, ["doc_id", "field_num"], "left").where(F.coalesce("kind", "own") == "Sig").join(objects.select("doc_id", "obj_num", "value"), ["doc_id", "obj_num"])
    get = lambda p, k: F.try_variant_get("value", p, k)
    return signed.select("doc_id", "field_num", get("$.SubFilter.n", "string").alias("sub_filter"), get("$.ByteRange", "array<long>").alias("byte_range"), F.unhex(get("$.Contents.s", "string")).alias("contents"), date_to_iso(variant_text(F.col("value"), "$.M")).alias("signed_at"), ((get("$.Type.n", "string") == "DocTimeStamp") | (get("$.SubFilter.n", "string") == "ETSI.RFC3161")).alias("is_timestamp"))


def images(objects: DataFrame) -> DataFrame:
    """(doc_id, obj_num, width, height, bits, color_space, filter, data, mask_num): image objects, each once."""
    get = lambda p, k: F.try_variant_get("value", p, k)
    return objects.where(get("$.Subtype.n", "string") == "Image").select("doc_id", "obj_num", get("$.Width", "int").alias("width"), get("$.Height", "int").alias("height"), get("$.BitsPerComponent", "int").alias("bits"), get("$.ColorSpace.n", "string").alias("color_space"), F.coalesce(get("$.Filter.n", "string"), get("$.Filter[0].n", "string")).alias("filter"), "data", ref(F.col("value"), "$.SMask").alias("mask_num"))


def form_fields(objects: DataFrame) -> DataFrame:
    """(doc_id, path, field_num, name, full_name, kind, flags, held, value): form fields and their kids, a level a join, in tree order.

    name is a field's own part of its full name, whose parts are joined by dots; type, flags and held value are those of the nearest field
    above where a field has none of its own.
    """
    form = follow(from_catalog(objects, "AcroForm").select("doc_id", F.try_variant_get("node", "$.Fields", "variant").alias("fields")), objects, "fields")
    handed = {"full_name": "string", "kind": "string", "flags": "long", "held": "variant"}
    front = form.select("doc_id", F.posexplode(F.try_variant_get("fields", "$", "array<variant>")).alias("place", "value")).withColumns({"path": F.array("place"), "above": F.array().cast("array<long>"), **{c: F.lit(None).cast(t) for c, t in handed.items()}})
    found = None
    for _ in range(TREE_DEPTH):
        front = follow(front.drop("place"), objects, "value").where(~F.coalesce(F.array_contains("above", F.col("value_num")), F.lit(False)))
        get = lambda k, kind: F.try_variant_get("value", f"$.{k}", kind)
        name = F.nullif(F.concat_ws(".", "full_name", variant_text(F.col("value"), "$.T")), F.lit(""))
        front = front.withColumns({"above": F.concat("above", F.array(F.coalesce("value_num", F.lit(0)))), "full_name": name, "kind": F.coalesce(get("FT.n", "string"), F.col("kind")), "flags": F.coalesce(get("Ff", "long"), F.col("flags")), "held": F.coalesce(get("V", "variant"), F.col("held"))})
        front = materialize(front)
        if found is not None and front.isEmpty():
            break
        level = front.select("doc_id", "path", F.col("value_num").alias("field_num"), variant_text(F.col("value"), "$.T").alias("name"), *handed, "value")
        found = level if found is None else found.unionByName(level)
        below = follow(front.select("doc_id", "path", "above", *handed, get("Kids", "variant").alias("kids")).where("kids is not null"), objects, "kids")
        front = below.select("doc_id", "path", "above", *handed, F.posexplode(F.try_variant_get("kids", "$", "array<variant>")).alias("place", "value")).withColumn("path", F.concat("path", F.array("place")))
    return found


def action_sources(objects: DataFrame) -> DataFrame:
    """(doc_id, source_rank, source, place, action): what starts an action, from six places in their order.

    Opening, the document's triggers, those of pages, actions and triggers of annotations and of form fields, and named scripts.
    """

    def triggers(rows: DataFrame, rank: int, source: str, place: Column, value: str) -> DataFrame:
        held = follow(rows.select("doc_id", place.alias("place"), F.try_variant_get(value, "$.AA", "variant").alias("aa")).where("aa is not null"), objects, "aa")
        each = held.select("doc_id", "place", F.explode(F.try_variant_get("aa", "$", "map<string,variant>")).alias("trigger", "action"))
        return each.select("doc_id", F.lit(rank).alias("source_rank"), F.concat(F.lit(source + " "), "trigger").alias("source"), "place", "action")

    def own(rows: DataFrame, rank: int, source: str, place: Column, value: Column) -> DataFrame:
        return rows.select("doc_id", F.lit(rank).alias("source_rank"), F.lit(source).alias("source"), place.alias("place"), value.alias("action"))

    heads, noted, fields = catalogs(objects), annotations(objects), materialize(form_fields(objects))
    of_note, of_field = F.concat_ws(".", "page_index", "seq"), F.concat(F.array_join(F.col("path").cast("array<string>"), "."), F.lit(" "), F.coalesce("name", F.lit("")))
    scripts = tree_entries(objects, from_catalog(objects, "Names.JavaScript"), "Names")
    parts = [
        own(heads, 0, "open", F.lit(""), F.try_variant_get("catalog", "$.OpenAction", "variant")),
        triggers(heads, 1, "document", F.lit(""), "catalog"),
        triggers(pages(objects, "navigation"), 2, "page", F.col("page_index").cast("string"), "value"),
        own(noted, 3, "annotation", of_note, F.try_variant_get("value", "$.A", "variant")),
        triggers(noted, 4, "annotation", of_note, "value"),
        own(fields, 5, "field", of_field, F.try_variant_get("value", "$.A", "variant")),
        triggers(fields, 6, "field", of_field, "value"),
        own(scripts, 7, "script", F.array_join(F.col("path").cast("array<string>"), "."), F.col("entry")),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.where("action is not null")


def action_rows(objects: DataFrame) -> DataFrame:
    """(doc_id, source_rank, source, place, id, action, depth): actions of all sources, with their chains of up to CHAIN.

    Sources' own actions always count. One that is chained to counts once in a document, for the first source that leads
    to it, so cycles end. An action that stands in another is named by that and its place there.
    """
    is_action = F.try_variant_get("action", "$.S.n", "string").isNotNull()
    source = ["doc_id", "source_rank", "source", "place"]
    start = materialize(follow(action_sources(objects), objects, "action").where(is_action))
    front = start.withColumns({"depth": F.lit(0), "id": F.concat_ws(":", F.lit("c"), "source_rank", "source", "place")}).drop("action_num")
    first, chained, met = front, None, None
    for depth in range(1, CHAIN + 1):
        following = follow(front.select(*source, "id", F.try_variant_get("action", "$.Next", "variant").alias("next")).where("next is not null"), objects, "next")
        items = F.coalesce(F.try_variant_get("next", "$", "array<variant>"), F.array("next"))
        listed = following.select(*source, "id", F.when(F.try_variant_get("next", "$", "array<variant>").isNull(), F.col("next_num")).alias("whole"), F.posexplode(items).alias("at", "action"))
        front = follow(listed, objects, "action").where(is_action).withColumn("number", F.coalesce("action_num", "whole"))
        front = front.withColumn("id", F.coalesce(F.concat(F.lit("n"), F.col("number").cast("string")), F.concat("id", F.lit("/"), F.col("at").cast("string"))))
        front = front.select(*source, "id", "action").withColumn("turn", F.row_number().over(Window.partitionBy(*source, "id").orderBy(F.lit(1)))).where("turn = 1").drop("turn")
        front = materialize((front if met is None else front.join(met, [*source, "id"], "left_anti")).withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        chained = front if chained is None else chained.unionByName(front)
        seen = front.select(*source, "id")
        met = seen if met is None else met.unionByName(seen)
    found = first
    if chained is not None:
        once = chained.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("source_rank", "source", "place", "depth")))
        found = first.unionByName(once.where("turn = 1").drop("turn"))
    return found


def actions(objects: DataFrame) -> DataFrame:
    """(doc_id, source_rank, source, place, depth, kind, target): the rows of action_rows with one text for what each leads to."""
    target = F.coalesce(*[variant_text(F.col("action"), f"$.{k}") for k in ("URI", "D", "N", "JS", "F")])
    return action_rows(objects).select("doc_id", "source_rank", "source", "place", "depth", F.try_variant_get("action", "$.S.n", "string").alias("kind"), target.alias("target"))


# ---- structure ----


def structure_keys(objects: DataFrame) -> DataFrame:
    """(doc_id, seq, page_obj, mcid): marked content in the structure tree's order; pages are inherited, references to objects are passed over."""
    front = from_catalog(objects, "StructTreeRoot").select("doc_id", F.col("node").alias("item"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("long").alias("page_obj"))
    found = None
    for _ in range(64):
        front = materialize(front)
        kids = F.try_variant_get("item", "$.K", "variant")
        each = F.coalesce(F.try_variant_get(kids, "$", "array<variant>"), F.array(kids))
        below = front.select("doc_id", "path", F.coalesce(ref(F.col("item"), "$.Pg"), F.col("page_obj")).alias("page_obj"), F.posexplode(each).alias("place", "item")).where("item is not null")
        below = follow(below.withColumn("path", F.concat("path", F.array("place"))).drop("place"), objects, "item").drop("item_num")
        mcid = F.coalesce(F.try_variant_get("item", "$", "long"), F.try_variant_get("item", "$.MCID", "long"))
        level = below.where(mcid.isNotNull()).select("doc_id", "path", F.coalesce(ref(F.col("item"), "$.Pg"), F.col("page_obj")).alias("page_obj"), mcid.alias("mcid"))
        found = level if found is None else found.unionByName(level)
        front = below.where(mcid.isNull() & (F.coalesce(F.try_variant_get("item", "$.Type.n", "string"), F.lit("")) != "OBJR"))
        if front.isEmpty():
            break
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("seq"), "page_obj", "mcid")


def structure_text(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, place, text): runs joined to the structure tree's keys, first use of a key only; runs outside the tree come behind their page's last group.

    A document whose tree covers less than half of its text, or that has none, is read by geometry, row by row.
    """
    keys = structure_keys(objects)
    first = keys.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "page_obj", "mcid").orderBy("seq"))).where("turn = 1").drop("turn")
    body = found.where("not artifact")
    weight = F.length("text")
    placed = body.join(first, ["doc_id", "page_obj", "mcid"])
    covered = materialize(placed.groupBy("doc_id").agg(F.sum(weight).alias("inside")).join(body.groupBy("doc_id").agg(F.sum(weight).alias("total")), "doc_id").where("2 * inside >= total").select("doc_id"))
    tail = placed.groupBy("doc_id", "page_obj").agg(F.max("seq").alias("seq"))
    loose = found.join(first, ["doc_id", "page_obj", "mcid"], "left_anti").join(tail, ["doc_id", "page_obj"])
    every = placed.select("doc_id", "seq", F.lit(0).alias("loose"), "page_index", "run_seq", "text").unionByName(loose.select("doc_id", "seq", F.lit(1).alias("loose"), "page_index", "run_seq", "text")).join(covered, "doc_id", "left_semi")
    groups = every.groupBy("doc_id", "seq", "loose").agg(F.array_sort(F.collect_list(F.struct("page_index", "run_seq", "text"))).alias("runs"))
    order = Window.partitionBy("doc_id").orderBy("seq", "loose")
    tagged = groups.select("doc_id", (F.row_number().over(order) - 1).alias("place"), F.array_join(F.transform("runs", lambda r: r["text"]), " ").alias("text"))
    rows = reading_rows(found.join(covered, "doc_id", "left_anti"))
    in_order = Window.partitionBy("doc_id").orderBy("page_index", "row_seq")
    return tagged.unionByName(rows.select("doc_id", (F.row_number().over(in_order) - 1).alias("place"), "text"))


def threads(objects: DataFrame) -> DataFrame:
    """(doc_id, thread, bead_seq, page_index, rect, title): article threads, each ring of beads unrolled from its first."""
    listed = from_catalog(objects, "Threads").select("doc_id", F.posexplode(F.try_variant_get("node", "$", "array<variant>")).alias("thread", "value"))
    heads = follow(listed, objects, "value").select("doc_id", "thread", ref(F.col("value"), "$.F").alias("first"), variant_text(F.col("value"), "$.I.Title").alias("title"))
    beads = objects.where(F.try_variant_get("value", "$.N.r[0]", "long").isNotNull() & F.try_variant_get("value", "$.R", "variant").isNotNull()).select("doc_id", "obj_num", ref(F.col("value"), "$.N").alias("next"), ref(F.col("value"), "$.P").alias("page_obj"), F.try_variant_get("value", "$.R", "array<double>").alias("rect"))

    both = heads.select("doc_id", "thread", F.col("first").alias("obj_num"), F.lit(None).cast("long").alias("next")).unionByName(beads.select("doc_id", F.lit(-1).alias("thread"), "obj_num", "next"))

    def unroll(rows: pd.DataFrame) -> pd.DataFrame:
        steps = rows[rows["thread"] < 0]
        at = dict(zip(steps["obj_num"], steps["next"]))
        out = []
        for thread, bead in rows.loc[rows["thread"] >= 0, ["thread", "obj_num"]].itertuples(index=False):
            seen: set[int] = set()
            while bead in at and bead not in seen and len(seen) < BEADS:
                out.append((rows["doc_id"].iloc[0], thread, len(seen), bead))
                seen.add(bead)
                bead = at[bead]
        return pd.DataFrame(out, columns=["doc_id", "thread", "bead_seq", "obj_num"])

    rings = both.groupBy("doc_id").applyInPandas(unroll, "doc_id long, thread int, bead_seq int, obj_num long")
    return rings.join(beads.drop("next"), ["doc_id", "obj_num"]).join(heads.select("doc_id", "thread", "title"), ["doc_id", "thread"]).join(page_index(objects), ["doc_id", "page_obj"], "left").select("doc_id", "thread", "bead_seq", "page_index", "rect", "title")
