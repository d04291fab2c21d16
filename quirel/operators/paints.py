"""What content streams name in their resources to paint with: graphics states, colour spaces, patterns and shadings, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirel.functions import colour
from quirel.plans.stages import materialize

from .pages import follow, ref
from .shadings import SPACES, function_at, functions_of, hex_colour
from .text import resource_entries

#: Stands in fill and stroke for a colour that fill_paint and stroke_paint describe.
NAMED = "named"
#: Components of the spaces that aren't devices'.
CIE = {"CalGray": 1, "CalRGB": 3, "Lab": 3}

_SIMPLE = "struct<kind:string,parts:int,white:array<double>,gamma:array<double>,matrix:array<double>,range:array<double>>"
_TINT = "struct<parts:array<struct<n:double,c0:array<double>,c1:array<double>>>,bounds:array<double>,encode:array<double>,span:array<double>>"
_SAMPLES = "struct<data:binary,size:int,span:array<double>,range:array<double>>"


def _simple(value: str, about: str) -> Column:
    """A device, calibrated, Lab or ICC space as a struct; value is its name or array, about what the array's second item refers to. Null for others."""
    kind = F.coalesce(F.try_variant_get(value, "$.n", "string"), F.try_variant_get(value, "$[0].n", "string"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("G", "DeviceGray", "RGB", "DeviceRGB", "CMYK", "DeviceCMYK")]), kind), kind)
    icc = F.try_variant_get(about, "$.N", "int")
    device = F.when(icc == 1, "DeviceGray").when(icc == 3, "DeviceRGB").when(icc == 4, "DeviceCMYK")
    name = F.when(kind == "ICCBased", F.coalesce(device, F.try_variant_get(about, "$.Alternate.n", "string"))).otherwise(kind)
    parts = F.try_element_at(F.create_map(*[F.lit(x) for pair in (SPACES | CIE).items() for x in pair]), name)
    numbers = lambda k, *default: F.coalesce(F.try_variant_get(about, f"$.{k}", "array<double>"), F.array(*[F.lit(float(d)) for d in default]))
    gamma = F.coalesce(F.try_variant_get(about, "$.Gamma", "array<double>"), F.array(*[F.coalesce(F.try_variant_get(about, "$.Gamma", "double"), F.lit(1.0))] * 3))
    made = F.struct(name.alias("kind"), parts.alias("parts"), numbers("WhitePoint", 1, 1, 1).alias("white"), gamma.alias("gamma"), numbers("Matrix", 1, 0, 0, 0, 1, 0, 0, 0, 1).alias("matrix"), numbers("Range", -100, 100, -100, 100).alias("range"))
    return F.when(parts.isNotNull(), made).cast(_SIMPLE)


def colour_spaces(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (doc_id, scope, key, value) of colour spaces with space: STRUCT<kind, inputs, base, high, table, tint, samples>.

    base is the simple space that colours come out in. Indexed spaces have a table of bytes up to an entry `high`; Separation and DeviceN with one colorant have
    a tint function of types 2 or 3, or samples of 8 bits. A space that can't be told has none.
    """
    rows = follow(entries.select("doc_id", "scope", "key", "value"), objects, "value").drop("value_num")
    kind = F.coalesce(F.try_variant_get("value", "$.n", "string"), F.try_variant_get("value", "$[0].n", "string"))
    rows = rows.withColumns({"kind": kind, **{f"item{i}": F.try_variant_get("value", f"$[{i}]", "variant") for i in (1, 2, 3)}})
    for i in (1, 2, 3):
        rows = follow(rows, objects, f"item{i}")
    rows = materialize(rows.drop("item1_num", "item2_num"))
    # Spaces that others are built on may have a dictionary or profile of their own.
    under = F.when(F.col("kind").isin("Indexed", "Pattern"), F.col("item1")).when(F.col("kind").isin("Separation", "DeviceN"), F.col("item2"))
    based = follow(rows.withColumn("under", under).withColumn("about", F.try_variant_get("under", "$[1]", "variant")), objects, "about").drop("about_num")
    based = based.withColumn("base", F.coalesce(_simple("value", "item1"), _simple("under", "about")))
    streams = objects.where("data is not null").select("doc_id", F.col("obj_num").alias("item3_num"), "data")
    based = materialize(based.join(streams, ["doc_id", "item3_num"], "left"))

    tints = based.where(F.col("kind").isin("Separation", "DeviceN")).select("doc_id", F.struct("scope", "key").alias("key"), F.col("item3").alias("f"))
    tints = functions_of(objects, tints, "f").where("parts is not null").select("doc_id", "key.*", F.struct("parts", "bounds", "encode", "span").cast(_TINT).alias("tint"))
    joined = based.join(tints, ["doc_id", "scope", "key"], "left")
    get = lambda k, t: F.try_variant_get("item3", f"$.{k}", t)
    sampled = (get("FunctionType", "int") == 0) & (F.size(get("Size", "array<int>")) == 1) & (get("BitsPerSample", "int") == 8)
    samples = F.when(sampled, F.struct(F.col("data"), F.get(get("Size", "array<int>"), 0), F.coalesce(get("Domain", "array<double>"), F.array(F.lit(0.0), F.lit(1.0))), get("Range", "array<double>"))).cast(_SAMPLES)
    inputs = F.when(F.col("kind").isin("Indexed", "Separation"), 1).when(F.col("kind") == "DeviceN", F.size(F.try_variant_get("item1", "$", "array<variant>"))).otherwise(F.col("base.parts"))
    table = F.when(F.col("kind") == "Indexed", F.coalesce(F.unhex(F.try_variant_get("item3", "$.s", "string")), F.col("data")))
    space = F.struct(F.col("kind"), inputs.alias("inputs"), F.col("base"), F.when(F.col("kind") == "Indexed", F.try_variant_get("item2", "$", "int")).alias("high"), table.alias("table"), F.col("tint"), samples.alias("samples"))
    return joined.select("doc_id", "scope", "key", space.alias("space"))


def graphics_states(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (doc_id, scope, key, value) of graphics states with state: STRUCT<width, cap, join, miter, dash, phase, stroke_alpha, fill_alpha, blend, mask>; what a dictionary doesn't set is null.

    mask is a soft mask's kind and group, of which "None" ends one that is in force.
    """
    rows = follow(entries.select("doc_id", "scope", "key", "value"), objects, "value").drop("value_num")
    rows = follow(rows.withColumn("soft", F.try_variant_get("value", "$.SMask", "variant")), objects, "soft")
    get = lambda k, t: F.try_variant_get("value", f"$.{k}", t)
    unit = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    style = lambda k: F.when(get(k, "int").between(0, 2), get(k, "int"))
    mask = F.struct(F.coalesce(F.try_variant_get("soft", "$.n", "string"), F.try_variant_get("soft", "$.S.n", "string")).alias("kind"), ref(F.col("soft"), "$.G").alias("group"))
    dash = F.filter(get("D[0]", "array<double>"), lambda d: d >= 0)
    state = F.struct(
        get("LW", "double").alias("width"), style("LC").alias("cap"), style("LJ").alias("join"), get("ML", "double").alias("miter"), dash.alias("dash"), F.when(dash.isNotNull(), F.coalesce(get("D[1]", "double"), F.lit(0.0))).alias("phase"),
        unit(get("CA", "double")).alias("stroke_alpha"), unit(get("ca", "double")).alias("fill_alpha"), F.coalesce(get("BM.n", "string"), get("BM[0].n", "string")).alias("blend"), F.when(mask["kind"].isNotNull(), mask).alias("mask"),
    )
    return rows.select("doc_id", "scope", "key", state.alias("state"))


def paint_scopes(objects: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, scope, states, patterns), and (doc_id, scope, key, space): what each scope of resources calls by name.

    states maps names to graphics states, patterns names to object numbers of patterns and of shadings ("sh " before their names).
    """
    entries = materialize(resource_entries(objects, leaves, ("ExtGState", "ColorSpace", "Pattern", "Shading")))
    of = lambda section: entries.where(F.col("section") == section)
    gathered = lambda rows, value, name: rows.groupBy("doc_id", "scope").agg(F.map_from_entries(F.collect_list(F.struct("key", value))).alias(name))
    prefix = F.when(F.col("section") == "Shading", "sh ").otherwise("")
    numbers = entries.where(F.col("section").isin("Pattern", "Shading")).select("doc_id", "scope", F.concat(prefix, "key").alias("key"), ref(F.col("value"), "$").alias("obj_num")).where("obj_num is not null")
    maps = gathered(graphics_states(objects, of("ExtGState")), "state", "states").join(gathered(numbers, "obj_num", "patterns"), ["doc_id", "scope"], "full")
    return materialize(maps), materialize(colour_spaces(objects, of("ColorSpace")))


def _cie(base: Column, v: Column) -> Column:
    """#rrggbb of the values of a calibrated or Lab space."""
    at = lambda i: F.get(v, F.lit(i))
    white, gamma = [base["white"][i] for i in range(3)], [base["gamma"][i] for i in range(3)]
    inside = lambda x, low, high: F.least(F.greatest(x, low), high)
    ranged = lambda x, i: inside(x, base["range"][i], base["range"][i + 1])
    kind = base["kind"]
    grey, rgb = colour.cal_gray(at(0), white, gamma[0]), colour.cal_rgb(at(0), at(1), at(2), gamma, [base["matrix"][i] for i in range(9)])
    made = F.when(kind == "CalGray", grey).when(kind == "CalRGB", rgb).otherwise(colour.lab(inside(at(0), F.lit(0.0), F.lit(100.0)), ranged(at(1), 0), ranged(at(2), 2), white))
    return colour.bound(made, lambda c: F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c[k]), 2, "0") for k in "rgb"])))


def _byte(data: Column, at: Column) -> Column:
    """A byte of binary data, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("double")


def _looked_up(space: Column, index: Column) -> Column:
    """The base's values that an index stands for; bytes that a table lacks count as zero."""
    base, n = space["base"], space["base"]["parts"]
    place = F.least(F.greatest(F.floor(index + 0.5), F.lit(0)), space["high"]).cast("int")
    unit = colour.bound(place, lambda i: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(_byte(space["table"], i * n + k), F.lit(0.0)) / 255))
    # Of Lab, the first value goes up to 100 and the others over their ranges.
    wide = F.concat(F.array(F.lit(0.0), F.lit(100.0)), base["range"])
    lab = lambda u: F.transform(u, lambda x, k: F.get(wide, 2 * k) + x * (F.get(wide, 2 * k + 1) - F.get(wide, 2 * k)))
    return colour.bound(unit, lambda u: F.when(base["kind"] == "Lab", lab(u)).otherwise(u))


def _sampled(samples: Column, outputs: Column, t: Column) -> Column:
    """The outputs of a sampled function of one input, linear between samples."""
    d0, d1 = samples["span"][0], samples["span"][1]
    last = samples["size"] - 1

    def output(at: Column, k: Column) -> Column:
        low = F.floor(at).cast("int")
        u = _byte(samples["data"], low * outputs + k) * (1 - (at - low)) + _byte(samples["data"], F.least(low + 1, last) * outputs + k) * (at - low)
        r0, r1 = F.coalesce(F.get(samples["range"], 2 * k), F.lit(0.0)), F.coalesce(F.get(samples["range"], 2 * k + 1), F.lit(1.0))
        return r0 + u / 255 * (r1 - r0)

    place = F.when(d1 > d0, (F.least(F.greatest(t, d0), d1) - d0) / (d1 - d0) * last).otherwise(0.0)
    return colour.bound(place, lambda at: F.transform(F.sequence(F.lit(0), outputs - 1), lambda k: output(at, k)))


def paint_colours(used: DataFrame, spaces: DataFrame) -> DataFrame:
    """used (doc_id, scope, key, values) with colour, #rrggbb of these values in the space that the key names; without values its first colour.

    Null where the space can't be told or the values aren't enough. The kinds of spaces are computed apart, each by a small expression.
    """
    s, names = F.col("space"), ["doc_id", "scope", "key", "values"]
    same = lambda x: F.transform(F.sequence(F.lit(1), s["inputs"]), lambda _: F.lit(x))
    black = F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    tinted = s["kind"].isin("Separation", "DeviceN")
    first = F.when(tinted, same(1.0)).when((s["kind"] != "Indexed") & (s["base"]["kind"] == "DeviceCMYK"), black).otherwise(same(0.0))
    known = used.join(spaces, ["doc_id", "scope", "key"]).where((s["inputs"] > 0) & s["base"].isNotNull())
    known = materialize(known.withColumn("v", F.coalesce("values", first)).where(F.size("v") >= s["inputs"]))
    t = F.get("v", F.lit(0))
    single = known.where(tinted & (s["inputs"] == 1))
    parts = (
        (known.where(~tinted & (s["kind"] != "Indexed")), F.col("v")),
        (known.where(s["kind"] == "Indexed"), _looked_up(s, t)),
        (single.where(s["tint"].isNotNull()), function_at(t, lambda k: s["tint"][k])),
        (single.where(s["tint"].isNull() & s["samples"].isNotNull()), _sampled(s["samples"], s["base"]["parts"], t)),
    )
    based = None
    for rows, value in parts:
        more = rows.select(*names, s["base"].alias("base"), value.alias("w"))
        based = more if based is None else based.unionByName(more)
    based = materialize(based.where(F.size("w") >= F.col("base.parts")))
    cie = F.col("base.kind").isin(*CIE)
    shown = based.where(~cie).select(*names, hex_colour(F.col("w"), F.col("base.parts")).alias("colour")).unionByName(based.where(cie).select(*names, _cie(F.col("base"), F.col("w")).alias("colour")))
    return shown
