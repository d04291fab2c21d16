"""Gradients: axial and radial shadings with the colours along them, by joins and column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirel.functions import colour
from quirel.plans.stages import materialize

from .pages import follow

#: Colours that a gradient is given as, and components of the device spaces.
STOPS, SPACES = 64, {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}

_PART = "struct<n:double,c0:array<double>,c1:array<double>>"


def _clamped(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _part(value: str) -> Column:
    """A function of type 2 as its exponent and ends; null for another one."""
    get = lambda k, kind: F.try_variant_get(value, f"$.{k}", kind)
    made = F.struct(F.coalesce(get("N", "double"), F.lit(1.0)).alias("n"), F.coalesce(get("C0", "array<double>"), F.array(F.lit(0.0))).alias("c0"), F.coalesce(get("C1", "array<double>"), F.array(F.lit(1.0))).alias("c1"))
    return F.when(get("FunctionType", "int") == 2, made).cast(_PART)


def _between(part: Column, x: Column) -> Column:
    """c0 + x ** n * (c1 - c0) of each output."""
    return F.zip_with(part["c0"], part["c1"], lambda a, b: a + F.pow(x, part["n"]) * (b - a))


def functions_of(objects: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """rows (key, doc_id, `column` VARIANT) with parts, bounds, encode and span: a function of type 2, or of type 3 over such, as one table of parts."""
    top = follow(rows, objects, column)
    kids = top.select("doc_id", "key", F.posexplode(F.try_variant_get(column, "$.Functions", "array<variant>")).alias("place", "kid"))
    kids = follow(kids, objects, "kid").withColumn("part", _part("kid"))
    held = kids.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("kids"), F.count("part").alias("good"), F.count("*").alias("all"))
    numbers = lambda k: F.try_variant_get(column, f"$.{k}", "array<double>")
    joined = top.join(held, ["doc_id", "key"], "left")
    single = F.when(_part(column).isNotNull(), F.array(_part(column)))
    several = F.when((F.try_variant_get(column, "$.FunctionType", "int") == 3) & (F.col("good") == F.col("all")), F.transform("kids", lambda k: k["part"]))
    return joined.withColumns({"parts": F.coalesce(single, several), "bounds": F.coalesce(numbers("Bounds"), F.array().cast("array<double>")), "encode": F.coalesce(numbers("Encode"), F.array().cast("array<double>")), "span": F.coalesce(numbers("Domain"), F.array(F.lit(0.0), F.lit(1.0)))}).drop("kids", "good", "all")


def function_at(t: Column, held=F.col) -> Column:
    """The outputs at t of the function in parts, bounds, encode and span: the part whose interval holds t, on t in that part's own inputs.

    held gives these four by name: columns, or fields of a struct.
    """
    parts, bounds, encode, span = (held(k) for k in ("parts", "bounds", "encode", "span"))
    edges = F.concat(F.array(F.get(span, 0)), bounds, F.array(F.get(span, 1)))

    def within(x: Column, i: Column) -> Column:
        low, high = F.get(edges, i), F.get(edges, i + 1)
        span_of = F.struct(low.alias("low"), high.alias("high"), F.coalesce(F.get(encode, 2 * i), low).alias("e0"), F.coalesce(F.get(encode, 2 * i + 1), high).alias("e1"))
        moved = colour.bound(span_of, lambda e: F.when(e["high"] > e["low"], e["e0"] + (x - e["low"]) / (e["high"] - e["low"]) * (e["e1"] - e["e0"])).otherwise(e["e0"]))
        return colour.bound(moved, lambda m: _between(F.get(parts, i), m))

    inside = F.least(F.greatest(t, F.get(span, 0)), F.get(span, 1))
    return colour.bound(inside, lambda x: colour.bound(F.least(F.size(F.filter(bounds, lambda b: b <= x)), F.size(parts) - 1), lambda i: within(x, i)))


def hex_colour(c: Column, components: Column) -> Column:
    """A colour of a device space as #rrggbb."""
    byte = lambda v: F.lpad(F.hex(F.floor(_clamped(v) * 255 + 0.5).cast("int")), 2, "0")
    ink = lambda i: 1 - F.least(F.get(c, i) + F.get(c, 3), F.lit(1.0))
    parts = [F.when(components == 1, F.get(c, 0)).when(components == 4, ink(i)).otherwise(F.get(c, i)) for i in range(3)]
    return F.lower(F.concat(F.lit("#"), *[byte(p) for p in parts]))


def gradients(objects: DataFrame, stops: int = STOPS) -> DataFrame:
    """(doc_id, obj_num, kind, coords, extend, components, stops): axial and radial shadings in device spaces with their colours along the domain.

    A shading that is a pattern's own is listed under the pattern. Functions are of type 2, or of type 3 over those, one for all components or one
    for each; others have no stops.
    """
    get = lambda k, kind: F.try_variant_get("value", f"$.{k}", kind)
    inline = objects.where(get("Shading.ShadingType", "int").isNotNull()).select("doc_id", "obj_num", get("Shading", "variant").alias("value"))
    found = objects.where(get("ShadingType", "int").isNotNull()).select("doc_id", "obj_num", "value").unionByName(inline).where(get("ShadingType", "int").isin(2, 3))
    space = F.create_map(*[F.lit(x) for pair in SPACES.items() for x in pair])
    found = materialize(found.select("doc_id", "obj_num", F.when(get("ShadingType", "int") == 2, "axial").otherwise("radial").alias("kind"), get("Coords", "array<double>").alias("coords"), F.coalesce(get("Extend", "array<boolean>"), F.array(F.lit(False), F.lit(False))).alias("extend"), F.try_element_at(space, get("ColorSpace.n", "string")).alias("components"), F.coalesce(get("Domain", "array<double>"), F.array(F.lit(0.0), F.lit(1.0))).alias("domain"), get("Function", "variant").alias("function")))
    several = F.try_variant_get("function", "$", "array<variant>")
    each = found.select("doc_id", "obj_num", "domain", F.posexplode(F.coalesce(several, F.array("function"))).alias("place", "f"))
    known = materialize(functions_of(objects, each.withColumn("key", F.struct("obj_num", "place")), "f").where("parts is not null").select("doc_id", "obj_num", "place", "domain", "parts", "bounds", "encode", "span"))
    values = known.select("doc_id", "obj_num", "place", colour.gradient_stops(function_at, (F.get("domain", 0), F.get("domain", 1)), stops).alias("values"))
    rows = values.groupBy("doc_id", "obj_num").agg(F.array_sort(F.collect_list(F.struct("place", "values"))).alias("f"))
    # Several functions give a component each.
    whole = rows.select("doc_id", "obj_num", F.transform(F.sequence(F.lit(0), F.lit(stops - 1)), lambda k: F.flatten(F.transform("f", lambda f: F.get(f["values"], k)))).alias("colours"))
    joined = found.join(whole, ["doc_id", "obj_num"], "left")
    good = F.col("components").isNotNull() & F.forall("colours", lambda c: F.size(c) >= F.col("components"))
    return joined.select("doc_id", "obj_num", "kind", "coords", "extend", "components", F.when(good, F.transform("colours", lambda c: hex_colour(c, F.col("components")))).alias("stops"))
