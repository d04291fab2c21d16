"""Colours, functions of one input and matrices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(value: Column) -> Column:
    """0 to 1 as a byte, halves away from zero."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    """(r, g, b) bytes: one minus the ink and the black, at most all of it."""
    return F.struct(*[channel(1 - F.least(x + k, F.lit(1.0))).alias(n) for n, x in (("r", c), ("g", m), ("b", y))])


def _encoded(linear: Column) -> Column:
    v = F.least(F.greatest(linear, F.lit(0.0)), F.lit(1.0))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def xyz(x: Column, y: Column, z: Column) -> Column:
    """(r, g, b) bytes of CIE coordinates. The sRGB primaries' inverse matrix."""
    rows = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
    return F.struct(*[channel(_encoded(a * x + b * y + c * z)).alias(n) for n, (a, b, c) in zip("rgb", rows)])


def cal_gray(a: Column, white: tuple[float, float, float], gamma: float = 1.0) -> Column:
    v = F.pow(F.greatest(a, F.lit(0.0)), F.lit(gamma))
    return xyz(v * white[0], v * white[1], v * white[2])


def cal_rgb(r: Column, g: Column, b: Column, gamma: tuple = (1.0, 1.0, 1.0), matrix: tuple = (1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0)) -> Column:
    p = [F.pow(F.greatest(x, F.lit(0.0)), F.lit(q)) for x, q in zip((r, g, b), gamma)]
    return xyz(*[sum((matrix[3 * i + k] * p[i] for i in range(3)), F.lit(0.0)) for k in range(3)])


def lab(lightness: Column, a: Column, b: Column, white: tuple[float, float, float]) -> Column:
    """The curve's knee at 6/29 and its slope 108/841."""
    m = (lightness + 16) / 116
    curve = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((t - 4 / 29) * (108 / 841))
    return xyz(curve(m + a / 500) * white[0], curve(m) * white[1], curve(m - b / 200) * white[2])


def indexed(table: Column, index: Column, high: int, channels: int = 3) -> Column:
    """Bytes of an entry of a binary table; the index is rounded and kept between 0 and high."""
    at = F.least(F.greatest(F.floor(index + 0.5), F.lit(0)), F.lit(high)).cast("int")
    return F.substring(table, at * channels + 1, F.lit(channels))


def separation(tint: Column, c0: list[float], c1: list[float], n: float = 1.0) -> Column:
    """A tint between 0 and 1 through an exponential function."""
    return exponential(F.least(F.greatest(tint, F.lit(0.0)), F.lit(1.0)), c0, c1, n)


def exponential(x: Column, c0: list[float], c1: list[float], n: float) -> Column:
    """Function type 2: c0 + x ** n * (c1 - c0) of each output."""
    return F.array(*[F.lit(a) + F.pow(x, F.lit(n)) * (b - a) for a, b in zip(c0, c1)])


def stitched(x: Column, domain: tuple[float, float], bounds: list[float], encode: list[float], parts: list) -> Column:
    """Function type 3: the part whose interval holds x, on x mapped to that part's inputs."""
    x = F.least(F.greatest(x, F.lit(domain[0])), F.lit(domain[1]))
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(parts))):
        low, high, e0, e1 = edges[i], edges[i + 1], encode[2 * i], encode[2 * i + 1]
        inner = F.lit(e0) if high == low else e0 + (x - low) * ((e1 - e0) / (high - low))
        value = parts[i](inner)
        out = value if out is None else F.when(x < high, value).otherwise(out)
    return out


def sampled(x: Column, samples: list[float], domain: tuple[float, float]) -> Column:
    """Function type 0 of one input and one output, linear between samples."""
    x = F.least(F.greatest(x, F.lit(domain[0])), F.lit(domain[1]))
    at = (x - domain[0]) / (domain[1] - domain[0]) * (len(samples) - 1)
    table, low = F.array(*[F.lit(float(s)) for s in samples]), F.floor(at)
    high = F.least(low + 1, F.lit(len(samples) - 1))
    return F.get(table, low.cast("int")) * (1 - (at - low)) + F.get(table, high.cast("int")) * (at - low)


def bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _taps(x: Column, domain: tuple[float, float], encode: tuple[float, float], size: int, order: int) -> Column:
    """Samples of an axis that x lies between, as an array of (at, weight): two, or four of a cubic through them where the axis has as many."""
    low, high = domain
    inside = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    place = F.lit(float(encode[0])) if high == low else encode[0] + (inside - low) * ((encode[1] - encode[0]) / (high - low))
    place = F.least(F.greatest(place, F.lit(0.0)), F.lit(float(size - 1)))
    tap = lambda at, weight: F.struct(F.least(F.greatest(at, F.lit(0)), F.lit(size - 1)).cast("int").alias("at"), weight.cast("double").alias("weight"))

    def around(e: Column) -> Column:
        first = F.floor(e)
        t = e - first
        if order != 3 or size < 4:
            return F.array(tap(first, 1 - t), tap(first + 1, t))
        # The cubic whose slope at a sample is that between its neighbours.
        cubic = ((-t + 2 * t * t - t * t * t) / 2, (2 - 5 * t * t + 3 * t * t * t) / 2, (t + 4 * t * t - 3 * t * t * t) / 2, (t * t * t - t * t) / 2)
        return F.array(*[tap(first + k - 1, w) for k, w in enumerate(cubic)])

    return bound(place, around)


def sampled_nd(xs: list[Column], samples: Column, sizes: list[int], domains: list[tuple[float, float]], ranges: list[tuple[float, float]], encode: list[tuple[float, float]] | None = None, decode: list[tuple[float, float]] | None = None, order: int = 1) -> Column:
    """Function type 0 of any inputs and outputs: an array of outputs.

    samples is an array of numbers from 0 to 1, those of one place together and the first input's places next to each other. Between places it is linear in
    each input, with order 3 cubic. Missing encodings are the whole of an axis, missing decodings the ranges.
    """
    outputs = len(ranges)
    taps = [_taps(x, d, encode[i] if encode else (0.0, n - 1.0), n, order) for i, (x, d, n) in enumerate(zip(xs, domains, sizes))]
    # One axis after another multiplies the places that take part: 2 or 4 to the power of the inputs, whatever the table's size.
    def crossed(places: Column, axis: Column, stride: int) -> Column:
        both = lambda p, t: F.struct((p["at"] + t["at"] * stride).alias("at"), (p["weight"] * t["weight"]).alias("weight"))
        return F.flatten(F.transform(places, lambda p: F.transform(axis, lambda t: both(p, t))))

    places, stride = taps[0], sizes[0]
    for axis, n in zip(taps[1:], sizes[1:]):
        places, stride = crossed(places, axis, stride), stride * n

    def output(j: int) -> Column:
        value = lambda p: F.aggregate(F.transform(p, lambda t: t["weight"] * F.get(samples, t["at"] * outputs + j)), F.lit(0.0), lambda total, v: total + v)
        low, high = decode[j] if decode else ranges[j]
        return F.least(F.greatest(low + value(places) * (high - low), F.lit(float(ranges[j][0]))), F.lit(float(ranges[j][1])))

    return F.array(*[output(j) for j in range(outputs)])


def gradient_stops(colour_at, domain: tuple[Column, Column], n: int = 64) -> Column:
    """An array of n colours, evenly over the domain from its first to its last value; colour_at(t) gives the colour of a value."""
    t0, t1 = domain
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: colour_at(t0 + (t1 - t0) * (k / F.lit(float(max(n - 1, 1))))))


def matrix(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip("abcdef", values)])


def compose(m: Column, n: Column) -> Column:
    """First m, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def invert(m: Column) -> Column:
    """Null where there is no inverse."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    back = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(det != 0, back)


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def arc_point(cx: Column, cy: Column, rx: Column, ry: Column, turn: Column, angle: Column) -> Column:
    """A point of an ellipse whose axes are turned; angles in radians."""
    x, y = rx * F.cos(angle), ry * F.sin(angle)
    return F.struct((cx + x * F.cos(turn) - y * F.sin(turn)).alias("x"), (cy + x * F.sin(turn) + y * F.cos(turn)).alias("y"))


def arc_cubics(cx: Column, cy: Column, rx: Column, ry: Column, turn: Column, start: Column, sweep: Column) -> Column:
    """An arc as cubic curves of a quarter turn at most: an array of (c1, c2, end)."""
    n = F.greatest(F.ceil(F.abs(sweep) / (3.141592653589793 / 2) - 1e-9), F.lit(1)).cast("int")
    step = sweep / n
    k = 4.0 / 3.0 * F.tan(step / 4)

    def curve(i: Column) -> Column:
        a, b = start + (i - 1) * step, start + i * step
        p, q = arc_point(cx, cy, rx, ry, turn, a), arc_point(cx, cy, rx, ry, turn, b)
        slope = lambda t: arc_point(F.lit(0.0), F.lit(0.0), rx, ry, turn, t + 3.141592653589793 / 2)
        move = lambda o, d, s: F.struct((o["x"] + s * k * d["x"]).alias("x"), (o["y"] + s * k * d["y"]).alias("y"))
        return F.struct(move(p, slope(a), 1).alias("c1"), move(q, slope(b), -1).alias("c2"), q.alias("end"))

    return F.transform(F.sequence(F.lit(1), n), curve)


def number_text(x: Column, places: int = 4) -> Column:
    """The shortest fixed decimal of a number."""
    fixed = F.regexp_replace(F.format_string(f"%.{places}f", x.cast("double")), r"\.?0+$", "")
    return F.when(F.round(x, places) == 0, "0").when(F.round(x, places) == F.floor(F.round(x, places)), F.format_string("%.0f", x.cast("double"))).otherwise(fixed)
