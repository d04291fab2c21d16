"""Functions given by samples against plain loops; gradients and radio groups in odd shapes."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quirel.functions import colour
from quirel.operators import catalogue as C
from quirel.operators import shadings
from quirel.sources import objects as O
from quirel.sources import writer as W


def weights(e, size, order):
    """Samples around a place with what each counts."""
    i = math.floor(e)
    t = e - i
    if order == 3 and size >= 4:
        found = [(i - 1, -0.5 * t + t * t - 0.5 * t**3), (i, 1 - 2.5 * t * t + 1.5 * t**3), (i + 1, 0.5 * t + 2 * t * t - 1.5 * t**3), (i + 2, -0.5 * t * t + 0.5 * t**3)]
    else:
        found = [(i, 1 - t), (i + 1, t)]
    return [(min(max(k, 0), size - 1), w) for k, w in found]


def plain(xs, samples, sizes, domains, ranges, encode, decode, order):
    axes = []
    for x, (a, b), (c, d), n in zip(xs, domains, encode, sizes):
        x = min(max(x, a), b)
        axes.append(weights(min(max(c + (x - a) * (d - c) / (b - a), 0), n - 1), n, order))
    out = []
    for j, (low, high) in enumerate(ranges):
        total = 0.0
        for taps in itertools.product(*axes):
            flat = sum(k * math.prod(sizes[:i]) for i, (k, _) in enumerate(taps))
            total += math.prod(w for _, w in taps) * samples[flat * len(ranges) + j]
        total = decode[j][0] + total * (decode[j][1] - decode[j][0])
        out.append(min(max(total, low), high))
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_samples_in_several_dimensions(spark, order):
    rng = random.Random(order)
    sizes, domains, ranges = [5, 2, 4], [(0, 1), (-1, 1), (0, 10)], [(0, 1), (-3, 3)]
    encode, decode = [(0, 4), (1, 0), (0, 3)], [(0, 1), (-4, 4)]
    samples = [rng.random() for _ in range(math.prod(sizes) * 2)]
    points = [tuple(rng.uniform(a - 0.2, b + 0.2) for a, b in domains) for _ in range(60)] + [(0.0, -1.0, 0.0), (1.0, 1.0, 10.0), (0.25, 0.0, 3.5)]
    made = colour.sampled_nd([F.col(c) for c in "xyz"], F.array(*map(F.lit, samples)), sizes, domains, ranges, encode, decode, order)
    found = spark.createDataFrame(points, "x double, y double, z double").select("x", "y", "z", made.alias("v")).collect()
    for r in found:
        assert r.v == pytest.approx(plain((r.x, r.y, r.z), samples, sizes, domains, ranges, encode, decode, order), abs=1e-9)


def objects_of(spark, bodies):
    return O.read_objects(W.assemble(spark.createDataFrame([(1, n, b) for n, b in bodies.items()], "doc_id long, obj_num int, body string"))).checkpoint()


def test_gradients_of_odd_shapes(spark):
    two = "<< /FunctionType 2 /N 1 /C0 [0 0 0 0] /C1 [1 0 0 0.5] >>"
    bodies = {
        1: "<< /Type /Catalog >>",
        2: f"<< /ShadingType 2 /ColorSpace /DeviceCMYK /Coords [0 0 1 1] /Domain [0 2] /Function {two} >>",
        3: "<< /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 1] /Function << /FunctionType 4 >> >>",
        4: "<< /ShadingType 3 /ColorSpace /Other /Coords [0 0 1 1 1 1] /Function 6 0 R >>",
        5: "<< /ShadingType 2 /ColorSpace /DeviceGray /Coords [0 0 1 1] /Function << /FunctionType 3 /Domain [0 1] /Bounds [0.25 0.5] /Encode [0 1 0 1 0 1] /Functions [6 0 R 7 0 R 6 0 R] >> >>",
        6: "<< /FunctionType 2 /N 1 >>",
        7: "<< /FunctionType 2 /N 1 /C0 [0.5] /C1 [0.5] >>",
        8: "<< /ShadingType 4 /ColorSpace /DeviceRGB >>",
    }
    found = {r.obj_num: r for r in shadings.gradients(objects_of(spark, bodies), 3).collect()}
    assert set(found) == {2, 3, 4, 5} and found[3].stops is None and found[4].stops is None and found[4].kind == "radial"
    # Behind its own domain the function of the first is at its end from the middle on.
    assert found[2].stops == ["#ffffff", "#008080", "#008080"] and found[5].stops == ["#000000", "#000000", "#ffffff"]


def test_radio_groups(spark):
    bodies = {
        1: "<< /Type /Catalog /OCProperties << /OCGs [11 0 R 12 0 R 13 0 R 14 0 R] /D << /OFF [12 0 R] /RBGroups [[11 0 R 12 0 R] [12 0 R 13 0 R] []] /Locked [14 0 R] >> /Configs [<< /BaseState /Unchanged /OFF 3 >>] >> >>",
        **{n: f"<< /Type /OCG /Name (g{n}) >>" for n in (11, 12, 13, 14)},
    }
    objects = objects_of(spark, bodies)
    configurations = C.layer_configurations(objects).checkpoint()
    assert [(r.config, r.base, r.radio) for r in configurations.orderBy("config").collect()] == [(0, "ON", [[11, 12], [12, 13]]), (1, "Unchanged", [])]
    states = C.layers_by_configuration(objects, configurations).checkpoint()
    show = lambda df, config: {r.obj_num: r.visible for r in df.where(F.col("config") == config).collect()}
    assert show(states, 0) == {11: True, 12: False, 13: True, 14: True} and set(show(states, 1).values()) == {True}
    picks = lambda *p: spark.createDataFrame([(1, 0, i, n, on) for i, (n, on) in enumerate(p)], "doc_id long, config int, seq long, obj_num long, on boolean")
    assert show(C.switched_layers(states, configurations, picks((12, True), (14, False))), 0) == {11: False, 12: True, 13: False, 14: True}
    assert show(C.switched_layers(states, configurations, picks((12, True), (11, True), (13, False), (13, True))), 0) == {11: True, 12: False, 13: True, 14: True}
