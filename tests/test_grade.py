"""The HSL stage of the grade against a plain loop."""

import colorsys

import numpy as np

from mediaframe.functions import color

SLIDERS = ("exposure", "brightness", "contrast", "highlights", "shadows", "brilliance", "temperature", "tint", "saturation", "vibrance")


def _ramp(lo, hi, x):
    t = min(1.0, max(0.0, (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def _want(rgb, hsl):
    h, s, v = colorsys.rgb_to_hsv(*rgb)
    moved = {"h": 0.0, "s": 0.0, "l": 0.0}
    for name, centre in color.HSL_CENTRES.items():
        gap = abs(h * 360 - centre)
        near = (1 - _ramp(0, 35, min(gap, 360 - gap))) * _ramp(0, 0.25, s)
        for part in moved:
            moved[part] += hsl[name][part] / 100 * near
    one = lambda x: min(1.0, max(0.0, x))
    return colorsys.hsv_to_rgb((h + moved["h"] * 30 / 360) % 1, one(s * (1 + moved["s"])), one(v * (1 + moved["l"] / 2)))


def test_hsl_channels(spark):
    rng = np.random.default_rng(21)
    pixels = [*map(tuple, rng.random((300, 3)).tolist()), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.5, 0.5), (1.0, 0.0, 0.0)]
    neutral = {n: {"h": 0.0, "s": 0.0, "l": 0.0} for n in color.HSL_CENTRES}
    turned = {n: {p: float(rng.integers(-100, 101)) for p in "hsl"} for n in color.HSL_CENTRES}
    parts = ", ".join(f"{n}: struct<h: double, s: double, l: double>" for n in color.HSL_CENTRES)
    schema = f"id bigint, r double, g double, b double, grade struct<{', '.join(f'{n}: double' for n in SLIDERS)}, hsl: struct<{parts}>>"
    for hsl in (neutral, turned):
        df = spark.createDataFrame([(i, *p, {**dict.fromkeys(SLIDERS), "hsl": hsl}) for i, p in enumerate(pixels)], schema)
        got = {r.id: (r.r, r.g, r.b) for r in color.grade_pixels(df, hsl=True).collect()}
        assert len(got) == len(pixels)
        for i, p in enumerate(pixels):
            assert np.allclose(got[i], p if hsl is neutral else _want(p, hsl), atol=1e-9)
