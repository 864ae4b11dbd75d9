"""Colour grading as column expressions over r, g, b in 0..1."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
LUMA = (0.2126, 0.7152, 0.0722)
HSL_CENTRES = {"red": 0.0, "orange": 30.0, "yellow": 60.0, "green": 120.0, "cyan": 180.0, "blue": 240.0, "purple": 270.0, "magenta": 300.0}
SLIDER = 50.0


class RGB(NamedTuple):
    r: Column
    g: Column
    b: Column


def rgb(prefix: str = "") -> RGB:
    return RGB(F.col(f"{prefix}r"), F.col(f"{prefix}g"), F.col(f"{prefix}b"))


def each(c: RGB, fn) -> RGB:
    return RGB(*[fn(v) for v in c])


def limit(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def luma(c: RGB) -> Column:
    return c.r * LUMA[0] + c.g * LUMA[1] + c.b * LUMA[2]


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = limit((x - lo) / (hi - lo))
    return t * t * (F.lit(3.0) - t * 2)


def fract(x: Column) -> Column:
    return x - F.floor(x)


def rgb_to_hsv(c: RGB) -> tuple[Column, Column, Column]:
    """Hue in turns, saturation, value."""
    top, low = F.greatest(*c), F.least(*c)
    d = top - low
    safe = F.nullif(d, F.lit(0.0))
    h = F.when(top == c.r, (c.g - c.b) / safe).when(top == c.g, (c.b - c.r) / safe + 2.0).otherwise((c.r - c.g) / safe + 4.0)
    return fract(F.coalesce(h, F.lit(0.0)) / 6.0), F.when(top > 0, d / top).otherwise(0.0), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> RGB:
    part = lambda k: v * ((limit(F.abs(fract(h + k) * 6 - 3) - 1) - 1) * s + 1)
    return RGB(part(1.0), part(2.0 / 3), part(1.0 / 3))


def exposure_rolloff(v: Column) -> Column:
    """Values above 0.8 ease towards 1."""
    return F.when(v <= 0.8, v).otherwise(F.tanh((v - 0.8) / 0.2) * 0.2 + 0.8)


def brilliance(c: RGB, b: Column) -> RGB:
    l = limit(luma(c))
    nl = l + b * (l * (F.lit(1.0) - l) * (F.lit(1.0) - l) * 0.6 - l * l * (F.lit(1.0) - l) * 0.4)
    o = each(c, lambda v: F.when(l > 1e-4, v * nl / l).otherwise(v + nl))
    l2 = luma(o)
    return each(o, lambda v: l2 + (v - l2) * (b * 0.15 + 1))


def _stage(df: DataFrame, c: RGB) -> DataFrame:
    return df.withColumns({"r": c.r, "g": c.g, "b": c.b})


def slider(name: str) -> Column:
    return F.coalesce(F.col(f"grade.{name}"), F.lit(0.0)) / SLIDER


def grade_pixels(pixels: DataFrame, hsl: bool = False, wheels: bool = False) -> DataFrame:
    """Apply the ``grade`` struct of each row to its r, g, b: exposure, brightness, contrast, highlights and
    shadows, brilliance, white balance, wheels and gamma, saturation and vibrance, clamp, HSL channels.

    Every stage is one projection; a neutral slider leaves the colour as it is."""
    raw = lambda n: F.coalesce(F.col(f"grade.{n}"), F.lit(0.0))
    gain = F.pow(F.lit(2.0), slider("exposure") * 3)
    primary = (raw("exposure") != 0) | (raw("brightness") != 0) | (raw("contrast") != 0)

    def expose(v: Column) -> Column:
        e = v * gain
        e = F.when(gain > 1, exposure_rolloff(e)).otherwise(e)
        return F.when(primary, (e + slider("brightness") * 0.5 - 0.5) * (slider("contrast") + 1) + 0.5).otherwise(v)

    df = _stage(pixels, each(rgb(), expose))
    df = df.withColumn("_l", luma(rgb()))
    add = slider("highlights") * 0.5 * smoothstep(0.5, 1.0, F.col("_l")) + slider("shadows") * 0.5 * (F.lit(1.0) - smoothstep(0.0, 0.5, F.col("_l")))
    df = _stage(df, each(rgb(), lambda v: v + add))
    lit = brilliance(rgb(), slider("brilliance"))
    df = _stage(df, RGB(*[F.when(raw("brilliance") != 0, n).otherwise(o) for n, o in zip(lit, rgb())]))
    t, tint = slider("temperature"), slider("tint")
    c = rgb()
    df = _stage(df, RGB(c.r + t * 0.12 + tint * 0.05, c.g - tint * 0.1, c.b - t * 0.12 + tint * 0.05))
    if wheels:
        at = lambda name, i: F.coalesce(F.get(F.col(f"grade.{name}"), i), F.lit(0.0))
        turned = [v * (at("gain", i) + 1) + at("lift", i) * (F.lit(1.0) - v) + at("offset", i) for i, v in enumerate(rgb())]
        power = [F.lit(1.0) / F.greatest(at("gamma", i) + 1, F.lit(0.05)) for i in range(3)]
        df = _stage(df, RGB(*[F.pow(F.greatest(v, F.lit(0.0)), p) for v, p in zip(turned, power)]))
    else:
        df = _stage(df, each(rgb(), lambda v: F.greatest(v, F.lit(0.0))))
    df = df.withColumn("_l", luma(rgb()))
    l = F.col("_l")
    d = each(rgb(), lambda v: v - l)
    chroma = F.sqrt(d.r * d.r + d.g * d.g + d.b * d.b)
    k = slider("saturation") + slider("vibrance") * (F.lit(1.0) - limit(chroma * 1.5)) + 1
    df = _stage(df.withColumn("_k", k), each(rgb(), lambda v: limit(l + (v - l) * F.col("_k"))))
    if hsl:
        h, s, v = rgb_to_hsv(rgb())
        df = df.withColumns({"_h": h, "_s": s, "_v": v})
        deg = F.col("_h") * 360

        def pull(part: str) -> Column:
            total = F.lit(0.0)
            for name, centre in HSL_CENTRES.items():
                gap = F.abs(deg - centre)
                w = F.lit(1.0) - smoothstep(0.0, 35.0, F.least(gap, F.lit(360.0) - gap))
                total = total + F.coalesce(F.col("grade.hsl")[name][part], F.lit(0.0)) / 100 * w
            return total * smoothstep(0.0, 0.25, F.col("_s"))

        df = df.withColumns({"_dh": pull("h"), "_ds": pull("s"), "_dl": pull("l")})
        moved = hsv_to_rgb(fract(F.col("_h") + F.col("_dh") * (30.0 / 360)), limit(F.col("_s") * (F.col("_ds") + 1)), limit(F.col("_v") * (F.col("_dl") * 0.5 + 1)))
        df = _stage(df, moved)
    return df.drop("_l", "_k", "_h", "_s", "_v", "_dh", "_ds", "_dl")


def vignette(c: RGB, u: Column, v: Column, amount: Column) -> RGB:
    edge = F.lit(1.0) - smoothstep(0.35, 1.1, F.hypot(u - 0.5, v - 0.5) * 1.35)
    return each(c, lambda x: x * ((edge - 1) * amount + 1))


def grain(c: RGB, u: Column, v: Column, time_ms: Column, amount: Column) -> RGB:
    t = fract(time_ms * 0.001) * 100
    n = fract(F.sin((u * 1024 + t) * 12.9898 + (v * 1024 + t) * 78.233) * 43758.547) - 0.5
    return each(c, lambda x: limit(x + n * amount * 0.25))


# --------------------------------------------------------------------------- monotone curves


def monotone_tangents(points: Column) -> Column:
    """array<struct<x,y>> sorted by x -> array<struct<x,y,m>> with Fritsch-Carlson tangents.

    The limiter walks the segments once, so it is a fold over the (short) point array."""
    n = F.size(points)
    at = lambda a, i: F.get(a, i)
    secant = F.transform(F.sequence(F.lit(0), n - 2), lambda i: (at(points, i + 1)["y"] - at(points, i)["y"]) / F.nullif(at(points, i + 1)["x"] - at(points, i)["x"], F.lit(0.0)))

    def build(d: Column) -> Column:
        start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, at(d, F.lit(0))).when(i == n - 1, at(d, n - 2)).when(
            at(d, i - 1) * at(d, i) <= 0, 0.0).otherwise((at(d, i - 1) + at(d, i)) / 2))

        def walk(m: Column, i: Column) -> Column:
            di, a, b = at(d, i), at(m, i) / F.nullif(at(d, i), F.lit(0.0)), at(m, i + 1) / F.nullif(at(d, i), F.lit(0.0))
            s = a * a + b * b
            tau = F.lit(3.0) / F.sqrt(s)
            return F.transform(m, lambda v, j: F.when(di == 0, F.when((j == i) | (j == i + 1), 0.0).otherwise(v)).when(
                s > 9, F.when(j == i, tau * a * di).when(j == i + 1, tau * b * di).otherwise(v)).otherwise(v))

        return F.aggregate(F.sequence(F.lit(0), n - 2), start, walk)

    m = F.element_at(F.transform(F.array(secant), build), 1)
    return F.when(n >= 2, F.zip_with(points, m, lambda p, t: F.struct(p["x"].alias("x"), p["y"].alias("y"), t.alias("m")))).otherwise(
        F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("m"))))


def hermite_at(prepared: Column, x: Column, lo: float, hi: float) -> Column:
    """Value of a prepared curve at x, held outside, clamped to lo..hi."""
    first, last = F.element_at(prepared, 1), F.element_at(prepared, -1)
    left = F.try_element_at(F.filter(prepared, lambda p: p["x"] <= x), F.lit(-1))
    right = F.try_element_at(F.filter(prepared, lambda p: p["x"] > x), F.lit(1))

    def mix(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        h = b["x"] - a["x"]
        u = (x - a["x"]) / h
        y = (u * u * u * 2 - u * u * 3 + 1) * a["y"] + (u * u * u - u * u * 2 + u) * h * a["m"] + (u * u * 3 - u * u * u * 2) * b["y"] + (u * u * u - u * u) * h * b["m"]
        return F.least(F.greatest(y, F.lit(lo)), F.lit(hi))

    inside = F.element_at(F.transform(F.array(F.struct(left.alias("a"), right.alias("b"))), mix), 1)
    return F.when(x <= first["x"], first["y"]).when(x >= last["x"], last["y"]).otherwise(inside)


def eval_curve(points: Column, x: Column) -> Column:
    return F.when(F.size(points) == 0, x).otherwise(hermite_at(monotone_tangents(points), x, 0.0, 1.0))


def is_identity_curve(points: Column) -> Column:
    return F.forall(points, lambda p: F.abs(p["x"] - p["y"]) < 1e-6)


# --------------------------------------------------------------------------- blending and masks


def _soft(cb: Column) -> Column:
    return F.when(cb <= 0.25, ((cb * 16 - 12) * cb + 4) * cb).otherwise(F.sqrt(cb))


def blend_channel(mode: Column, cb: Column, cs: Column) -> Column:
    """Blend of source ``cs`` over backdrop ``cb``; unknown modes are normal."""
    two = cb * 2 - 1
    return (F.when(mode == "multiply", cb * cs).when(mode == "screen", cb + cs - cb * cs)
            .when(mode == "overlay", F.when(cb <= 0.5, cb * cs * 2).otherwise(two + cs - two * cs))
            .when(mode == "softLight", F.when(cs <= 0.5, cb - (F.lit(1.0) - cs * 2) * cb * (F.lit(1.0) - cb)).otherwise(cb + (cs * 2 - 1) * (_soft(cb) - cb)))
            .when(mode == "darken", F.least(cb, cs)).when(mode == "lighten", F.greatest(cb, cs))
            .when(mode == "colorDodge", F.when(cb <= 0, 0.0).when(cs >= 1, 1.0).otherwise(F.least(F.lit(1.0), cb / F.nullif(F.lit(1.0) - cs, F.lit(0.0))))).otherwise(cs))


def mask_weight(shape: Column, x: Column, y: Column, w: Column, h: Column, feather: Column, inverted: Column, u: Column, v: Column) -> Column:
    """Coverage 0..1 of a mask at canvas position (u, v), origin top left."""
    f = F.greatest(feather, F.lit(0.0005))
    step = lambda width, value: (lambda t: F.lit(1.0) - t * t * (F.lit(3.0) - t * 2))(limit(value / width))
    cx, cy = x + w * 0.5, y + h * 0.5
    dx, dy = F.abs(u - cx) - w * 0.5, F.abs(v - cy) - h * 0.5
    ring = F.hypot((u - cx) / F.greatest(w * 0.5, F.lit(1e-4)), (v - cy) / F.greatest(h * 0.5, F.lit(1e-4))) - 1
    out = F.when(shape == "circle", step(f * 2, ring)).when(shape == "split", step(f, u - x)).when(shape == "filmstrip", step(f, dy)).otherwise(step(f, F.greatest(dx, dy)))
    return F.when(inverted, F.lit(1.0) - out).otherwise(out)
