"""Speed curves: duration factors, and both directions of the time map of a ramp.

A curve is array<struct<x,y>> of (source position 0..1, speed). Tables are built once per distinct curve (a
few hundred grid points) and joined to the clips that use it. Where clips may each have a curve of their own, the ``curve_*``
columns build the same tables inside a batch, once per distinct curve of the batch: rows don't move."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions.color import hermite_at, monotone_tangents

SPEED_MIN, SPEED_MAX = 0.1, 10.0


def normalise(points: Column) -> Column:
    p = F.array_sort(F.transform(points, lambda q: F.struct(F.least(F.greatest(q["x"], F.lit(0.0)), F.lit(1.0)).alias("x"), F.least(F.greatest(q["y"], F.lit(SPEED_MIN)), F.lit(SPEED_MAX)).alias("y"))))
    return p


def speed_at(prepared: Column, t: Column) -> Column:
    """``prepared`` comes from :func:`monotone_tangents` of :func:`normalise`."""
    return hermite_at(prepared, t, SPEED_MIN, SPEED_MAX)


def is_uniform(points: Column) -> Column:
    return F.forall(points, lambda p: F.abs(p["y"] - F.element_at(points, 1)["y"]) < 1e-9)


def speed_lut(curves: DataFrame, samples: int = 256) -> DataFrame:
    """(curve_id, k, u, cum): output time per unit of source up to u = k / (samples - 1), by the trapezoid rule.

    curves: curve_id, points."""
    n = samples - 1
    grid = curves.withColumn("_p", monotone_tangents(normalise(F.col("points")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    g = grid.withColumn("u", F.col("k") / float(n)).withColumn("inv", F.lit(1.0) / speed_at(F.col("_p"), F.col("u")))
    w = Window.partitionBy("curve_id").orderBy("k")  # one row per grid point: `samples` rows per curve
    area = F.coalesce((F.lag("inv").over(w) + F.col("inv")) / (2.0 * n), F.lit(0.0))
    return g.withColumn("_a", area).withColumn("cum", F.sum("_a").over(w)).select("curve_id", F.col("k").cast("bigint").alias("k"), "u", "inv", "cum")


def speed_factor(lut: DataFrame) -> DataFrame:
    """Timeline ms per source ms and the harmonic mean speed."""
    return lut.groupBy("curve_id").agg(F.max("cum").alias("factor"), (F.count("*") / F.sum("inv")).alias("average_speed"), F.max(F.col("inv") > 1 / 0.999).alias("has_slow_motion"))


def output_to_source(times: DataFrame, lut: DataFrame) -> DataFrame:
    """Source offset reached after ``play_ms`` of a clip. times: curve_id, source_ms, play_ms plus any ids.

    The grid interval is found with an equi-join: the table is packed per curve (bounded by its samples) and
    searched in place."""
    packed = lut.groupBy("curve_id").agg(F.array_sort(F.collect_list(F.struct("cum", "u"))).alias("_g"))
    j = times.join(packed, "curve_id").withColumn("_t", F.col("play_ms") / F.col("source_ms"))
    lo = F.try_element_at(F.filter("_g", lambda p: p["cum"] <= F.col("_t")), F.lit(-1))
    hi = F.try_element_at(F.filter("_g", lambda p: p["cum"] > F.col("_t")), F.lit(1))
    u = F.when(lo.isNull(), 0.0).when(hi.isNull(), 1.0).otherwise(lo["u"] + (hi["u"] - lo["u"]) * (F.col("_t") - lo["cum"]) / (hi["cum"] - lo["cum"]))
    return j.select(*times.columns, (u * F.col("source_ms")).alias("offset_ms"))


def source_to_output(times: DataFrame, lut: DataFrame) -> DataFrame:
    """Timeline offset reached after ``offset_ms`` of source, linear between grid points."""
    n = lut.groupBy("curve_id").agg(F.max("k").alias("_n"))
    x = times.join(n, "curve_id").withColumn("_x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("offset_ms") / F.col("source_ms"))) * F.col("_n"))
    x = x.withColumn("k", F.least(F.floor("_x"), F.col("_n") - 1))
    a = lut.select("curve_id", "k", F.col("cum").alias("_a"))
    b = lut.select("curve_id", (F.col("k") - 1).alias("k"), F.col("cum").alias("_b"))
    j = x.join(a, ["curve_id", "k"]).join(b, ["curve_id", "k"])
    return j.select(*times.columns, ((F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("k"))) * F.col("source_ms")).alias("output_ms"))


#: Curves whose tables are held at once inside a batch.
CURVES = 256


def _prepared(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`monotone_tangents` of :func:`normalise` for curves of one length, a row each: x, y, tangent."""
    x, y = np.clip(xs, 0.0, 1.0), np.clip(ys, SPEED_MIN, SPEED_MAX)
    order = np.lexsort((y, x), axis=-1)
    x, y = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    m = np.zeros_like(y)
    if x.shape[1] < 2:
        return x, y, m
    h = x[:, 1:] - x[:, :-1]
    d = (y[:, 1:] - y[:, :-1]) / np.where(h == 0, np.nan, h)
    m[:, 0], m[:, -1] = d[:, 0], d[:, -1]
    m[:, 1:-1] = np.where(d[:, :-1] * d[:, 1:] <= 0, 0.0, (d[:, :-1] + d[:, 1:]) / 2)
    for i in range(d.shape[1]):
        flat, slope = d[:, i] == 0, np.where(d[:, i] == 0, np.nan, d[:, i])
        a, b = m[:, i] / slope, m[:, i + 1] / slope
        s = a * a + b * b
        steep, tau = s > 9, 3.0 / np.sqrt(s)
        m[:, i] = np.where(flat, 0.0, np.where(steep, tau * a * slope, m[:, i]))
        m[:, i + 1] = np.where(flat, 0.0, np.where(steep, tau * b * slope, m[:, i + 1]))
    return x, y, m


def _speeds(curve: tuple[np.ndarray, np.ndarray, np.ndarray], t: np.ndarray) -> np.ndarray:
    """:func:`speed_at` of one prepared curve."""
    x, y, m = curve
    right = np.searchsorted(x, t, side="right")
    j = np.clip(right, 1, max(len(x) - 1, 1)) % len(x)
    i = j - 1
    h = x[j] - x[i]
    u = (t - x[i]) / np.where(h == 0, np.nan, h)
    v = (u * u * u * 2 - u * u * 3 + 1) * y[i] + (u * u * u - u * u * 2 + u) * h * m[i] + (u * u * 3 - u * u * u * 2) * y[j] + (u * u * u - u * u) * h * m[j]
    inside = np.fmin(np.fmax(v, SPEED_MIN), SPEED_MAX)
    return np.where(t <= x[0], y[0], np.where(t >= x[-1], y[-1], inside))


def _reached(curve: tuple[np.ndarray, np.ndarray, np.ndarray], samples: int) -> np.ndarray:
    """``cum`` of :func:`speed_lut` for one prepared curve."""
    n = samples - 1
    inv = 1.0 / _speeds(curve, np.arange(samples) / float(n))
    return np.concatenate(([0.0], np.cumsum((inv[:-1] + inv[1:]) / (2.0 * n))))


def _by_curve(xs: pd.Series, ys: pd.Series) -> Iterator[tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]:
    """Each distinct curve of a batch, prepared, with the rows that have it. Rows without points are left out."""
    rows: dict[bytes, list[int]] = {}
    for i, (x, y) in enumerate(zip(xs, ys)):
        if x is not None and len(x):
            rows.setdefault(np.asarray(x, float).tobytes() + np.asarray(y, float).tobytes(), []).append(i)
    alike: dict[int, list[list[int]]] = {}
    for own in rows.values():
        alike.setdefault(len(xs.iloc[own[0]]), []).append(own)
    for group in alike.values():
        for at in range(0, len(group), CURVES):
            part = group[at:at + CURVES]
            first = [own[0] for own in part]
            x, y, m = _prepared(np.stack(list(xs.iloc[first])).astype(float), np.stack(list(ys.iloc[first])).astype(float))
            for k, own in enumerate(part):
                yield (x[k], y[k], m[k]), np.array(own)


def _coordinates(points: Column) -> list[Column]:
    return [F.transform(points, lambda p: p[c].cast("double")) for c in "xy"]


def _curve_column(points: Column, at: Column, kind: str, work: Callable[[tuple, np.ndarray], np.ndarray]) -> Column:
    """``work(prepared curve, the values of at in the curve's rows)`` per distinct curve of a batch; null without points."""
    def run(xs: pd.Series, ys: pd.Series, at: pd.Series) -> pd.Series:
        out = np.full(len(xs), None, dtype=object)
        with np.errstate(invalid="ignore", divide="ignore"):
            for curve, own in _by_curve(xs, ys):
                found = work(curve, at.to_numpy()[own])
                for i, v in zip(own.tolist(), found):
                    out[i] = v
        return pd.Series(out)

    run.__annotations__ = {"xs": pd.Series, "ys": pd.Series, "at": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(*_coordinates(points), at)


def curve_factor(points: Column, samples: int = 256) -> Column:
    """Timeline ms per source ms, the ``factor`` of :func:`speed_factor`."""
    return _curve_column(points, F.lit(0.0), "double", lambda curve, at: np.full(len(at), _reached(curve, samples)[-1]))


def curve_source(points: Column, played: Column, samples: int = 256) -> Column:
    """Source position 0..1 reached after ``played`` of output, in lengths of the source: :func:`output_to_source`."""
    def work(curve, t):
        cum, t = _reached(curve, samples), t.astype(float)
        hi = np.searchsorted(cum, t, side="right")
        i, j = np.clip(hi - 1, 0, samples - 1), np.clip(hi, 0, samples - 1)
        n = float(samples - 1)
        u = i / n + (j / n - i / n) * (t - cum[i]) / np.where(cum[j] == cum[i], np.nan, cum[j] - cum[i])
        return np.where((hi == 0) | np.isnan(t), 0.0, np.where(hi == samples, 1.0, u))

    return _curve_column(points, played.cast("double"), "double", work)


def curve_output(points: Column, position: Column, samples: int = 256) -> Column:
    """Output time reached at a source position 0..1, in lengths of the source: :func:`source_to_output`."""
    def work(curve, p):
        cum, n = _reached(curve, samples), samples - 1
        x = np.fmin(1.0, np.fmax(0.0, p.astype(float))) * n
        k = np.minimum(np.floor(x), n - 1).astype(int)
        return cum[k] + (cum[k + 1] - cum[k]) * (x - k)

    return _curve_column(points, position.cast("double"), "double", work)


def _cut_at(knots: np.ndarray, a: float, b: float, parts: int) -> np.ndarray:
    """Positions of a cut part: both ends, the knots inside and samples every 1 / ``parts``."""
    anchors = np.concatenate(([a], knots[(knots > a + 1e-6) & (knots < b - 1e-6)], [b]))
    x, gap = anchors[:-1], np.diff(anchors)
    more = np.maximum(0, np.ceil(gap / ((b - a) / parts)).astype(int) - 1)
    k = np.arange(int((more + 1).sum())) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    return np.append(np.repeat(x, more + 1) + np.repeat(gap, more + 1) * k / np.repeat(more + 1, more + 1), b)


def slice_curve(points: Column, u0: Column, u1: Column, parts: int = 4) -> Column:
    """The part [u0, u1] of a curve stretched to 0..1, with the old knots inside and samples every 1 / ``parts``."""
    def run(xs: pd.Series, ys: pd.Series, u0: pd.Series, u1: pd.Series) -> pd.DataFrame:
        low = np.fmin(np.fmax(u0.to_numpy(float), 0.0), 1.0)
        high = np.fmax(low + 1e-6, np.fmin(u1.to_numpy(float), 1.0))
        x, y = np.full(len(xs), None, dtype=object), np.full(len(xs), None, dtype=object)
        with np.errstate(invalid="ignore", divide="ignore"):
            for curve, own in _by_curve(xs, ys):
                for i in own.tolist():
                    at = _cut_at(curve[0], low[i], high[i], parts)
                    x[i], y[i] = np.clip((at - low[i]) / (high[i] - low[i]), 0.0, 1.0), _speeds(curve, at)
        return pd.DataFrame({"x": x, "y": y})

    run.__annotations__ = {"xs": pd.Series, "ys": pd.Series, "u0": pd.Series, "u1": pd.Series, "return": pd.DataFrame}
    found = F.pandas_udf(run, "x array<double>, y array<double>")(*_coordinates(points), u0.cast("double"), u1.cast("double"))
    return F.when(is_uniform(points), points).otherwise(F.arrays_zip(found["x"].alias("x"), found["y"].alias("y")).cast("array<struct<x:double,y:double>>"))
