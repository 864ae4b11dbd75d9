"""Camera paths: smoothing, visibility, sides, path diagnostics, crop keyframes.

Paths are (asset_id, frame, x1, y1, x2, y2) with a dense 0-based frame per asset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions import geometry as g
from mediaframe.operators.shots import BLOCK
from mediaframe.plans import scan
from mediaframe.plans.blocks import blockwise, ema, zero_phase
from mediaframe.plans.joins import bucket_of
from mediaframe.session import cut_lineage

BY = ["asset_id"]


def ema_zero_phase(df: DataFrame, values: list[str], alpha: float, keep: list[str] | None = None, short: bool = False) -> DataFrame:
    """Forward then backward moving average: no lag. ``short`` says that a task can hold any of the series: they move once and both
    passes run together, and columns named by ``keep`` come along."""
    a = min(max(float(alpha), 1e-3), 1.0)
    if short:
        parts, kept = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keep or []
        rows = df.dropna(subset=[*BY, "frame"]).select(*BY, "frame", *[F.col(v).cast("double").alias(v) for v in values], *kept)
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return rows.repartition(parts, *BY).sortWithinPartitions(*BY, "frame").mapInPandas(lambda batches: zero_phase(batches, BY, values, a), schema)
    forward = cut_lineage(ema(df, BY, "frame", values, a))
    return ema(forward, BY, "frame", values, a, backwards=True)


def savgol_weights(window: int) -> np.ndarray:
    """Row i: weights that give the quadratic fit of ``window`` samples at sample i."""
    t = np.arange(window) - window // 2
    v = np.stack([np.ones(window), t, t * t], axis=1)
    return v @ np.linalg.pinv(v)


def savgol(df: DataFrame, values: list[str], window: int) -> DataFrame:
    """Quadratic smoothing; the ends use the fit of the first and last full window. Series shorter than five
    frames stay as they are; the window shrinks to the series length (odd)."""
    window += 1 - window % 2
    sizes = df.groupBy(*BY).agg((F.max("frame") + 1).alias("n"))
    schema = "asset_id bigint, frame bigint, " + ", ".join(f"{v} double" for v in values)

    def run(pdf: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        n, first = int(pdf["n"].iloc[0]), int(pdf["frame"].iloc[0])
        own = pdf[pdf["_own"]]
        x, f = pdf[values].to_numpy(dtype=np.float64), own["frame"].to_numpy()
        if n < 5 or not len(own):
            return own[["asset_id", "frame", *values]].astype({v: float for v in values})
        w = max(5, min(window, n if n % 2 else n - 1))
        weights, half = savgol_weights(w), w // 2
        start = np.clip(f - half, 0, n - w)
        rows = x[(start - first)[:, None] + np.arange(w)[None, :]]
        out = np.einsum("ij,ijk->ik", weights[f - start], rows)
        return pd.DataFrame({"asset_id": own["asset_id"].to_numpy(), "frame": f, **{v: out[:, j] for j, v in enumerate(values)}})

    return blockwise(df.select(*BY, "frame", *values).join(sizes, BY), BY, "frame", 8192, window, window, run, schema)


def smooth_crops(crops: DataFrame, w: float, h: float, method: str = "ema", alpha: float = 0.15, window: int = 15,
                 keep: list[str] | None = None, short: bool = False) -> DataFrame:
    """Smooth centre and width, keep the frame's aspect, stay inside the frame. ``keep`` and ``short`` as in :func:`ema_zero_phase`."""
    aspect = w / h
    b = g.box()
    c = crops.select(*BY, "frame", g.centre_x(b).alias("cx"), g.centre_y(b).alias("cy"), g.width(b).alias("cw"), *(keep or []))
    s = savgol(c, ["cx", "cy", "cw"], window) if method == "savgol" else ema_zero_phase(c, ["cx", "cy", "cw"], alpha, keep, short)
    lim = lambda v, hi: F.least(F.greatest(v, F.lit(0.0)), hi)
    cw = F.least(F.greatest(F.col("cw"), F.lit(1.0)), F.lit(min(w, h * aspect)))
    s = s.withColumn("cw", cw).withColumn("x1", lim(F.col("cx") - F.col("cw") / 2, F.lit(w) - F.col("cw"))).withColumn("y1", lim(F.col("cy") - F.col("cw") / aspect / 2, F.lit(h) - F.col("cw") / aspect))
    return s.select(*BY, "frame", "x1", "y1", (F.col("x1") + F.col("cw")).alias("x2"), (F.col("y1") + F.col("cw") / aspect).alias("y2"), *(keep or []))


def kf_from_crop(b: g.Box, frame: Column, fps: float, w: float, h: float) -> Column:
    """struct<time_ms, x1..y2, zoom, tx, ty> of a reframe keyframe."""
    r = lambda c, n: F.bround(c, n)
    cw = F.greatest(g.width(b), F.lit(1e-6))
    return F.struct(r(frame / fps * 1000, 3).alias("time_ms"), *[r(c, 2).alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))], r(F.lit(w) / cw, 4).alias("zoom"),
                    r((g.centre_x(b) - w / 2) / (w / 2), 4).alias("tx"), r((g.centre_y(b) - h / 2) / (h / 2), 4).alias("ty"))


def static_track(shots: DataFrame, fps: float, w: float, h: float) -> DataFrame:
    """Two keyframes holding one crop over a shot. shots: asset_id, shot, start_frame, end_frame, x1..y2."""
    b = g.box()
    aspect = w / h
    cw = F.least(F.greatest(g.width(b), F.lit(1.0)), F.lit(min(w, h * aspect)))
    x = F.least(F.greatest(b.x1, F.lit(0.0)), F.lit(w) - cw)
    y = F.least(F.greatest(b.y1, F.lit(0.0)), F.lit(h) - cw / aspect)
    box = g.Box(x, y, x + cw, y + cw / aspect)
    k = shots.withColumn("frame", F.explode(F.array("start_frame", "end_frame")))
    return k.select("asset_id", "shot", "frame", kf_from_crop(box, F.col("frame"), fps, w, h).alias("k")).select("asset_id", "shot", "frame", "k.*")


# --------------------------------------------------------------------------- visibility and sides


def visibility_segments(frames: DataFrame) -> DataFrame:
    """Runs of visible frames: (asset_id, start_frame, end_frame exclusive). frames: asset_id, frame, visible."""
    s = scan.ordered_scan(frames, BY, [F.col("frame")], bucket_of(F.col("frame"), BLOCK), _gap=scan.running_sum((~F.col("visible")).cast("bigint")))
    return s.filter("visible").groupBy(*BY, "_gap").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")).drop("_gap")


def choose_sides(frames: DataFrame) -> DataFrame:
    """One side per visible run: the majority of the per-frame sides, else where the primary stands. Ties take
    left, right, above, below in this order. frames: asset_id, frame, t_* target crop, d_* duplicate (null when hidden), p_* primary (nullable)."""
    f = frames.withColumn("visible", F.col("d_x1").isNotNull())
    s = scan.ordered_scan(f, BY, [F.col("frame")], bucket_of(F.col("frame"), BLOCK), _run=scan.running_sum((~F.col("visible")).cast("bigint"))).filter("visible")
    side = g.box_side(g.box("t_"), g.box("d_"))
    fallback = F.when(F.col("p_x1").isNotNull(), F.when(g.centre_x(g.box("p_")) < g.centre_x(g.box("d_")), "left").otherwise("right"))
    s = s.withColumn("_side", side).withColumn("_fall", fallback)
    votes = s.groupBy(*BY, "_run").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), *[F.count_if(F.col("_side") == n).alias(f"v_{n}") for n in g.SIDES],
                                       *[F.count_if(F.col("_fall") == n).alias(f"f_{n}") for n in ("left", "right")])
    top = F.greatest(*[F.col(f"v_{n}") for n in g.SIDES])
    pick = F.when(top == 0, F.when(F.col("f_right") > F.col("f_left"), "right").otherwise("left"))
    for n in g.SIDES:
        pick = pick.when(F.col(f"v_{n}") == top, n)
    return votes.select(*BY, "start_frame", "end_frame", pick.alias("side"))


def split_by_side(sides: DataFrame, hold: int) -> DataFrame:
    """Side per frame with hysteresis: a new side counts once it lasts ``hold`` frames; the first side is the
    most frequent of the first ``hold``. sides: asset_id, frame, side (dense from 0). Adds ``held``."""
    w = Window.partitionBy(*BY, "_block").orderBy("frame").rowsBetween(0, hold - 1)
    top = sides.groupBy(*BY).agg((F.max("frame") + 1).alias("_n"))
    near = scan.halo(sides, "frame", BLOCK, 0, hold).withColumn("_steady", F.min("side").over(w) == F.max("side").over(w)).filter("_own").join(top, BY)
    steady = F.col("_steady") & (F.col("frame") + hold <= F.col("_n"))
    s = scan.ordered_scan(near.select(*BY, "frame", "side", steady.alias("_steady")), BY, [F.col("frame")], bucket_of(F.col("frame"), BLOCK), _last=scan.last(F.when(F.col("_steady"), F.col("side"))))
    head = sides.filter(F.col("frame") < hold).groupBy(*BY, "side").agg(F.count("*").alias("n"), F.min("side").alias("s"))
    start = head.groupBy(*BY).agg(F.max(F.struct("n", "side"))["side"].alias("_first"))
    return s.join(start, BY).select(*BY, "frame", "side", F.coalesce("_last", "_first").alias("held"))


# --------------------------------------------------------------------------- diagnostics


def zoom_overshoot(crops: DataFrame, w: float, fps: float = 24.0) -> DataFrame:
    """Largest (peak - settled) / settled of an asset's zoom: peaks that rose at least 0.08 within 1.5 s,
    settled being the lowest zoom of the following 1.5 s."""
    win = max(3, int(round(1.5 * fps)))
    z = crops.select(*BY, "frame", (F.lit(w) / (F.col("x2") - F.col("x1"))).alias("z"))
    o = Window.partitionBy(*BY, "_block").orderBy("frame")
    near = scan.halo(z, "frame", BLOCK, win, win).withColumns({
        "_p": F.lag("z").over(o), "_q": F.lead("z").over(o), "_before": F.min("z").over(o.rowsBetween(-win, -1)), "_after": F.min("z").over(o.rowsBetween(1, win))}).filter("_own")
    peak = (F.col("z") >= F.col("_p")) & (F.col("z") > F.col("_q")) & (F.col("z") - F.col("_before") >= 0.08)
    return near.groupBy(*BY).agg(F.coalesce(F.max(F.when(peak, (F.col("z") - F.col("_after")) / F.col("_after"))), F.lit(0.0)).alias("overshoot"))


def path_metrics(crops: DataFrame, w: float) -> DataFrame:
    """Zoom range, largest zoom / pan / tilt step, largest pan acceleration, direction reversals."""
    b = g.box()
    c = crops.select(*BY, "frame", (F.lit(w) / g.width(b)).alias("z"), g.centre_x(b).alias("cx"), g.centre_y(b).alias("cy"))
    o = Window.partitionBy(*BY, "_block").orderBy("frame")
    d = scan.halo(c, "frame", BLOCK, 2, 0).withColumns({"dz": F.col("z") - F.lag("z").over(o), "dx": F.col("cx") - F.lag("cx").over(o), "dy": F.col("cy") - F.lag("cy").over(o)})
    d = d.withColumn("ax", F.col("dx") - F.lag("dx").over(o)).filter("_own")
    zero = lambda c_, n: F.coalesce(F.max(F.abs(c_)), F.lit(0.0)).alias(n)
    base = d.groupBy(*BY).agg(F.min("z").alias("zoom_min"), F.max("z").alias("zoom_max"), zero(F.col("dz"), "max_zoom_step"), zero(F.col("dx"), "max_pan_step"), zero(F.col("dy"), "max_tilt_step"), zero(F.col("ax"), "max_pan_accel"))

    def reversals(col: str, eps: float, name: str) -> DataFrame:
        big = d.filter(F.abs(F.col(col)) > eps).select(*BY, "frame", F.signum(col).alias("s"))
        s = scan.ordered_scan(big, BY, [F.col("frame")], bucket_of(F.col("frame"), BLOCK), prev=scan.lag(F.col("s")))
        return s.groupBy(*BY).agg(F.count_if(F.col("prev") != F.col("s")).alias(name))

    out = base.join(reversals("dz", 2e-3, "zoom_reversals"), BY, "left").join(reversals("dx", 0.5, "pan_reversals"), BY, "left")
    return out.fillna(0, ["zoom_reversals", "pan_reversals"])
