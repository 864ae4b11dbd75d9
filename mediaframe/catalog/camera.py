"""Camera, reframing and tracking queries over ``events`` paths and ``lineitem`` detections."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import geometry as g
from mediaframe.operators import camera as op
from mediaframe.operators import crops, detections, tracking

W, H = 1280.0, 720.0
VAL = f"f as ({fx.FRAMES_SQL})"
# a crop per frame: x from the value, width 400..900
PATH = f"c as (select asset_id, frame, label, least(value, 300.0) as x1, least(value, 200.0) / 2 as y1, least(value, 300.0) + 500 + frame % 5 * 40 as x2, least(value, 200.0) / 2 + (500 + frame % 5 * 40) * 0.5625::double as y2 from ({fx.FRAMES_SQL}))"


def _path(spark, sf):
    f = fx.frames(spark, sf)
    x, y, w = F.least("value", F.lit(300.0)), F.least("value", F.lit(200.0)) / 2, F.lit(500) + F.col("frame") % 5 * 40
    return f.select("asset_id", "frame", "label", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w * 0.5625).alias("y2"))


@query("ema_zero_phase", f"""with recursive {VAL}, fw as (select asset_id, frame, value as y from f where frame = 0 union all select f.asset_id, f.frame, 0.2::double * f.value + 0.8::double * fw.y from fw join f on f.asset_id = fw.asset_id and f.frame = fw.frame + 1),
 n as (select asset_id, max(frame) as n from f group by 1), bw as (select fw.asset_id, frame, y from fw join n on n.asset_id = fw.asset_id and frame = n union all select fw.asset_id, fw.frame, 0.2::double * fw.y + 0.8::double * bw.y from bw join fw on fw.asset_id = bw.asset_id and fw.frame = bw.frame - 1)
 select asset_id, frame, round(y, 6) as value from bw""")
def ema_zero_phase(spark, sf):
    return op.ema_zero_phase(fx.frames(spark, sf).select("asset_id", "frame", "value"), ["value"], 0.2).withColumn("value", F.round("value", 6))


def _weights_sql():
    w = op.savgol_weights(7)
    cell = lambda i: " + ".join(f"({w[i][j]!r}::double) * v[{j + 1}]".replace("np.float64(", "").replace(")::double", "::double") for j in range(7))
    arms = " ".join(f"when {i} then {cell(i)}" for i in range(7))
    return f"case frame - s {arms} end"


@query("savgol", f"""with {VAL}, n as (select asset_id, count(*) as n from f group by 1), s as (select f.asset_id, frame, least(greatest(frame - 3, 0), n - 7) as s from f join n using (asset_id)),
 v as (select s.asset_id, s.frame, any_value(s) as s, list(f.value order by f.frame) as v from s join f on f.asset_id = s.asset_id and f.frame between s and s + 6 group by 1, 2) select asset_id, frame, round({_weights_sql()}, 6) + 0.0 as value from v""")
def savgol(spark, sf):
    return op.savgol(fx.frames(spark, sf).select("asset_id", "frame", "value"), ["value"], 7).withColumn("value", F.round("value", 6))


@query("smooth_crops", f"""with recursive {PATH}, f as (select asset_id, frame, (x1 + x2) / 2 as a, (y1 + y2) / 2 as b, x2 - x1 as w from c),
 fw as (select * from f where frame = 0 union all select f.asset_id, f.frame, 0.15::double * f.a + 0.85::double * fw.a, 0.15::double * f.b + 0.85::double * fw.b, 0.15::double * f.w + 0.85::double * fw.w from fw join f on f.asset_id = fw.asset_id and f.frame = fw.frame + 1),
 n as (select asset_id, max(frame) as n from f group by 1), bw as (select fw.* from fw join n on n.asset_id = fw.asset_id and frame = n union all select fw.asset_id, fw.frame, 0.15::double * fw.a + 0.85::double * bw.a, 0.15::double * fw.b + 0.85::double * bw.b, 0.15::double * fw.w + 0.85::double * bw.w from bw join fw on fw.asset_id = bw.asset_id and fw.frame = bw.frame - 1)
 select asset_id, frame, round(least(greatest(a - w / 2, 0), 1280 - w), 5) as x1, round(least(greatest(b - w * 0.5625::double / 2, 0), 720 - w * 0.5625::double), 5) as y1, round(least(greatest(a - w / 2, 0), 1280 - w) + w, 5) as x2 from bw""")
def smooth_crops(spark, sf):
    s = op.smooth_crops(_path(spark, sf), W, H)
    return s.select("asset_id", "frame", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2")])


@query("kf_from_crop", f"with {PATH} select asset_id, frame, round_even(frame / 24.0::double * 1000, 3) as time_ms, round_even(1280 / (x2 - x1), 4) as zoom, round_even(((x1 + x2) / 2 + 0.00123::double - 640) / 640, 4) + 0.0 as tx, round_even(((y1 + y2) / 2 + 0.00123::double - 360) / 360, 4) + 0.0 as ty from c")
def kf_from_crop(spark, sf):
    # moved off the decimal grid, where engines break rounding ties differently
    k = op.kf_from_crop(g.Box(*[c + 0.00123 for c in g.box()]), F.col("frame"), 24.0, W, H)
    return _path(spark, sf).select("asset_id", "frame", *[k[n].alias(n) for n in ("time_ms", "zoom", "tx", "ty")])


@query("static_track", f"with {PATH} select asset_id, unnest([frame, frame + 48]) as frame, frame as shot, round_even(1280 / (x2 - x1), 4) as zoom, round_even(x1, 2) as x1 from c")
def static_track(spark, sf):
    s = _path(spark, sf).withColumns({"shot": F.col("frame"), "start_frame": F.col("frame"), "end_frame": F.col("frame") + 48}).drop("frame")
    return op.static_track(s, 24.0, W, H).select("asset_id", "frame", "shot", "zoom", "x1")


@query("visibility_segments", f"""with {VAL}, r as (select *, count(*) filter (label = 'error') over (partition by asset_id order by frame) as g from f) select asset_id, min(frame) as start_frame, max(frame) + 1 as end_frame from r where label <> 'error' group by asset_id, g""")
def visibility_segments(spark, sf):
    return op.visibility_segments(fx.frames(spark, sf).select("asset_id", "frame", (F.col("label") != "error").alias("visible")))


@query("choose_sides", f"""with {PATH}, d as (select *, case when label <> 'error' then x1 + case when frame % 7 < 4 then 600 else -700 end end as dx, count(*) filter (label = 'error') over (partition by asset_id order by frame) as run from c),
 s as (select *, greatest(dx - x2, x1 - dx - 100, 300 - y2, y1 - 500) as top from d where dx is not null),
 v as (select *, case when top >= -1 then case when dx - x2 = top then 'left' when x1 - dx - 100 = top then 'right' when 300 - y2 = top then 'above' else 'below' end end as side, case when x1 + 50 < dx + 50 then 'left' else 'right' end as fall from s),
 a as (select asset_id, run, min(frame) as start_frame, max(frame) + 1 as end_frame, count(*) filter (side = 'left') as l, count(*) filter (side = 'right') as r, count(*) filter (side = 'above') as u, count(*) filter (side = 'below') as b, count(*) filter (fall = 'left') as fl, count(*) filter (fall = 'right') as fr from v group by 1, 2)
 select asset_id, start_frame, end_frame, case when l + r + u + b = 0 then case when fr > fl then 'right' else 'left' end when l = greatest(l, r, u, b) then 'left' when r = greatest(l, r, u, b) then 'right' when u = greatest(l, r, u, b) then 'above' else 'below' end as side from a""")
def choose_sides(spark, sf):
    c = _path(spark, sf)
    dx = F.when(F.col("label") != "error", F.col("x1") + F.when(F.col("frame") % 7 < 4, 600).otherwise(-700))
    f = c.select("asset_id", "frame", *[F.col(n).alias(f"t_{n}") for n in ("x1", "y1", "x2", "y2")], dx.alias("d_x1"), F.lit(300.0).alias("d_y1"), (dx + 100).alias("d_x2"), F.lit(500.0).alias("d_y2"),
                 F.col("x1").alias("p_x1"), F.lit(0.0).alias("p_y1"), (F.col("x1") + 100).alias("p_x2"), F.lit(90.0).alias("p_y2"))
    return op.choose_sides(f)


@query("split_by_side")
def split_by_side(spark, sf):
    s = fx.frames(spark, sf).select("asset_id", "frame", F.when(F.col("value") > 45, "left").otherwise("right").alias("side"))
    return op.split_by_side(s, 3)


@query("zoom_overshoot", f"""with {PATH}, z as (select asset_id, frame, 1280 / (x2 - x1) as z from c), w as (select *, lag(z) over o as p, lead(z) over o as q, min(z) over (o rows between 3 preceding and 1 preceding) as b, min(z) over (o rows between 1 following and 3 following) as a from z window o as (partition by asset_id order by frame))
 select asset_id, round(coalesce(max(case when z >= p and z > q and z - b >= 0.08 then (z - a) / a end), 0), 6)::double as overshoot from w group by 1""")
def zoom_overshoot(spark, sf):
    return op.zoom_overshoot(_path(spark, sf), W, fps=2.0).withColumn("overshoot", F.round("overshoot", 6))


@query("path_metrics", f"""with {PATH}, v as (select asset_id, frame, 1280 / (x2 - x1) as z, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from c), d as (select *, z - lag(z) over o as dz, cx - lag(cx) over o as dx, cy - lag(cy) over o as dy from v window o as (partition by asset_id order by frame)),
 a as (select *, dx - lag(dx) over (partition by asset_id order by frame) as ax from d), zs as (select asset_id, sign(dz) as s, lag(sign(dz)) over (partition by asset_id order by frame) as p from d where abs(dz) > 0.002), xs as (select asset_id, sign(dx) as s, lag(sign(dx)) over (partition by asset_id order by frame) as p from d where abs(dx) > 0.5)
 select a.asset_id, round(min(z), 5) as zoom_min, round(max(z), 5) as zoom_max, round(coalesce(max(abs(dz)), 0), 5) as max_zoom_step, round(coalesce(max(abs(dx)), 0), 5) as max_pan_step, round(coalesce(max(abs(dy)), 0), 5) as max_tilt_step, round(coalesce(max(abs(ax)), 0), 5) as max_pan_accel,
  (select count(*) from zs where zs.asset_id = a.asset_id and s <> p) as zoom_reversals, (select count(*) from xs where xs.asset_id = a.asset_id and s <> p) as pan_reversals from a group by a.asset_id""")
def path_metrics(spark, sf):
    m = op.path_metrics(_path(spark, sf), W)
    return m.select("asset_id", *[F.round(c, 5).alias(c) for c in m.columns if c.startswith(("zoom_m", "max_"))], "zoom_reversals", "pan_reversals")


def _subjects(spark, sf):
    """Frames with one primary (det 1) and the other boxes as duplicates."""
    d = fx.detections(spark, sf)
    p = d.filter("det = 1").select((F.col("frame_id") % 50).alias("asset_id"), F.col("frame_id").alias("frame"), "x1", "y1", "x2", "y2")
    dups = d.filter("det > 1").groupBy(F.col("frame_id").alias("frame")).agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("dups"))
    return p.join(dups, "frame")


@query("solve_crops")
def solve_crops(spark, sf):
    return crops.solve_crops(_subjects(spark, sf), W, H)


@query("clamp_crops")
def clamp_crops(spark, sf):
    s = _subjects(spark, sf)
    full = s.select("asset_id", "frame", F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(W).alias("x2"), F.lit(H).alias("y2"), "dups", F.array(*g.head_region(g.box())).alias("head"))
    return crops.clamp_crops(full, W, H)


def _shot_samples(spark, sf):
    f = fx.frames(spark, sf)
    v, seen = F.least("value", F.lit(200.0)), F.col("label") != "error"
    p, d = (v, F.lit(100.0), v + 150, F.lit(500.0)), (v + 700, F.lit(120.0), v + 850, F.lit(480.0))
    names = ("x1", "y1", "x2", "y2")
    return f.select("asset_id", "frame", "label", *[c.alias(f"p_{n}") for c, n in zip(p, names)], *[F.when(seen, c).alias(f"d_{n}") for c, n in zip(d, names)])


def _sizes(spark, sf):
    return fx.frames(spark, sf).groupBy("asset_id").agg((F.max("frame") + 1).alias("n_frames"))


@query("reframe_from_tracks")
def reframe_from_tracks(spark, sf):
    return crops.crop_keyframes(crops.reframe(_sizes(spark, sf), _shot_samples(spark, sf), W, H), 24.0, W, H)


@query("reframe_from_findings")
def reframe_from_findings(spark, sf):
    found = _shot_samples(spark, sf).filter(F.col("d_x1").isNotNull() & (F.col("label") == "signup"))
    have = found.select("asset_id").distinct()
    return crops.crop_keyframes(crops.reframe(_sizes(spark, sf).join(have, "asset_id", "left_semi"), found, W, H, relax=(6, 12)), 24.0, W, H)


def _track_input(spark, sf):
    d = fx.detections(spark, sf)
    return d.select(F.floor(F.col("frame_id") / 1000).alias("asset_id"), F.col("shot_id").alias("shot"), F.col("frame_id").alias("frame"), "det", "label", "score", "x1", "y1", "x2", "y2")


@query("byte_track")
def byte_track(spark, sf):
    return tracking.byte_track(_track_input(spark, sf), tracking.TrackerOptions(high=0.4, low=0.2, birth=0.4, same_label=False))


@query("assign")
def assign(spark, sf):
    d = fx.detections(spark, sf)
    p = detections.pair_detections(d, W, H, min_iou=0.2)
    return tracking.assign(p.select("frame_id", F.col("det_a").alias("row_id"), F.col("det_b").alias("col_id"), (F.lit(1.0) - F.col("iou")).alias("cost")), 0.8)


@query("follow_pairs")
def follow_pairs(spark, sf):
    s = _shot_samples(spark, sf)
    look = lambda i: F.array(*[F.lit(float(i == j)) for j in range(2)])
    rows = s.select(F.col("asset_id").alias("pair_id"), "frame", F.explode(F.array(
        F.struct(F.lit(1).alias("det"), *[F.col(f"p_{n}").alias(n) for n in ("x1", "y1", "x2", "y2")], look(0).alias("emb")),
        F.struct(F.lit(2).alias("det"), *[F.col(f"d_{n}").alias(n) for n in ("x1", "y1", "x2", "y2")], look(1).alias("emb")))).alias("s")).select("pair_id", "frame", F.when(F.col("s.x1").isNotNull(), F.col("s.det")).alias("det"), "s.x1", "s.y1", "s.x2", "s.y2", "s.emb", F.lit(False).alias("veto"))
    a = s.filter((F.col("label") == "signup") & F.col("d_x1").isNotNull()).withColumnRenamed("asset_id", "pair_id").withColumn("p_emb", look(0)).withColumn("d_emb", look(1))
    return tracking.follow_pairs(rows.join(a.select("pair_id").distinct(), "pair_id", "left_semi"), a, W, H, hold=2)


@query("appearance_ema")
def appearance_ema(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return tracking.appearance_ema(e.select((F.col("label") % 3).cast("bigint").alias("asset_id"), F.col("label").cast("bigint").alias("track_id"), F.col("vec_id").alias("frame"), "embedding"), 0.8)


@query("assign_lineup")
def assign_lineup(spark, sf):
    d = fx.detections(spark, sf)
    b = d.select(F.col("frame_id").alias("image_id"), F.pmod("part", F.lit(3)).alias("position"), "det", "score", (F.lit(0.5) + F.col("score") / 4).alias("char_prob"), "x1", "y1", "x2", "y2")
    lineup = d.select(F.col("frame_id").alias("image_id")).distinct().select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("position")).withColumn("character", F.concat(F.lit("c"), F.col("position").cast("string")))
    return crops.assign_lineup(b, lineup)
