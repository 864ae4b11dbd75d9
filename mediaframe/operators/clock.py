"""Presentation clocks, resampling plans and everything looked up by time.

A clock is (asset_id, frame, pts_us): dense 0-based frames with rising times. Lookups are as-of brackets;
frame-number lookups are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.easing import ease, lerp, lerp_array
from mediaframe.operators.shots import BLOCK
from mediaframe.plans import scan
from mediaframe.plans.joins import bracket_join, bucket_of, range_join

DAY_US = 86_400_000_000
COINCIDE_US = 500  # an output within half a millisecond of a source frame copies it


def frame_times(packets: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """Packets (asset_id, pts, dts, flags, tb_num, tb_den, start_us) to a clock: discarded packets never
    become frames, pts falls back to dts."""
    live = packets.filter(~F.coalesce(F.col("flags"), F.lit("")).contains("D"))
    tick = F.coalesce("pts", "dts")
    whole = tick * F.col("tb_num")
    us = (F.floor(whole / F.col("tb_den")) * 1_000_000
          + F.round((whole % F.col("tb_den")) * 1_000_000 / F.col("tb_den")).cast("bigint") - F.col("start_us"))
    t = live.select("asset_id", us.alias("pts_us"), tick.alias("tick"))
    n = scan.ordered_scan(t, ["asset_id"], [F.col("pts_us"), F.col("tick")], bucket_of(F.col("pts_us"), width_us), pos=scan.number())
    return n.select("asset_id", (F.col("pos") - 1).alias("frame"), "pts_us")


def index_at(times: DataFrame, clock: DataFrame, at: str = "t_us", width_us: int = DAY_US) -> DataFrame:
    """The frame showing at a time: the last one at or before it (0 before the first)."""
    b = bracket_join(times, clock, ["asset_id"], at, "pts_us", ["frame"], width_us)
    return b.select(*times.columns, F.coalesce(F.col("lo.frame"), F.lit(0)).alias("frame"))


def nearest(times: DataFrame, clock: DataFrame, at: str = "t_us", width_us: int = DAY_US) -> DataFrame:
    """The frame nearest to a time; the earlier one on a tie."""
    b = bracket_join(times, clock, ["asset_id"], at, "pts_us", ["frame", "pts_us"], width_us)
    later = F.col("lo").isNull() | (F.col("hi.pts_us") - F.col(at) < F.col(at) - F.col("lo.pts_us"))
    return b.select(*times.columns, F.when(later & F.col("hi").isNotNull(), F.col("hi.frame")).otherwise(F.col("lo.frame")).alias("frame"))


def time_of(frames: DataFrame, clock: DataFrame, at: str = "index", fps: float = 25.0) -> DataFrame:
    """Presentation time of a fractional frame index: interpolated inside, extrapolated at ``fps`` outside."""
    step = 1_000_000.0 / fps
    paired = scan.ordered_scan(clock, ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), BLOCK), next_us=scan.lead(F.col("pts_us")))
    ends = clock.groupBy("asset_id").agg(F.max("frame").alias("_last"))
    i = F.col(at)
    q = frames.join(ends, "asset_id").withColumn("_f", F.least(F.greatest(F.floor(i), F.lit(0)), F.col("_last")))
    j = q.join(paired.select("asset_id", F.col("frame").alias("_f"), "pts_us", "next_us"), ["asset_id", "_f"])
    us = F.when((i <= 0) | (i >= F.col("_last")), F.col("pts_us") + (i - F.when(i <= 0, F.lit(0)).otherwise(F.col("_last"))) * step).otherwise(
        F.col("pts_us") + (i - F.col("_f")) * (F.col("next_us") - F.col("pts_us")))
    return j.select(*frames.columns, us.alias("us"))


def seek_time(frames: DataFrame, clock: DataFrame, at: str = "frame", fps: float = 25.0) -> DataFrame:
    """A seek position that starts decoding on exactly this frame: half way from the previous one."""
    pairs = frames.withColumn("_at", F.explode(F.array(F.col(at) - 1, F.col(at))))
    t = time_of(pairs.withColumn("_at", F.col("_at").cast("double")), clock, "_at", fps)
    out = t.groupBy(*frames.columns).agg(F.avg("us").alias("us"))
    return out.withColumn("us", F.when(F.col(at) <= 0, 0.0).otherwise(F.col("us")))


def frames_in_shots(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """Each frame with the shot whose inclusive frame range holds it."""
    return range_join(frames, shots, ["asset_id"], "frame", "start_frame", "end_frame", BLOCK, closed_end=True)


def sample_frames(shots: DataFrame, clock: DataFrame, period_us: int, width_us: int = DAY_US) -> DataFrame:
    """Frames sampled from every shot at a fixed period: the nearest frame, kept inside the shot.

    shots: asset_id, shot, start_frame, end_frame, start_us, end_us (time of the last frame)."""
    grid = shots.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end_us") - F.col("start_us")) / period_us))))
    grid = grid.withColumn("t_us", F.col("start_us") + F.col("k") * period_us)
    near = nearest(grid, clock, "t_us", width_us)
    return near.withColumn("frame", F.least(F.col("end_frame"), F.greatest(F.col("start_frame"), F.col("frame"))))


def snap(times: DataFrame, targets: DataFrame, threshold, width) -> DataFrame:
    """Move a time onto the nearest target closer than ``threshold``; equal distances take the target that
    comes first in ``ord``. times: project_id, t; targets: project_id, t, ord."""
    points = targets.groupBy("project_id", F.col("t").alias("target")).agg(F.min("ord").alias("ord"))
    b = bracket_join(times, points, ["project_id"], "t", "target", ["target", "ord"], width)
    dl, dh = F.col("t") - F.col("lo.target"), F.col("hi.target") - F.col("t")
    low_ok, high_ok = F.coalesce(dl < threshold, F.lit(False)), F.coalesce(dh < threshold, F.lit(False))
    use_high = high_ok & (~low_ok | (dh < dl) | ((dh == dl) & (F.col("hi.ord") < F.col("lo.ord"))))
    out = F.when(use_high, F.col("hi.target")).when(low_ok, F.col("lo.target")).otherwise(F.col("t"))
    return b.select(*times.columns, out.alias("snapped_t"), (low_ok | high_ok).alias("snapped"))


def evaluate_keyframes(times: DataFrame, keys: DataFrame, at: str = "t_us", width=DAY_US, static: Column | None = None,
                       vector: bool = False, handles: bool = False, tie: str | None = None) -> DataFrame:
    """Keyframed value at clip times: hold outside, the left keyframe's easing between. Clips without keys
    give ``static``. keys: clip_id, time_us, value, easing (bezier when ``handles``)."""
    payload = ["time_us", "value", "easing"] + (["bezier"] if handles else [])
    b = bracket_join(times, keys, ["clip_id"], at, "time_us", payload, width, tie=tie)
    u = (F.col(at) - F.col("lo.time_us")) / (F.col("hi.time_us") - F.col("lo.time_us"))
    k = ease(u, F.col("lo.easing"), F.col("lo.bezier") if handles else None)
    mix = (lerp_array if vector else lerp)(F.col("lo.value"), F.col("hi.value"), k)
    value = F.when(F.col("lo").isNull(), F.col("hi.value")).when(F.col("hi").isNull(), F.col("lo.value")).otherwise(mix)
    return b.select(*times.columns, (value if static is None else F.coalesce(value, static)).alias("value"))


def reframe_crop_at(times: DataFrame, keys: DataFrame, at: str = "t_us", width=DAY_US) -> DataFrame:
    """Linear crop between keyframes, held at the ends. keys: asset_id, time_us, x1..y2."""
    names = ["x1", "y1", "x2", "y2"]
    b = bracket_join(times, keys, ["asset_id"], at, "time_us", ["time_us", *names], width)
    k = (F.col(at) - F.col("lo.time_us")) / (F.col("hi.time_us") - F.col("lo.time_us"))
    pick = lambda c: F.when(F.col("lo").isNull(), F.col(f"hi.{c}")).when(F.col("hi").isNull(), F.col(f"lo.{c}")).otherwise(lerp(F.col(f"lo.{c}"), F.col(f"hi.{c}"), k))
    return b.select(*times.columns, *[pick(c).alias(c) for c in names])


def interp_boxes(frames: DataFrame, samples: DataFrame, conservative: bool, width: int = BLOCK) -> DataFrame:
    """Boxes for every frame from sparse samples (asset_id, frame, x1..y2, all null when not seen): the
    sample itself, else the union of the bracketing boxes (conservative) or their interpolation, else the one known side."""
    names = ["x1", "y1", "x2", "y2"]
    s = samples.withColumnRenamed("frame", "s_frame")
    b = bracket_join(frames, s, ["asset_id"], "frame", "s_frame", ["s_frame", *names], width)
    return b.select(*frames.columns, *[c.alias(n) for n, c in zip(names, box_between(F.col("frame"), F.col("lo"), F.col("hi"), conservative))])


def box_between(frame: Column, lo: Column, hi: Column, conservative: bool) -> list[Column]:
    """The sides of the box at ``frame`` between two samples, structs of s_frame and x1..y2 (null where there is none)."""
    exact = lo["s_frame"] == frame
    t = (frame - lo["s_frame"]) / (hi["s_frame"] - lo["s_frame"])

    def pick(i: int, c: str) -> Column:
        a, z = lo[c], hi[c]
        both = (F.least if i < 2 else F.greatest)(a, z) if conservative else F.when(
            a.isNotNull() & z.isNotNull(), (F.lit(1.0) - t) * a + t * z).otherwise(F.coalesce(a, z))
        return F.when(exact, a).otherwise(both)

    return [pick(i, c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]


def resample_plan(spans: DataFrame, clock: DataFrame, num: int, den: int, cuts: DataFrame | None = None, width_us: int = DAY_US) -> DataFrame:
    """Source frames behind every output frame of ``[in_us, out_us)`` at num/den frames per second.

    kind: copy (within half a millisecond), interp (between a and b at alpha), cut (the nearer side of a
    hard cut), hold (before the first / after the last frame). Times are compared in units of 1/num us, so
    every rate is exact. spans: asset_id, span_id, in_us, out_us; cuts: asset_id, frame (first of a new shot)."""
    count = F.greatest(F.lit(1), F.floor((F.col("out_us") - F.col("in_us")) * num / (1_000_000.0 * den) + 0.5).cast("bigint"))
    grid = spans.select("asset_id", "span_id", "in_us", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("k"))
    grid = grid.withColumn("t", F.col("in_us") * num + F.col("k") * (1_000_000 * den)).withColumn("probe", F.col("t") + COINCIDE_US * num)
    ticks = clock.select("asset_id", "frame", (F.col("pts_us") * num).alias("tick"))
    b = bracket_join(grid, ticks, ["asset_id"], "probe", "tick", ["frame", "tick"], width_us * num)
    gap = F.col("t") - F.col("lo.tick")
    alpha = gap / (F.col("hi.tick") - F.col("lo.tick"))
    kind = (F.when(F.col("lo").isNull(), "hold").when(F.abs(gap) <= COINCIDE_US * num, "copy").when(F.col("hi").isNotNull(), "interp").otherwise("hold"))
    out = b.select("asset_id", "span_id", "k", kind.alias("kind"), F.coalesce("lo.frame", "hi.frame").alias("a"),
                   F.when(kind == "interp", F.col("hi.frame")).alias("b"), F.when(kind == "interp", alpha).otherwise(0.0).alias("alpha"))
    if cuts is None:
        return out
    c = cuts.select("asset_id", F.col("frame").alias("b"), F.lit(True).alias("is_cut")).distinct()
    j = out.join(c, ["asset_id", "b"], "left")
    held = F.coalesce("is_cut", F.lit(False)) & (F.col("kind") == "interp")
    return j.select("asset_id", "span_id", "k", F.when(held, "cut").otherwise(F.col("kind")).alias("kind"),
                    F.when(held & (F.col("alpha") >= 0.5), F.col("b")).otherwise(F.col("a")).alias("a"),
                    F.when(~held, F.col("b")).alias("b"), "alpha")


def beats_in_spans(spans: DataFrame, beats: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """Beats inside ``[in_us, out_us)`` of a clip's source, moved onto the timeline."""
    hit = range_join(beats, spans, ["asset_id"], "time_us", "in_us", "out_us", width_us)
    return hit.withColumn("timeline_us", F.col("start_us") + F.col("time_us") - F.col("in_us"))


def trim_window(spans: DataFrame, beats: DataFrame, width_us: int = DAY_US) -> DataFrame:
    """Source window of length ``dur_us`` inside a shot: centred, or ending on the beat nearest to the
    centred end (the earlier beat on a tie) when one fits. spans: asset_id, span_id, in_us, out_us, dur_us."""
    centred = F.col("in_us") + (F.col("out_us") - F.col("in_us") + F.col("dur_us")) / 2.0
    s = spans.withColumn("centred", centred).withColumn("need_us", F.col("in_us") + F.col("dur_us"))
    hits = range_join(beats.select("asset_id", "time_us"), s.filter(F.col("dur_us") < F.col("out_us") - F.col("in_us")), ["asset_id"], "time_us",
                      "need_us", "out_us", width_us, closed_end=True)
    best = hits.groupBy("asset_id", "span_id").agg(F.min(F.struct(F.abs(F.col("time_us") - F.col("centred")).alias("d"), F.col("time_us").alias("beat"))).alias("best"))
    whole = F.col("dur_us") >= F.col("out_us") - F.col("in_us")
    end = F.coalesce(F.col("best.beat").cast("double"), F.col("centred"))
    return s.join(best, ["asset_id", "span_id"], "left").select(
        "asset_id", "span_id", F.when(whole, F.col("in_us").cast("double")).otherwise(end - F.col("dur_us")).alias("in_us"),
        F.when(whole, F.col("out_us").cast("double")).otherwise(end).alias("out_us"), F.col("best").isNotNull().alias("on_beat"))


def nearest_anchor(anchors: DataFrame, samples: DataFrame, width: int = BLOCK) -> DataFrame:
    """The dense sample nearest to every confirmed frame, the earlier one on a tie."""
    b = bracket_join(anchors, samples, ["asset_id"], "frame", "sample", ["sample"], width)
    lo, hi = F.col("lo.sample"), F.col("hi.sample")
    later = lo.isNull() | (hi - F.col("frame") < F.col("frame") - lo)
    return b.select(*anchors.columns, F.when(later & hi.isNotNull(), hi).otherwise(lo).alias("sample"))
