"""The full render plan: what every output frame shows, as rows per layer, crop, transform, grade, transition and effect.

Each project's output time is cut into elementary intervals: where no camera snap holds the picture, and, for each snap, where
it holds it at its start. Layers (with the handles that transitions need) meet these intervals once; keyframes cut the
pieces further, so that a piece lies between two neighbouring keys and carries both. Frames are listed last, from the
pieces: nothing is looked up per frame. Clips play at one constant speed (``factor``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions import playback as pb
from mediaframe.functions.easing import ease, lerp, unit_clamp
from mediaframe.operators.timeline import BUCKET_MS, end_ms
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of, interval_join, range_join
from mediaframe.session import cut_lineage

PIECE = ["project_id", "track_index", "clip_id", "f0", "f1", "hold_ms"]
MAP = ["start_ms", "dur_ms", "in_ms", "out_ms", "factor", "freeze_at", "freeze_hold", "reversed", "source_len"]
BUCKET_FRAMES = 2048


@dataclass(frozen=True)
class Grid:
    """Output frames: frame f shows the time start_ms + f * 1000 / fps."""

    fps: float
    start_ms: float = 0.0

    def frame_of(self, ms: Column) -> Column:
        """The first frame at or after a time."""
        return F.greatest(F.lit(0), F.ceil((ms - self.start_ms) * self.fps / 1000.0 - 1e-6)).cast("bigint")

    def time_of(self, frame: Column) -> Column:
        return F.lit(self.start_ms) + frame * (1000.0 / self.fps)


def held_intervals(snaps: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, f0, f1, hold_ms): frames on which a snap holds the picture at its start. The earliest snap that is
    still active holds, so a snap's turn comes when all that started before it are over."""
    s = snaps.select("project_id", "start_ms", end_ms().alias("end_ms")).filter(F.col("end_ms") > F.col("start_ms"))
    order, chunk = [F.col("start_ms"), F.col("end_ms")], bucket_of(F.col("start_ms"), BUCKET_MS)
    reach = scan.ordered_scan(s, ["project_id"], order, chunk, _reach=scan.running_max(F.col("end_ms")))
    over = scan.ordered_scan(reach, ["project_id"], order, chunk, _over=scan.lag(F.col("_reach")))
    f0 = grid.frame_of(F.greatest("start_ms", F.coalesce("_over", "start_ms")))
    out = over.select("project_id", f0.alias("f0"), grid.frame_of(F.col("end_ms")).alias("f1"), F.col("start_ms").cast("double").alias("hold_ms"))
    return out.filter(F.col("f1") > F.col("f0"))


def elementary_intervals(held: DataFrame, ends: DataFrame) -> DataFrame:
    """(project_id, f0, f1, hold_ms) that cover each project up to its last frame: held intervals and the free ones
    (``hold_ms`` null) around them. ends: project_id, last."""
    before = scan.ordered_scan(held, ["project_id"], [F.col("f0")], bucket_of(F.col("f0"), BUCKET_FRAMES), _from=scan.lag(F.col("f1")))
    none = F.lit(None).cast("double").alias("hold_ms")
    gaps = before.select("project_id", F.coalesce("_from", F.lit(0)).cast("bigint").alias("f0"), F.col("f0").alias("f1"), none)
    tail = ends.join(held.groupBy("project_id").agg(F.max("f1").alias("_to")), "project_id", "left")
    tail = tail.select("project_id", F.coalesce("_to", F.lit(0)).cast("bigint").alias("f0"), F.col("last").alias("f1"), none)
    return held.unionByName(gaps.unionByName(tail).filter(F.col("f1") > F.col("f0")))


def layer_spans(clips: DataFrame, transitions: DataFrame) -> DataFrame:
    """Visible video clips with ``from_ms`` and ``to_ms``: their span and half a transition more on sides that have one."""
    video = clips.filter((F.col("kind") == "video") & ~F.col("track_muted") & (F.col("out_ms") > F.col("in_ms")) & (F.col("dur_ms") > 0))
    real = transitions.filter(F.col("prev_id").isNotNull() & (F.col("dur_ms") > 0))
    pre = real.groupBy("project_id", "clip_id").agg((F.max("dur_ms") / 2).alias("_pre"))
    post = real.groupBy("project_id", F.col("prev_id").alias("clip_id")).agg((F.max("dur_ms") / 2).alias("_post"))
    j = video.join(pre, ["project_id", "clip_id"], "left").join(post, ["project_id", "clip_id"], "left")
    return j.withColumn("from_ms", F.col("start_ms") - F.coalesce("_pre", F.lit(0.0))).withColumn("to_ms", end_ms() + F.coalesce("_post", F.lit(0.0))).drop("_pre", "_post")


def place(spans: DataFrame, intervals: DataFrame, grid: Grid) -> DataFrame:
    """Spans (project_id, from_ms, to_ms in picture time) on the elementary intervals: one row per interval and span, with
    the output frames [f0, f1) and ``hold_ms``."""
    own = spans.withColumn("_s0", grid.frame_of(F.col("from_ms"))).withColumn("_s1", grid.frame_of(F.col("to_ms")))
    free = intervals.filter(F.col("hold_ms").isNull())
    moving = interval_join(own.filter(F.col("_s1") > F.col("_s0")), free, ["project_id"], ("_s0", "_s1"), ("f0", "f1"), BUCKET_FRAMES)
    moving = moving.withColumn("f0", F.greatest("f0", "_s0")).withColumn("f1", F.least("f1", "_s1")).drop("_s0", "_s1")
    held = range_join(intervals.filter(F.col("hold_ms").isNotNull()), spans, ["project_id"], "hold_ms", "from_ms", "to_ms", BUCKET_MS)
    return moving.unionByName(held.select(*moving.columns))


def project_intervals(spans: DataFrame, snaps: DataFrame, grid: Grid) -> DataFrame:
    """:func:`elementary_intervals` up to the end of each project's spans."""
    ends = spans.groupBy("project_id").agg(F.max(grid.frame_of(F.col("to_ms"))).alias("last"))
    return elementary_intervals(cut_lineage(held_intervals(snaps, grid)), ends)


def frames(pieces: DataFrame, grid: Grid) -> DataFrame:
    """One row per output frame of every piece, with the picture time it shows."""
    out = pieces.withColumn("frame", F.explode(F.sequence(F.col("f0"), F.col("f1") - 1))).drop("f0", "f1")
    return out.withColumn("video_ms", F.coalesce("hold_ms", grid.time_of(F.col("frame")))).drop("hold_ms")


def total_ms() -> Column:
    return pb.clip_duration(F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_hold"))


def mapped(df: DataFrame) -> DataFrame:
    """Rows with ``video_ms`` and the clip's map columns get _m: struct of local_ms, source_ms, rate, frozen."""
    return df.withColumn("_m", pb.source_extended(F.col("video_ms") - F.col("start_ms"), *(F.col(c) for c in ("in_ms", "out_ms", "factor", "freeze_at", "freeze_hold", "reversed", "source_len"))))


def layers(pieces: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, video_ms, local_ms, source_ms, rate, frozen, fade)."""
    m = mapped(frames(pieces, grid))
    fade = pb.video_fade(F.col("_m.local_ms"), F.col("dur_ms"), F.col("fade_in_ms"), F.col("fade_out_ms"))
    return m.select("project_id", "frame", "track_index", "clip_id", "video_ms", "_m.local_ms", "_m.source_ms", "_m.rate", "_m.frozen", fade.alias("fade"))


def key_spans(keys: DataFrame, by: list[str], payload: list[str]) -> DataFrame:
    """Each key with the next one: (by, lo, hi) as structs of ``payload``, which starts with the time; the stretch before
    the first key has no ``lo``. Keys of one group have different times."""
    at, window = F.col(payload[0]), Window.partitionBy(*by).orderBy(payload[0])
    # the keys are written once: they are counted and paired, and what reads their stretches does so twice
    rows = cut_lineage(keys.withColumn("lo", F.struct(*payload)))
    pair = lambda df: df.withColumns({"hi": F.lead("lo").over(window), "_before": F.lag(F.lit(1)).over(window)})
    long = cut_lineage(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > scan.WINDOW_ROWS).drop("_n"))
    if long.isEmpty():
        pairs = pair(rows)
    else:
        long = F.broadcast(long)  # at most one group in WINDOW_ROWS keys
        spread = scan.ordered_scan(rows.join(long, by, "left_semi"), by, [at], bucket_of(at, BUCKET_MS), hi=scan.lead(F.col("lo")), _before=scan.lag(F.lit(1)))
        pairs = pair(rows.join(long, by, "left_anti")).unionByName(spread)
    none = F.lit(None).cast(rows.schema["lo"].dataType)
    own, first = F.struct("lo", "hi"), F.struct(none.alias("lo"), F.col("lo").alias("hi"))
    return pairs.select(*by, F.explode(F.when(F.col("_before").isNull(), F.array(own, first)).otherwise(F.array(own))).alias("_s")).select(*by, "_s.lo", "_s.hi")


def between(pieces: DataFrame, stretches: DataFrame, grid: Grid) -> DataFrame:
    """Pieces cut by stretches (project_id, clip_id, t0, t1 in picture time): the frames of a piece on which its
    stretch holds. A held piece shows one time, so it meets one stretch."""
    held = F.col("hold_ms").isNotNull()
    p = pieces.withColumn("_a", F.coalesce("hold_ms", grid.time_of(F.col("f0")))).withColumn("_b", F.when(held, F.col("hold_ms") + 1e-6).otherwise(grid.time_of(F.col("f1"))))
    j = interval_join(p, stretches.filter(F.col("t1") > F.col("t0")), ["project_id", "clip_id"], ("_a", "_b"), ("t0", "t1"), BUCKET_MS)
    j = j.filter(~held | ((F.col("hold_ms") >= F.col("t0")) & (F.col("hold_ms") < F.col("t1"))))
    f0 = F.when(held, F.col("f0")).otherwise(F.greatest("f0", grid.frame_of(F.col("t0"))))
    f1 = F.when(held, F.col("f1")).otherwise(F.least("f1", grid.frame_of(F.col("t1"))))
    return j.withColumns({"f0": f0, "f1": f1}).filter(F.col("f1") > F.col("f0")).drop("_a", "_b", "t0", "t1")


def transforms(pieces: DataFrame, spans: DataFrame, keys: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, property, value): keyframed transforms; they hold outside their keys and
    in the handles. keys: clip_id, property, time_ms (clip-local), value, easing."""
    k = key_spans(keys.join(spans.select("clip_id"), "clip_id", "left_semi"), ["clip_id", "property"], ["time_ms", "value", "easing"])
    j = k.join(spans.select("project_id", "clip_id", "start_ms", "from_ms", "to_ms", total_ms().alias("_total")), "clip_id")
    lo, hi = F.col("lo.time_ms"), F.col("hi.time_ms")
    t0 = F.when(lo.isNull() | (lo <= 0), F.col("from_ms")).otherwise(F.col("start_ms") + lo)
    t1 = F.when(hi.isNull() | (hi > F.col("_total")), F.col("to_ms")).otherwise(F.col("start_ms") + hi)
    live = (lo.isNull() | (lo <= F.col("_total"))) & (hi.isNull() | (hi > 0))
    stretches = j.filter(live).select("project_id", "clip_id", "property", "lo", "hi", t0.cast("double").alias("t0"), t1.cast("double").alias("t1"))
    f = frames(between(pieces, stretches, grid), grid)
    local = F.least(F.greatest(F.col("video_ms") - F.col("start_ms"), F.lit(0.0)), total_ms())
    u = ease((local - lo) / (hi - lo), F.col("lo.easing"))
    value = F.when(lo.isNull(), F.col("hi.value")).when(hi.isNull(), F.col("lo.value")).otherwise(lerp(F.col("lo.value"), F.col("hi.value"), u))
    return f.select("project_id", "frame", "track_index", "clip_id", "property", value.alias("value"))


def crops(pieces: DataFrame, spans: DataFrame, keys: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, x1, y1, x2, y2): reframe crops at the source time, linear between keys and
    held outside. keys: clip_id, time_ms (source), x1..y2."""
    names = ["x1", "y1", "x2", "y2"]
    k = key_spans(keys.join(spans.select("clip_id"), "clip_id", "left_semi"), ["clip_id"], ["time_ms", *names])
    j = k.join(spans.select("project_id", "clip_id", "from_ms", "to_ms", *MAP), "clip_id")

    def local(source: Column) -> Column:
        """Where the clip first shows a source time, continued past its ends at its own speed."""
        play = F.when(F.col("reversed"), F.col("out_ms") - source).otherwise(source - F.col("in_ms")) * F.col("factor")
        return F.col("start_ms") + F.when(F.col("freeze_at").isNull() | (play <= F.col("freeze_at")), play).otherwise(play + F.col("freeze_hold"))

    a, b = local(F.col("lo.time_ms")), local(F.col("hi.time_ms"))
    before, after = F.when(F.col("reversed"), b).otherwise(a), F.when(F.col("reversed"), a).otherwise(b)
    # the source stops at the ends of its file: the stretch with such an end lasts as long as the clip shows
    limit = F.when(F.col("source_len") > 0, F.col("source_len")).otherwise(F.col("out_ms"))
    lo, hi = F.col("lo.time_ms"), F.col("hi.time_ms")
    holds = lambda at: (lo.isNull() | (lo <= at)) & (hi.isNull() | (hi > at))
    j = j.filter((hi.isNull() | (hi > 0)) & (lo.isNull() | (lo <= limit)))
    early, late = F.when(F.col("reversed"), holds(limit)).otherwise(holds(F.lit(0))), F.when(F.col("reversed"), holds(F.lit(0))).otherwise(holds(limit))
    t0 = F.when(early | before.isNull(), F.col("from_ms")).otherwise(F.greatest(before, F.col("from_ms")))
    t1 = F.when(late | after.isNull(), F.col("to_ms")).otherwise(F.least(after, F.col("to_ms")))
    stretches = j.select("project_id", "clip_id", "lo", "hi", t0.cast("double").alias("t0"), t1.cast("double").alias("t1"))
    m = mapped(frames(between(pieces, stretches, grid), grid))
    u = unit_clamp((F.col("_m.source_ms") - F.col("lo.time_ms")) / (F.col("hi.time_ms") - F.col("lo.time_ms")))
    pick = lambda c: F.when(F.col("lo").isNull(), F.col(f"hi.{c}")).when(F.col("hi").isNull(), F.col(f"lo.{c}")).otherwise(lerp(F.col(f"lo.{c}"), F.col(f"hi.{c}"), u))
    return m.select("project_id", "frame", "track_index", "clip_id", *(pick(c).alias(c) for c in names))


def grades(pieces: DataFrame, graded: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, sliders): the effective grade of every layer that has one. graded:
    project_id, clip_id and sliders (see :func:`mediaframe.operators.color.effective_grade`)."""
    sliders = [c for c in graded.columns if c not in ("project_id", "clip_id")]
    some = graded.select("project_id", "clip_id", F.struct(*sliders).alias("_g")).filter(" or ".join(f"coalesce(_g.{s}, 0) <> 0" for s in sliders))
    return frames(pieces.select(*PIECE).join(some, ["project_id", "clip_id"]), grid).select("project_id", "frame", "track_index", "clip_id", "_g.*")


def transitions_on(intervals: DataFrame, transitions: DataFrame, grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, prev_id, type, raw, progress): frames inside [cut - d/2, cut + d/2)."""
    t = transitions.filter(F.col("prev_id").isNotNull() & (F.col("dur_ms") > 0)).withColumn("from_ms", F.col("cut_ms") - F.col("dur_ms") / 2).withColumn("to_ms", F.col("cut_ms") + F.col("dur_ms") / 2)
    f = frames(place(t, intervals, grid), grid)
    raw = (F.col("video_ms") - F.col("from_ms")) / F.col("dur_ms")
    return f.select("project_id", "frame", "track_index", "clip_id", "prev_id", "type", raw.alias("raw"), pb.transition_progress(raw).alias("progress"))


def effects(clips: DataFrame, known: list[str], grid: Grid) -> DataFrame:
    """(project_id, frame, track_index, clip_id, effect, strength, amount): effects run in output time, not in picture time,
    stacked by ``track_index``; unknown ones are left out. clips: fx clips with effect and intensity."""
    c = clips.filter((F.col("kind") == "fx") & ~F.col("track_muted") & F.col("effect").isin(*known) & (F.col("dur_ms") > 0))
    p = c.withColumn("f0", grid.frame_of(F.col("start_ms"))).withColumn("f1", grid.frame_of(end_ms())).withColumn("hold_ms", F.lit(None).cast("double"))
    f = frames(p.filter(F.col("f1") > F.col("f0")), grid)
    t, d = F.col("video_ms") - F.col("start_ms"), F.col("dur_ms").cast("double")
    s = pb.effect_strength(F.col("effect"), F.col("intensity"), t, d)
    return f.select("project_id", "frame", "track_index", "clip_id", "effect", s.alias("strength"), pb.effect_amount(F.col("effect"), s, t, d).alias("amount"))


def render_plan(clips: DataFrame, transitions: DataFrame, snaps: DataFrame, grid: Grid, known_effects: list[str], keys: DataFrame | None = None,
                crop_keys: DataFrame | None = None, graded: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every kind of row by name: layers, transitions and effects, and transforms, crops and grades where their tables
    are given. clips: timeline columns with factor, freeze, reverse, fades, effect columns and ``source_len`` (0 = unknown);
    dur_ms is the length on the timeline."""
    # what every kind of row starts from is written once
    transitions = cut_lineage(transitions)
    spans = cut_lineage(layer_spans(clips, transitions))
    intervals = cut_lineage(project_intervals(spans, snaps, grid))
    pieces = place(spans.select("project_id", "track_index", "clip_id", "from_ms", "to_ms", *MAP, "fade_in_ms", "fade_out_ms"), intervals, grid)
    out = {"layers": layers(pieces, grid), "transitions": transitions_on(intervals, transitions, grid), "effects": effects(clips, known_effects, grid)}
    slim = pieces.drop("from_ms", "to_ms", "fade_in_ms", "fade_out_ms")
    if keys is not None:
        out["transforms"] = transforms(slim, spans, keys, grid)
    if crop_keys is not None:
        out["crops"] = crops(slim, spans, crop_keys, grid)
    if graded is not None:
        out["grades"] = grades(slim, graded, grid)
    return out
