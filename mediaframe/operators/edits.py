"""Bulk timeline edits: many projects at once, one instruction per row of an edits table.

Every edit applies to the whole link group of its clip (locked tracks stay out) and returns the edited clip
table; run :func:`mediaframe.operators.timeline.settle` on the result to pack tracks again. Clips carry the
timeline columns plus factor (timeline ms per source ms), freeze_at, freeze_hold, reversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import playback as pb
from mediaframe.functions.text import new_id
from mediaframe.operators import timeline as tl
from mediaframe.operators.clock import evaluate_keyframes
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of, range_join

MIN_CLIP_MS = 40
SPLIT_MARGIN_MS = 20
KEY_TOLERANCE_MS = 0.5


def _targets(clips: DataFrame, edits: DataFrame, cols: list[str]) -> DataFrame:
    """Clips of the edited link groups with the edit's columns (one edit per link group or single clip)."""
    own = clips.filter(~F.col("locked")).select("project_id", "clip_id", "link_id").join(edits, ["project_id", "clip_id"])
    single = own.select("project_id", "clip_id", *cols)
    group = own.filter(F.col("link_id").isNotNull()).select("project_id", "link_id", *cols)
    linked = clips.filter(~F.col("locked")).select("project_id", "clip_id", "link_id").join(group, ["project_id", "link_id"]).select("project_id", "clip_id", *cols)
    return single.unionByName(linked).dropDuplicates(["project_id", "clip_id"])


# --------------------------------------------------------------------------- moves


def move(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Move an anchor (project_id, clip_id, anchor_start, target_track nullable; one per project) and its link
    group by one delta, never before 0. A linked audio anchor hands over to its video member. Clips on the
    anchor's track go to the target track when it has the same kind."""
    live = clips.filter(~F.col("locked"))
    picked = live.join(edits, ["project_id", "clip_id"]).select("project_id", F.col("clip_id").alias("_edit"), "anchor_start", "target_track", F.struct("kind", "link_id", "start_ms", "track_index").alias("_a"))
    lead = live.filter((F.col("kind") == "video") & F.col("link_id").isNotNull()).groupBy("project_id", "link_id").agg(F.min(F.struct("track_index", "clip_id", "start_ms")).alias("_v"))
    d = picked.withColumn("link_id", F.col("_a.link_id")).join(lead, ["project_id", "link_id"], "left")
    handed = (F.col("_a.kind") != "video") & F.col("_v").isNotNull()
    d = d.select("project_id", "_edit", (F.col("anchor_start") - F.when(handed, F.col("_v.start_ms")).otherwise(F.col("_a.start_ms"))).alias("_delta"),
                 F.when(handed, F.lit(None).cast("bigint")).otherwise(F.col("target_track")).alias("_to"), F.col("_a.track_index").alias("_from"), F.col("_a.kind").alias("_kind"))
    kinds = clips.groupBy("project_id", F.col("track_index").alias("_to")).agg(F.first("kind").alias("_to_kind"), F.first("locked").alias("_to_locked"))
    d = d.join(kinds, ["project_id", "_to"], "left")
    moving = _targets(clips, edits.select("project_id", "clip_id"), []).withColumn("_moving", F.lit(True))
    j = clips.join(moving, ["project_id", "clip_id"], "left").join(d, "project_id", "left").withColumn("_moving", F.coalesce("_moving", F.lit(False)))
    floor = j.filter("_moving").groupBy("project_id").agg(F.min("start_ms").alias("_min"))
    j = j.join(floor, "project_id", "left")
    shift = F.greatest(F.col("_delta"), -F.col("_min"))
    retrack = F.col("_moving") & (F.col("track_index") == F.col("_from")) & (F.col("_to_kind") == F.col("_kind")) & ~F.col("_to_locked")
    out = {"start_ms": F.when(F.col("_moving"), F.greatest(F.lit(0), F.col("start_ms") + shift)).otherwise(F.col("start_ms")),
           "track_index": F.when(F.coalesce(retrack, F.lit(False)), F.col("_to")).otherwise(F.col("track_index"))}
    return j.select(*[out.get(c, F.col(c)).alias(c) for c in clips.columns])


def insert_reorder(clips: DataFrame, edits: DataFrame, main_track: int = 0) -> DataFrame:
    """Magnet move on the main track: the block of moving clips goes before the first other clip whose centre
    is at or after the block's centre, then everything is packed from 0. Same edits as :func:`move`."""
    main = clips.filter(F.col("track_index") == main_track)
    moving = _targets(clips, edits.select("project_id", "clip_id"), []).withColumn("_moving", F.lit(True))
    m = main.join(moving, ["project_id", "clip_id"], "left").withColumn("_moving", F.coalesce("_moving", F.lit(False)))
    anchor = m.filter("_moving").join(edits.select("project_id", "clip_id", "anchor_start"), ["project_id", "clip_id"]).select("project_id", "anchor_start", F.col("start_ms").alias("_anchor"))
    block = m.filter("_moving").groupBy("project_id").agg(F.min("start_ms").alias("_first"), F.sum("dur_ms").alias("_len")).join(anchor, "project_id")
    block = block.select("project_id", (F.col("anchor_start") - (F.col("_anchor") - F.col("_first")) + F.col("_len") / 2).alias("_centre"))
    j = m.join(block, "project_id")
    mid = F.col("start_ms") + F.col("dur_ms") / 2
    pivot = j.filter(~F.col("_moving") & (mid >= F.col("_centre"))).groupBy("project_id").agg(F.min(F.struct("start_ms", "clip_id")).alias("_pivot"))
    j = j.join(pivot, "project_id", "left")
    part = F.when(F.col("_moving"), 1).when(F.col("_pivot").isNull() | (F.struct("start_ms", "clip_id") < F.col("_pivot")), 0).otherwise(2)
    j = j.withColumn("_part", part)
    packed = scan.ordered_scan(j, ["project_id"], [F.col("_part"), F.col("start_ms"), F.col("clip_id")],
                               F.col("_part").cast("bigint") * (1 << 40) + bucket_of(F.col("start_ms"), tl.BUCKET_MS), new_start=scan.prefix_sum(F.col("dur_ms")))
    placed = packed.select("project_id", "clip_id", F.col("new_start").alias("_new"))
    return clips.join(placed, ["project_id", "clip_id"], "left").select(
        *[F.coalesce("_new", "start_ms").alias(c) if c == "start_ms" else F.col(c) for c in clips.columns])


# --------------------------------------------------------------------------- trims and splits


def trim(clips: DataFrame, edits: DataFrame, magnet: bool) -> DataFrame:
    """Move a clip edge by ``delta_ms`` of timeline time. Speed, reverse, freeze, source length (asset_ms, null
    = unbounded) and a 40 ms minimum are respected. edits: project_id, clip_id, edge (in / out), delta_ms.

    Adds trimmed_ms, the change of the clip's timeline length."""
    j = clips.join(_targets(clips, edits, ["edge", "delta_ms"]), ["project_id", "clip_id"], "left")
    d = lambda c: F.col(c).cast("double")
    in_, out_, k, at, hold, start, dur = d("in_ms"), d("out_ms"), d("factor"), d("freeze_at"), d("freeze_hold"), d("start_ms"), d("dur_ms")
    top = F.coalesce(d("asset_ms"), F.lit(float("inf")))
    rev, fz, delta = F.col("reversed"), F.col("freeze_at").isNotNull(), d("delta_ms")
    rng, min_src = out_ - in_, F.lit(float(MIN_CLIP_MS)) / k

    # out edge
    room_o = F.when(rev, in_).otherwise(top - out_)
    do = F.greatest(F.lit(float(MIN_CLIP_MS)) - dur, F.least(room_o * k, delta))
    total = dur + do
    tail = dur - at - hold
    inside_hold = fz & (do < 0) & (total < at + hold) & (total > at)
    before_hold = fz & (do < 0) & (total <= at)
    play = F.when(inside_hold, -tail).when(before_hold, total - (dur - hold)).otherwise(do)
    src_o = play / k
    src_o = F.when(rng + src_o < min_src, F.least(F.lit(0.0), min_src - rng)).otherwise(src_o)
    out_edge = F.struct(
        start.alias("start_ms"), F.when(rev, F.greatest(F.lit(0.0), in_ - src_o)).otherwise(in_).alias("in_ms"),
        F.when(rev, out_).otherwise(F.least(top, out_ + src_o)).alias("out_ms"),
        F.when(~before_hold, at).alias("freeze_at"), F.when(inside_hold, total - at).when(~before_hold, hold).alias("freeze_hold"))

    # in edge
    room_i = F.when(rev, top - out_).otherwise(in_)
    di = F.least(dur - MIN_CLIP_MS, F.greatest(-room_i * k, delta))
    early, in_hold = ~fz | (di <= at), fz & (di > at) & (di < at + hold)
    src_i = F.when(early, di / k).when(in_hold, at / k).otherwise((di - hold) / k)
    src_i = F.when(rng - src_i < min_src, F.greatest(F.lit(0.0), rng - min_src)).otherwise(src_i)
    in_edge = F.struct(
        (start if magnet else F.greatest(F.lit(0.0), start + di)).alias("start_ms"),
        F.when(rev, in_).otherwise(F.greatest(F.lit(0.0), in_ + src_i)).alias("in_ms"),
        F.when(rev, F.least(top, out_ - src_i)).otherwise(out_).alias("out_ms"),
        F.when(early, at - di).when(in_hold, 0.0).alias("freeze_at"), F.when(early, hold).when(in_hold, at + hold - di).alias("freeze_hold"))

    same = F.struct(start.alias("start_ms"), in_.alias("in_ms"), out_.alias("out_ms"), at.alias("freeze_at"), hold.alias("freeze_hold"))
    j = j.withColumn("_t", F.when(F.col("edge") == "out", out_edge).when(F.col("edge") == "in", in_edge).otherwise(same))
    new_dur = pb.clip_duration(F.col("_t.in_ms"), F.col("_t.out_ms"), k, F.col("_t.freeze_hold"))
    fresh = {c: F.col(f"_t.{c}") for c in ("start_ms", "in_ms", "out_ms", "freeze_at", "freeze_hold")} | {"dur_ms": F.when(F.col("edge").isNull(), dur).otherwise(new_dur)}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns], (fresh["dur_ms"] - dur).alias("trimmed_ms"))


def split_targets(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Clips with the cut of their link group (``at_ms``, null without one)."""
    return clips.join(_targets(clips, edits, ["at_ms"]), ["project_id", "clip_id"], "left")


def split_play() -> Column:
    """Output time up to the cut, without the freeze."""
    local = F.col("at_ms") - F.col("start_ms")
    at, hold, fz = F.col("freeze_at"), F.col("freeze_hold"), F.col("freeze_at").isNotNull()
    return F.when(fz & (local > at) & (local < at + hold), at).when(fz & (local > at), local - hold).otherwise(local)


def split(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Split clips and their link partners at ``at_ms`` (timeline). Both halves meet on one source time; the
    freeze is divided; the left half keeps the fade-in, the right one the fade-out; the right half drops the
    transition and gets a derived id and link. edits: project_id, clip_id, at_ms. Adds ``half`` (whole / left /
    right), clip_key (text id) and link_key. Clips have one constant speed; for ramps see
    :func:`mediaframe.operators.ramps.split`."""
    return split_at(split_targets(clips, edits), clips.columns, split_play() / F.col("factor"))


def split_at(j: DataFrame, columns: list[str], offset: Column, keep: list[str] | None = None) -> DataFrame:
    """The halves of :func:`split_targets` rows, cut ``offset`` ms into their source. ``keep`` names columns to pass on;
    ``_range`` is the length of the source before the cut."""
    local = F.col("at_ms") - F.col("start_ms")
    cut = F.coalesce((local > SPLIT_MARGIN_MS) & (local < F.col("dur_ms") - SPLIT_MARGIN_MS), F.lit(False))
    at, hold, fz = F.col("freeze_at"), F.col("freeze_hold"), F.col("freeze_at").isNotNull()
    before, within = fz & (local <= at), fz & (local > at) & (local < at + hold)
    src = F.col("out_ms") - F.col("in_ms")
    off = F.greatest(F.lit(0.0), F.least(src.cast("double"), offset))
    point = F.when(F.col("reversed"), F.col("out_ms") - off).otherwise(F.col("in_ms") + off)
    rev = F.col("reversed")
    base = lambda half, **kw: F.struct(F.lit(half).alias("half"), *[
        kw.get(c, F.col(c)).cast("double").alias(c) for c in ("start_ms", "in_ms", "out_ms", "freeze_at", "freeze_hold", "fade_in_ms", "fade_out_ms", "dur_ms")])
    none = F.lit(None).cast("double")
    left = base("left", in_ms=F.when(rev, point).otherwise(F.col("in_ms")), out_ms=F.when(rev, F.col("out_ms")).otherwise(point), fade_out_ms=none, dur_ms=local,
                freeze_at=F.when(~before, at), freeze_hold=F.when(within, local - at).when(~before, hold))
    right = base("right", start_ms=F.col("at_ms"), in_ms=F.when(rev, F.col("in_ms")).otherwise(point), out_ms=F.when(rev, point).otherwise(F.col("out_ms")), fade_in_ms=none,
                 dur_ms=F.col("dur_ms") - local, freeze_at=F.when(before, at - local).when(within, 0), freeze_hold=F.when(before, hold).when(within, at + hold - local))
    out = j.withColumn("_range", src.cast("double")).withColumn("_h", F.explode(F.when(cut, F.array(left, right)).otherwise(F.array(base("whole")))))
    is_right = F.col("_h.half") == "right"
    fresh = {c: F.col(f"_h.{c}") for c in ("start_ms", "in_ms", "out_ms", "freeze_at", "freeze_hold", "fade_in_ms", "fade_out_ms", "dur_ms")}
    fresh["transition_type"] = F.when(~is_right, F.col("transition_type")) if "transition_type" in columns else None
    own, link = F.col("clip_id").cast("string"), F.col("link_id").cast("string")
    return out.select(*[fresh[c].alias(c) if fresh.get(c) is not None else F.col(c) for c in columns], F.col("_h.half").alias("half"),
                      F.when(is_right, new_id("clp", F.col("project_id"), own, F.col("at_ms"))).otherwise(own).alias("clip_key"),
                      F.when(is_right & link.isNotNull(), new_id("lnk", F.col("project_id"), link, F.col("at_ms"))).otherwise(link).alias("link_key"), *(keep or []))


def delete(clips: DataFrame, edits: DataFrame, magnet: bool, main_track: int = 0) -> DataFrame:
    """Remove clips with their link group. With the magnet, the gaps on other tracks close: every later clip
    moves left by the removed durations that end at or before its start (tracks without overlaps)."""
    gone = _targets(clips, edits.select("project_id", "clip_id"), []).withColumn("_gone", F.lit(True))
    j = clips.join(gone, ["project_id", "clip_id"], "left")
    kept = j.filter(F.col("_gone").isNull()).drop("_gone")
    if not magnet:
        return kept
    dead = j.filter(F.col("_gone") & (F.col("track_index") != main_track))
    marks = dead.select(*tl.TRACK, tl.end_ms().alias("_t"), F.lit(0).alias("_side"), F.col("dur_ms").alias("_cut"), F.lit(None).cast(kept.select(F.struct(*kept.columns)).schema[0].dataType).alias("_row"))
    rows = kept.select(*tl.TRACK, F.col("start_ms").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_cut"), F.struct(*kept.columns).alias("_row"))
    swept = scan.ordered_scan(marks.unionByName(rows), tl.TRACK, [F.col("_t"), F.col("_side")], bucket_of(F.col("_t"), tl.BUCKET_MS), _gap=scan.running_sum(F.col("_cut")))
    out = swept.filter(F.col("_side") == 1).select("_row.*", "_gap")
    return out.select(*[F.greatest(F.lit(0), F.col("start_ms") - F.col("_gap")).alias(c) if c == "start_ms" else F.col(c) for c in kept.columns])


# --------------------------------------------------------------------------- speed, freeze, reverse


def set_speed(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """New constant speed (edits: project_id, clip_id, speed): the freeze stays on its source frame."""
    j = clips.join(_targets(clips, edits, ["speed"]), ["project_id", "clip_id"], "left")
    new = F.when(F.col("speed").isNotNull(), F.lit(1.0) / F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.col("speed")))).otherwise(F.col("factor"))
    fresh = {"factor": new, "freeze_at": F.col("freeze_at") / F.col("factor") * new,
             "dur_ms": F.when(F.col("speed").isNotNull(), pb.clip_duration(F.col("in_ms"), F.col("out_ms"), new, F.col("freeze_hold"))).otherwise(F.col("dur_ms").cast("double"))}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])


def freeze(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Freeze at a timeline time, replacing an existing freeze. edits: project_id, clip_id, at_ms, hold_ms."""
    j = clips.join(_targets(clips, edits, ["at_ms", "hold_ms"]), ["project_id", "clip_id"], "left")
    local = F.greatest(F.lit(0), F.least(F.col("dur_ms"), F.col("at_ms") - F.col("start_ms")))
    at = F.greatest(F.lit(0), pb.local_to_play(local, F.col("freeze_at"), F.col("freeze_hold")))
    on = F.col("at_ms").isNotNull()
    fresh = {"freeze_at": F.when(on, at).otherwise(F.col("freeze_at")), "freeze_hold": F.when(on, F.col("hold_ms")).otherwise(F.col("freeze_hold")),
             "dur_ms": F.when(on, F.col("dur_ms") - pb.zero(F.col("freeze_hold")) + F.col("hold_ms")).otherwise(F.col("dur_ms"))}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])


def toggle_reverse(clips: DataFrame, edits: DataFrame) -> DataFrame:
    j = clips.join(_targets(clips, edits.select("project_id", "clip_id"), []).withColumn("_on", F.lit(True)), ["project_id", "clip_id"], "left")
    return j.select(*[(F.col("reversed") != F.coalesce("_on", F.lit(False))).alias(c) if c == "reversed" else F.col(c) for c in clips.columns])


# --------------------------------------------------------------------------- transitions


def set_transition(clips: DataFrame, edits: DataFrame, frame_ms: float) -> DataFrame:
    """Set (type null: remove) the transition into a clip. Refused without a directly preceding clip on an
    unlocked video track. edits: project_id, clip_id, new_type, new_ms."""
    prev = tl.previous_clips(clips.filter((F.col("kind") == "video") & ~F.col("locked")), frame_ms)
    e = edits.select("project_id", "clip_id", F.struct("new_type", "new_ms").alias("_e"))
    j = clips.join(e, ["project_id", "clip_id"], "left").join(prev, ["project_id", "clip_id"], "left")
    allowed = F.col("_e").isNotNull() & (F.col("kind") == "video") & ~F.col("locked")
    off, on = allowed & F.col("_e.new_type").isNull(), allowed & F.col("_e.new_type").isNotNull() & F.col("prev_id").isNotNull()
    fresh = {"transition_type": F.when(off, F.lit(None).cast("string")).when(on, F.col("_e.new_type")).otherwise(F.col("transition_type")),
             "transition_ms": F.when(off, F.lit(None).cast("bigint")).when(on, pb.clamp_transition(F.col("_e.new_ms"), F.col("prev_dur_ms"), F.col("dur_ms"))).otherwise(F.col("transition_ms"))}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])


def set_transition_on_all_cuts(clips: DataFrame, kind: str, ms: int, frame_ms: float, track: int = 0) -> DataFrame:
    """The same transition on every cut of one track."""
    t = clips.filter((F.col("track_index") == track) & (F.col("kind") == "video")).select("project_id", "clip_id", F.lit(kind).alias("new_type"), F.lit(ms).cast("bigint").alias("new_ms"))
    return set_transition(clips, t, frame_ms)


def reconcile_transitions(after: DataFrame, before: DataFrame, frame_ms: float, known: list[str]) -> DataFrame:
    """Keep a transition only while its clip still directly follows the clip it followed before (or that
    clip's split half: a new id with the same asset and playback end); clamp its length."""
    end = F.when(F.col("reversed"), F.col("in_ms")).otherwise(F.col("out_ms"))
    now = tl.previous_clips(after.filter(F.col("kind") == "video"), frame_ms)
    was = tl.previous_clips(before.filter(F.col("kind") == "video"), frame_ms).select("project_id", "clip_id", F.col("prev_id").alias("_was"))
    old_track = before.select("project_id", "clip_id", F.col("track_index").alias("_old_track"))
    ends = lambda df, n: df.select("project_id", F.col("clip_id").alias(n), F.struct("asset_id", end.alias("end")).alias(f"{n}_end"))
    j = after.join(now, ["project_id", "clip_id"], "left").join(was, ["project_id", "clip_id"], "left").join(old_track, ["project_id", "clip_id"], "left")
    j = j.join(ends(after, "prev_id"), ["project_id", "prev_id"], "left").join(ends(before, "_was"), ["project_id", "_was"], "left")
    j = j.join(before.select("project_id", F.col("clip_id").alias("prev_id"), F.lit(True).alias("_prev_old")), ["project_id", "prev_id"], "left")
    half = F.col("_prev_old").isNull() & (F.col("prev_id_end.asset_id") == F.col("_was_end.asset_id")) & (F.abs(F.col("prev_id_end.end") - F.col("_was_end.end")) < 1)
    same = F.col("_old_track").isNull() | ((F.col("_old_track") == F.col("track_index")) & (F.col("_was").isNull() | (F.col("_was") == F.col("prev_id")) | F.coalesce(half, F.lit(False))))
    keep = F.col("transition_type").isNotNull() & (F.col("kind") == "video") & F.col("prev_id").isNotNull() & F.coalesce(same, F.lit(False))
    fresh = {"transition_type": F.when(keep, F.when(F.col("transition_type").isin(*known), F.col("transition_type")).otherwise("dissolve")),
             "transition_ms": F.when(keep, pb.clamp_transition(F.col("transition_ms"), F.col("prev_dur_ms"), F.col("dur_ms")))}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in after.columns])


# --------------------------------------------------------------------------- keyframes


def set_keyframe(keys: DataFrame, edits: DataFrame, tolerance=KEY_TOLERANCE_MS, remove: bool = False, width=86_400_000_000) -> DataFrame:
    """Insert or replace (or with ``remove`` only drop) the keyframe of a clip at a time. edits: the columns of
    keys (clip_id, time_us, value, easing); keyframes within the tolerance of an edit go."""
    e = edits.select("clip_id", (F.col("time_us") - tolerance).alias("_lo"), (F.col("time_us") + tolerance).alias("_hi"))
    gone = range_join(keys.select("clip_id", "time_us"), e, ["clip_id"], "time_us", "_lo", "_hi", width, closed_end=True).select("clip_id", "time_us").distinct()
    kept = keys.join(gone, ["clip_id", "time_us"], "left_anti")
    return kept if remove else kept.unionByName(edits.select(*keys.columns))


def split_keyframes(keys: DataFrame, cuts: DataFrame, tolerance, width) -> DataFrame:
    """Keyframes of both halves of split clips: each half holds the value at the cut. cuts: clip_id, at_us.

    Adds ``half``; times of the right half start at the cut. An existing keyframe near the cut moves onto it."""
    j = keys.join(cuts, "clip_id")
    gap = F.col("time_us") - F.col("at_us")
    left = j.filter(gap < -tolerance).select("clip_id", F.lit("left").alias("half"), "time_us", "value", "easing")
    right = j.filter(gap > tolerance).select("clip_id", F.lit("right").alias("half"), gap.alias("time_us"), "value", "easing")
    near = j.filter(F.abs(gap) <= tolerance).groupBy("clip_id").agg(F.min(F.struct("time_us", "value", "easing")).alias("_k"))
    value = evaluate_keyframes(cuts, keys, "at_us", width)
    first = keys.groupBy("clip_id").agg(F.min(F.struct("time_us", "easing")).alias("_first"))
    upto = j.filter(gap <= 0).groupBy("clip_id").agg(F.max(F.struct("time_us", "easing")).alias("_prev"))
    at = value.join(near, "clip_id", "left").join(first, "clip_id").join(upto, "clip_id", "left").select(
        "clip_id", "at_us", F.coalesce("_k.value", "value").alias("value"), F.coalesce("_k.easing", "_prev.easing", "_first.easing").alias("easing"))
    ends = at.select("clip_id", F.explode(F.array(F.struct(F.lit("left").alias("half"), F.col("at_us").alias("time_us")), F.struct(F.lit("right").alias("half"), F.lit(0).cast("bigint").alias("time_us")))).alias("_e"), "value", "easing").select(
        "clip_id", "_e.half", "_e.time_us", "value", "easing")
    return left.unionByName(right).unionByName(ends)


def retime_keyframes(keys: DataFrame, timing: DataFrame) -> DataFrame:
    """Keep keyframes on their source frames when speed or freeze change. timing: clip_id, old_factor, old_at,
    old_hold, new_factor, new_at, new_hold. keys use clip-local ``time_ms``."""
    j = keys.join(timing, "clip_id", "left")
    t = F.col("time_ms")
    play = pb.local_to_play(t, F.col("old_at"), F.col("old_hold"))
    np_ = play / F.col("old_factor") * F.col("new_factor")
    in_hold = F.coalesce((t > F.col("old_at")) & (t < F.col("old_at") + F.col("old_hold")), F.lit(False))
    new = F.when(F.col("new_at").isNull(), np_).when(in_hold, F.col("new_at") + (t - F.col("old_at"))).when(np_ <= F.col("new_at") + 0.001, np_).otherwise(np_ + F.col("new_hold"))
    return j.select(*[F.when(F.col("old_factor").isNull(), t).otherwise(new).alias(c) if c == "time_ms" else F.col(c) for c in keys.columns])


# --------------------------------------------------------------------------- attributes, stems, rough cuts


def audio_mirrors(clips: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen clips and the members of their link groups that play the same asset."""
    own = clips.join(chosen, ["project_id", "clip_id"], "left_semi")
    pairs = clips.join(own.filter(F.col("link_id").isNotNull()).select("project_id", "link_id", "asset_id").distinct(), ["project_id", "link_id", "asset_id"], "left_semi")
    return own.select("project_id", "clip_id").union(pairs.select("project_id", "clip_id")).distinct()


def set_voice_mode(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: project_id, clip_id, mode; the mirrored audio clip changes along."""
    m = tl.mirror_of(clips).join(edits, ["project_id", "clip_id"]).select("project_id", F.explode(F.array("clip_id", "mirror_id")).alias("clip_id"), "mode").filter(F.col("clip_id").isNotNull())
    m = m.groupBy("project_id", "clip_id").agg(F.max("mode").alias("_mode"))
    return clips.join(m, ["project_id", "clip_id"], "left").withColumn("voice", F.coalesce("_mode", "voice")).drop("_mode")


def apply_grade_to_all(clips: DataFrame, edits: DataFrame, same_source_only: bool = False) -> DataFrame:
    """Copy the grade of one clip per project (edits: project_id, clip_id) to all unlocked video clips."""
    src = clips.join(edits, ["project_id", "clip_id"], "left_semi").select("project_id", F.col("grade_id").alias("_g"), F.col("asset_id").alias("_a"))
    j = clips.join(src, "project_id", "left")
    hit = F.col("_g").isNotNull() & (F.col("kind") == "video") & ~F.col("locked")
    if same_source_only:
        hit = hit & (F.col("asset_id") == F.col("_a"))
    return j.withColumn("grade_id", F.when(hit, F.col("_g")).otherwise(F.col("grade_id"))).drop("_g", "_a")


def paste_attributes(clips: DataFrame, edits: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Copy attribute columns from source clips (edits: project_id, clip_id, source_id, parts array<string>).
    ``columns`` maps a part name to the columns it copies."""
    every = sorted({c for cols in columns.values() for c in cols})
    s = clips.select("project_id", F.col("clip_id").alias("source_id"), F.struct(*every).alias("_s"))
    j = clips.join(edits, ["project_id", "clip_id"], "left").join(s, ["project_id", "source_id"], "left")
    fresh = {}
    for part, cols in columns.items():
        take = F.col("_s").isNotNull() & F.array_contains("parts", part) & ~F.col("locked")
        for c in cols:
            fresh[c] = F.when(F.coalesce(take, F.lit(False)), F.col(f"_s.{c}")).otherwise(F.col(c))
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])


def separate_to_tracks(clips: DataFrame, assets: DataFrame, chosen: DataFrame) -> DataFrame:
    """New stem clips (vocals, background) aligned with each chosen video clip that has separated stems, and
    the original audio muted. Returns the whole clip table with role, stem and muted filled in; stems go to
    one role track per project, the first where the span is free (role_lane counts further lanes).

    assets: asset_id, vocals, background; clips need voice and muted."""
    anchor = clips.join(chosen, ["project_id", "clip_id"], "left_semi").filter(F.col("kind") == "video").join(assets.filter(F.col("vocals").isNotNull()), "asset_id")
    mirror = tl.mirror_of(clips).filter(F.col("link_id").isNotNull() & F.col("mirror_id").isNotNull()).select("project_id", "clip_id", "mirror_id")
    m = anchor.join(mirror, ["project_id", "clip_id"], "left")
    orig = clips.select("project_id", F.col("clip_id").alias("mirror_id"), F.struct("muted", "voice").alias("_o"))
    m = m.join(orig, ["project_id", "mirror_id"], "left")
    muted, voice = F.coalesce("_o.muted", "muted"), F.coalesce("_o.voice", "voice")
    stems = m.withColumn("_stem", F.explode(F.array(F.lit("vocals"), F.lit("background"))))
    silent = muted | ((voice == "voice") & (F.col("_stem") == "background")) | ((voice == "background") & (F.col("_stem") == "vocals"))
    lanes = _lanes(stems.filter(F.col("_stem") == "vocals").select("project_id", "clip_id", "start_ms", "dur_ms"))
    new = stems.join(lanes, ["project_id", "clip_id"]).select(
        "project_id", new_id("clp", F.col("project_id"), F.col("clip_id"), F.col("_stem")).alias("clip_key"), F.col("clip_id"), F.col("_stem").alias("stem"),
        F.when(F.col("_stem") == "vocals", "voice").otherwise("background").alias("role"), "lane", silent.alias("muted"), "start_ms", "in_ms", "out_ms", "dur_ms")
    quiet = m.select("project_id", F.coalesce("mirror_id", "clip_id").alias("clip_id")).distinct().withColumn("_quiet", F.lit(True))
    old = clips.join(quiet, ["project_id", "clip_id"], "left").select(
        "project_id", F.col("clip_id").cast("string").alias("clip_key"), "clip_id", F.lit(None).cast("string").alias("stem"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("bigint").alias("lane"),
        (F.col("muted") | F.coalesce("_quiet", F.lit(False))).alias("muted"), "start_ms", "in_ms", "out_ms", "dur_ms")
    return old.unionByName(new.select(*old.columns))


def _lanes(spans: DataFrame) -> DataFrame:
    """First free lane for spans in start order; the state is one end time per lane."""
    from mediaframe.plans.sequential import Processor, sequential

    class Lanes(Processor):
        def start(self, key):
            self.key, self.ends = key[0], []

        def feed(self, cols):
            lanes = []
            for s, d in zip(cols["start_ms"], cols["dur_ms"]):
                for i, e in enumerate(self.ends):
                    if e <= s + 0.001:
                        break
                else:
                    i = len(self.ends)
                    self.ends.append(0)
                self.ends[i] = s + d
                lanes.append(i)
            return {"project_id": [self.key] * len(lanes), "clip_id": cols["clip_id"], "lane": lanes}

    return sequential(spans, ["project_id"], ["start_ms", "clip_id"], "project_id bigint, clip_id bigint, lane bigint", Lanes)


def rough_cut(assets: DataFrame) -> DataFrame:
    """Video assets one after another in story order, each with a linked audio clip when it has sound.

    assets: project_id, asset_id, story_pos, duration_ms, has_audio."""
    placed = scan.ordered_scan(assets, ["project_id"], [F.col("story_pos")], bucket_of(F.col("story_pos"), 4096), start_ms=scan.prefix_sum(F.col("duration_ms")))
    kinds = F.when(F.col("has_audio"), F.array(F.lit("video"), F.lit("audio"))).otherwise(F.array(F.lit("video")))
    return placed.withColumn("kind", F.explode(kinds)).select(
        "project_id", "asset_id", "kind", "start_ms", F.lit(0).cast("bigint").alias("in_ms"), F.col("duration_ms").alias("out_ms"),
        F.when(F.col("has_audio"), new_id("lnk", F.col("project_id"), F.col("asset_id"))).alias("link_key"))


def apply_analysis(current: dict[str, DataFrame], analysis: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge an analysed timeline into projects: assets by path, tracks (clips) and beats replaced where the
    analysis brings a project, missing links inferred. Tables: assets (path_key...), clips, beats."""
    fresh = analysis["clips"].select("project_id").distinct()
    clips = current["clips"].join(fresh, "project_id", "left_anti").unionByName(analysis["clips"])
    pairs = tl.infer_links(clips).select("project_id", "audio_id", "video_id")
    both = pairs.select("project_id", F.explode(F.array("audio_id", "video_id")).alias("clip_id"), F.col("video_id").alias("_link"))
    linked = clips.join(both, ["project_id", "clip_id"], "left").withColumn("link_id", F.coalesce("link_id", "_link")).drop("_link")
    done = analysis["projects"].select("project_id") if "projects" in analysis else fresh
    beats = current["beats"].join(done, "project_id", "left_anti").unionByName(analysis["beats"])
    return {"assets": tl.merge_assets(current["assets"], analysis["assets"]), "clips": linked, "beats": beats}
