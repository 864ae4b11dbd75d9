"""Edits and lookups of clips whose speed is a ramp.

A ramp is the clip column ``speed``, array<struct<x, y>> of (source position 0..1, speed); null means the constant ``factor``.
Each distinct curve of a batch becomes one table of monotone pieces (source position and output time reached); clips
read it both ways where they lie: output time to source offset and back. ``factor`` is kept at the curve's
timeline ms per source ms, so everything that only needs lengths works on ramped clips unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import playback as pb
from mediaframe.operators import edits as ed
from mediaframe.operators import speed as sp
from mediaframe.operators import timeline as tl
from mediaframe.session import cut_lineage

SAMPLES = 512
#: A cut part of a curve is sampled so finely that its length stays within a millisecond.
PARTS = 64
RAMP = "array<struct<x:double,y:double>>"


def play_to_source(df: DataFrame, play: Column, out: str, points: str = "speed", factor: str = "factor", samples: int = SAMPLES) -> DataFrame:
    """``df`` (clips) with ``out``: the source offset after ``play`` ms of output, freeze not counted."""
    src = (F.col("out_ms") - F.col("in_ms")).cast("double")
    ramped = sp.curve_source(F.col(points), play.cast("double") / src, samples) * src
    plain = F.least(F.greatest(play / F.col(factor), F.lit(0.0)), src)
    return df.withColumn(out, F.when(F.col(points).isNotNull(), ramped).otherwise(plain.cast("double")))


def source_to_play(df: DataFrame, offset: Column, out: str, points: str = "speed", factor: str = "factor", samples: int = SAMPLES) -> DataFrame:
    """``df`` (clips) with ``out``: the output time at which a source offset is reached, freeze not counted."""
    src = (F.col("out_ms") - F.col("in_ms")).cast("double")
    ramped = sp.curve_output(F.col(points), offset.cast("double") / src, samples) * src
    return df.withColumn(out, F.when(F.col(points).isNotNull(), ramped).otherwise((offset * F.col(factor)).cast("double")))


def with_factor(clips: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``factor`` and ``dur_ms`` of ramped clips from their curves; other clips stay as they are."""
    j = clips.withColumn("_factor", sp.curve_factor(F.col("speed"), samples))
    new = F.coalesce("_factor", "factor")
    dur = pb.clip_duration(F.col("in_ms"), F.col("out_ms"), new, F.col("freeze_hold"))
    fresh = {"factor": new, "dur_ms": F.when(F.col("_factor").isNotNull(), dur).otherwise(F.col("dur_ms").cast("double"))}
    return j.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])


def source_at(times: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Rows (clip columns and ``local``) with source_ms, rate and frozen. The rate is the curve's speed there."""
    total = pb.clip_duration(F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_hold"))
    rows = times.withColumn("_t", F.least(F.greatest(F.col("local").cast("double"), F.lit(0.0)), total))
    play = pb.local_to_play(F.col("_t"), F.col("freeze_at"), F.col("freeze_hold"))
    o = play_to_source(rows, play, "_off", samples=samples)
    src = (F.col("out_ms") - F.col("in_ms")).cast("double")
    frozen = pb.is_frozen(F.col("_t"), F.col("freeze_at"), F.col("freeze_hold"))
    speed = F.when(F.col("speed").isNotNull(), sp.speed_at(sp.monotone_tangents(sp.normalise(F.col("speed"))), F.col("_off") / src)).otherwise(F.lit(1.0) / F.col("factor"))
    at = F.when(F.col("reversed"), F.col("out_ms") - F.col("_off")).otherwise(F.col("in_ms") + F.col("_off"))
    return o.select(*times.columns, at.alias("source_ms"), F.when(frozen, 0.0).otherwise(speed).alias("rate"), frozen.alias("frozen"))


def split(clips: DataFrame, edits: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """:func:`mediaframe.operators.edits.split` for ramped clips: the halves meet on the source time that the ramp shows
    at the cut, and each keeps its part of the curve, stretched to its own range."""
    j = ed.split_targets(clips, edits)
    o = play_to_source(j, F.coalesce(ed.split_play(), F.lit(0.0)), "_off", samples=samples)
    halves = ed.split_at(o, clips.columns, F.col("_off"), keep=["_off", "_range"])
    u = F.col("_off") / F.col("_range")
    left, whole = F.col("half") == "left", F.col("half") == "whole"
    own = F.when(~whole, F.col("speed"))
    part = sp.slice_curve(own, F.when(left, 0.0).otherwise(u), F.when(left, u).otherwise(1.0), PARTS)
    cut = halves.withColumn("speed", F.when(whole, F.col("speed")).otherwise(part)).drop("_off", "_range")
    return with_factor(cut, samples)


def set_speed(clips: DataFrame, edits: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """New speed curves (edits: project_id, clip_id, points; one clip or link group a track): the freeze stays on its source
    frame and later clips of the track move by the change of length."""
    j = clips.join(ed._targets(clips, edits, ["points"]), ["project_id", "clip_id"], "left").withColumn("points", F.col("points").cast(RAMP))
    on = F.col("points").isNotNull()
    held = play_to_source(j, F.coalesce(F.col("freeze_at"), F.lit(0)).cast("double"), "_src", samples=samples)
    at = source_to_play(held, F.col("_src"), "_at", points="points", samples=samples)
    fresh = {"speed": F.when(on, F.col("points")).otherwise(F.col("speed")), "freeze_at": F.when(on & F.col("freeze_at").isNotNull(), F.col("_at")).otherwise(F.col("freeze_at").cast("double"))}
    changed = at.select(*[fresh.get(c, F.col(c)).alias(c) for c in clips.columns])
    sped = cut_lineage(with_factor(changed, samples))
    old = clips.select("project_id", "clip_id", (F.col("start_ms") + F.col("dur_ms")).alias("_end"), F.col("dur_ms").alias("_dur"))
    moves = sped.join(ed._targets(clips, edits, []), ["project_id", "clip_id"], "left_semi").join(old, ["project_id", "clip_id"])
    ripples = moves.groupBy("project_id", "track_index").agg(F.min_by(F.struct(F.col("_end").alias("from_ms"), (F.col("dur_ms") - F.col("_dur")).alias("delta_ms"), F.col("clip_id").alias("except_id")), "clip_id").alias("m"))
    moved = tl.ripple(sped, ripples.select("project_id", "track_index", "m.*"))
    return moved.withColumn("start_ms", F.col("new_start")).select(*clips.columns)


def retime_keyframes(keys: DataFrame, before: DataFrame, after: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Keyframes (project_id, clip_id, time_ms, ..) moved with a change of speed, so that they stay on their source frames;
    inside a freeze they keep their distance from its start."""
    cols = ["speed", "factor", "freeze_at", "freeze_hold"]
    old = before.select("project_id", "clip_id", "in_ms", "out_ms", *[F.col(c) for c in cols])
    new = after.select("project_id", "clip_id", *[F.col(c).alias(f"n_{c}") for c in cols])
    k = keys.join(old, ["project_id", "clip_id"]).join(new, ["project_id", "clip_id"])
    t = F.col("time_ms").cast("double")
    s = play_to_source(k, pb.local_to_play(t, F.col("freeze_at"), F.col("freeze_hold")), "_src", samples=samples)
    p = source_to_play(s, F.col("_src"), "_play", points="n_speed", factor="n_factor", samples=samples)
    inside = (t > F.col("freeze_at")) & (t < F.col("freeze_at") + F.col("freeze_hold"))
    beyond = F.when(F.col("_play") <= F.col("n_freeze_at") + 1e-6, F.col("_play")).otherwise(F.col("_play") + F.col("n_freeze_hold"))
    moved = F.when(F.col("n_freeze_at").isNull(), F.col("_play")).when(inside, F.col("n_freeze_at") + t - F.col("freeze_at")).otherwise(beyond)
    return p.select(*[moved.alias(c) if c == "time_ms" else F.col(c) for c in keys.columns])


def audio_schedule(audible: DataFrame, start_ms: float, end_ms: float, rate: int = 48_000, margin_ms: float = 20.0, samples: int = SAMPLES) -> DataFrame:
    """:func:`mediaframe.operators.timeline.audio_schedule` at any speed: [i0, i1) and the source window [w0, w1] that is
    heard there, with a margin inside the clip's range."""
    s = tl.audio_schedule(audible, start_ms, end_ms, rate).drop("w0", "w1")
    local = lambda i: F.lit(start_ms) + F.col(i) * 1000.0 / rate - F.col("start_ms")
    for i, heard in (("i0", "_a"), ("i1", "_b")):
        s = source_at(s.withColumn("local", local(i)), samples).withColumnRenamed("source_ms", heard).drop("local", "rate", "frozen")
    low, high = F.least("_a", "_b") - margin_ms, F.greatest("_a", "_b") + margin_ms
    return s.withColumn("w0", F.greatest(low, F.col("in_ms"))).withColumn("w1", F.least(high, F.col("out_ms"))).drop("_a", "_b")
