"""Document-level rules: validation, clean-up, defaults, output guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import rates
from mediaframe.functions.text import norm_path

# fixed limits
MIN_SIDE, MAX_SIDE = 16, 8192
MAX_DURATION_MS = 4 * 3600 * 1000
MAX_TRACKS, MAX_CLIPS = 256, 50_000


def guard_output(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """Outputs that would overwrite a source, LUT or stem. outputs: path; sources: path, what."""
    s = sources.filter(F.col("path").isNotNull() & (F.trim("path") != "")).select(norm_path(F.col("path")).alias("_key"), "what").distinct()
    return outputs.withColumn("_key", norm_path(F.col("path"))).join(s, "_key").drop("_key")


def validate_projects(projects: DataFrame, tracks: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per broken rule (project_id, clip_id, rule).

    projects: project_id, width, height, fps; tracks: project_id, track_index; clips: project_id, clip_id, start_ms, in_ms,
    out_ms, dur_ms, fade_in_ms, fade_out_ms (nullable), min_speed."""
    bad_ms = lambda c, top: F.isnan(c.cast("double")) | (F.abs(c) > top)
    fade_bad = lambda c: F.coalesce(F.isnan(c.cast("double")) | (c < 0) | (c > MAX_DURATION_MS), F.lit(False))
    rule = lambda cond, name: F.when(cond, F.lit(name))
    times = bad_ms(F.col("start_ms"), MAX_DURATION_MS * 4) | bad_ms(F.col("in_ms"), MAX_DURATION_MS * 4) | bad_ms(F.col("out_ms"), MAX_DURATION_MS * 4) | (F.col("min_speed") <= 0)
    per_clip = clips.select("project_id", "clip_id", F.explode(F.array_compact(F.array(
        rule(times, "times"), rule(fade_bad(F.col("fade_in_ms")) | fade_bad(F.col("fade_out_ms")), "fade")))).alias("rule"))
    counts = clips.groupBy("project_id").agg(F.count("*").alias("n_clips"), F.max(F.when(F.col("out_ms") > F.col("in_ms"), F.col("start_ms") + F.col("dur_ms"))).alias("end"))
    n_tracks = tracks.groupBy("project_id").agg(F.count("*").alias("n_tracks"))
    side = lambda c: ~F.col(c).between(MIN_SIDE, MAX_SIDE)
    p = projects.join(counts, "project_id", "left").join(n_tracks, "project_id", "left")
    per_project = p.select("project_id", F.lit(None).cast("bigint").alias("clip_id"), F.explode(F.array_compact(F.array(
        rule(side("width") | side("height"), "size"), rule(~rates.is_allowed_fps(F.col("fps")), "fps"), rule(F.col("n_tracks") > MAX_TRACKS, "tracks"),
        rule(F.col("n_clips") > MAX_CLIPS, "clips"), rule(F.coalesce(F.col("end") > MAX_DURATION_MS, F.lit(False)), "duration")))).alias("rule"))
    return per_project.unionByName(per_clip.withColumn("clip_id", F.col("clip_id").cast("bigint")))


def sanitize(clips: DataFrame, transition_types: list[str], effect_types: list[str]) -> DataFrame:
    """Drop unknown transitions and effects, give transitions a length, drop empty clips of fx tracks."""
    known = F.col("transition_type").isin(*transition_types)
    ms = F.col("transition_ms")
    out = clips.withColumn("transition_ms", F.when(known, F.when(ms.isNull() | F.isnan(ms.cast("double")), F.lit(500)).otherwise(ms))).withColumn(
        "transition_type", F.when(known, F.col("transition_type"))).withColumn("effect", F.when(F.col("effect").isin(*effect_types), F.col("effect")))
    return out.filter(~((F.col("kind") == "fx") & F.col("asset_id").isNull() & F.col("effect").isNull()))


def with_defaults(clips: DataFrame) -> DataFrame:
    """Effective values of optional fields; stored rows keep their nulls."""
    d = {"keep_pitch": True, "fade_in_ms": 0.0, "fade_out_ms": 0.0, "volume_db": 0.0, "intensity": 1.0, "transition_ms": 500.0}
    modes = F.col("frame_interpolation").isin("frameBlend", "none")
    out = clips
    for c, v in d.items():
        if c in clips.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out.withColumn("frame_interpolation", F.when(modes, F.col("frame_interpolation")).otherwise("opticalFlow"))
