"""Which source frames an output needs, and how sound is played."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def needs_frames(project_fps: Column, source_fps: Column, min_rate: Column) -> Column:
    return (source_fps > 0) & (min_rate > 0) & (project_fps > source_fps * min_rate * 1.1)


def flow_target(project_fps: Column, source_fps: Column, min_rate: Column, most_factor: float = 8.0, most_fps: float = 480.0) -> Column:
    """Rate to interpolate to: what the slowest part needs, at most ``most_factor`` times the source and ``most_fps``."""
    f = F.least(F.ceil(project_fps / min_rate - 1e-6).cast("double"), source_fps * most_factor, F.lit(most_fps))
    return F.when(needs_frames(project_fps, source_fps, min_rate) & (f > source_fps * 1.05), f)


def slow_grid(min_speed: Column, source_fps: Column, project_fps: Column, most: int = 8) -> Column:
    """Refinement of the decode grid for slow motion from fast footage, ``most`` times at most."""
    n = F.least(F.ceil(F.lit(1.0) / min_speed), F.round(source_fps / project_fps))
    return F.when((min_speed >= 0.999) | (source_fps <= 0), 1).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(most))).cast("int")


def frame_supply(mode: Column, flow_on: Column, source_fps: Column, min_rate: Column, project_fps: Column, grid: Column) -> Column:
    """struct<grid_fps, blend_below_fps, flow_target, needs_frames>."""
    refined = project_fps * F.greatest(grid, F.lit(1))
    needs, none = needs_frames(project_fps, source_fps, min_rate), mode == "none"
    return F.struct(
        F.when(needs & ~none & (source_fps < project_fps), source_fps).otherwise(refined).cast("double").alias("grid_fps"),
        F.when(none, 0.0).when(needs, project_fps * 0.999).otherwise(refined * 0.999).alias("blend_below_fps"),
        F.when(needs & ~none & flow_on & ~(mode == "frameBlend"), flow_target(project_fps, source_fps, min_rate)).alias("flow_target"), needs.alias("needs_frames"))


def frame_request(source_ms: Column, rate: Column, frozen: Column, index_rate: Column, frame_count: Column, decode_fps: Column, blend_below: Column, t0: Column) -> Column:
    """struct<a, b, w>: the frame nearest to a source time, or two neighbours and their mix."""
    last = F.greatest(frame_count - 1, F.lit(0))
    f = F.greatest((source_ms - t0) * index_rate, F.lit(0.0))
    a, w = F.least(F.floor(f), last), f - F.floor(f)
    blend = ~frozen & (decode_fps * F.abs(rate) < blend_below)
    one = lambda v: F.struct(v.cast("bigint").alias("a"), v.cast("bigint").alias("b"), F.lit(0.0).alias("w"))
    pair = F.struct(a.cast("bigint").alias("a"), (a + 1).cast("bigint").alias("b"), w.alias("w"))
    return F.when(blend, F.when((w < 1e-3) | (a >= last), one(a)).when(w > 0.999, one(a + 1)).otherwise(pair)).otherwise(one(F.least(F.floor(f + 1e-3), last)))


def play_mode(uniform_1x: Column, keep_pitch: Column) -> Column:
    return F.when(uniform_1x, "direct").when(F.coalesce(keep_pitch, F.lit(True)), "stretch").otherwise("varispeed")


def sound_source(voice: Column, path: Column, vocals: Column, background: Column, is_stem: Column) -> Column:
    """struct<path, stem, warning>: the stem a voice mode asks for, or the source with the reason."""
    want = F.when(is_stem, F.lit(None).cast("string")).when(voice == "voice", "vocals").when(voice == "background", "background")
    stem = F.when(want == "vocals", vocals).when(want == "background", background)
    ok = stem.isNotNull() & (F.trim(stem) != "")
    why = F.when(want.isNotNull() & vocals.isNull() & background.isNull(), "not separated yet").when(want.isNotNull() & ~F.coalesce(ok, F.lit(False)), "stem missing")
    return F.struct(F.when(ok, stem).otherwise(path).alias("path"), F.when(ok, want).alias("stem"), why.alias("warning"))


def director_reply(text: Column) -> Column:
    """Tolerant reading of a model's JSON reply: the outermost braces, a crop of exactly four numbers, a
    numeric zoom, ids as texts."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    j = F.from_json(body, "has_duplicate boolean, primary_subject_id string, duplicate_ids array<string>, recommended_action string, crop_bounding_box array<string>, zoom_factor string, color_grade_preset string, speed_curve_preset string, cinematic_reasoning string")
    crop = F.transform(j["crop_bounding_box"], lambda v: v.try_cast("double"))
    good = (F.size(crop) == 4) & F.forall(crop, lambda v: v.isNotNull())
    return F.when(body != "", F.struct(
        F.coalesce(j["has_duplicate"], F.lit(False)).alias("has_duplicate"), j["primary_subject_id"].alias("primary_subject_id"), F.coalesce(j["duplicate_ids"], F.array().cast("array<string>")).alias("duplicate_ids"),
        F.coalesce(j["recommended_action"], F.lit("NONE")).alias("recommended_action"), F.when(good, crop).alias("crop"), j["zoom_factor"].try_cast("double").alias("zoom"),
        j["color_grade_preset"].alias("color_grade_preset"), j["speed_curve_preset"].alias("speed_curve_preset"), F.coalesce(j["cinematic_reasoning"], F.lit("")).alias("reasoning")))
