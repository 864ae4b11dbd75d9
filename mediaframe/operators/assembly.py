"""From shots to a timeline: safe source ranges, values, fitting into a target length, placing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import rates
from mediaframe.operators.clock import beats_in_spans, trim_window
from mediaframe.operators.shots import BLOCK
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of
from mediaframe.session import cut_lineage

MIN_CLIP_MS = 1500


def shot_value(cast_count: Column, dur_ms: Column, has_duplicate: Column) -> Column:
    """Cast members on screen, then length up to four seconds, less half a point for a duplicate."""
    return cast_count + F.least(dur_ms / 1000.0, F.lit(4.0)) * 0.25 - F.when(has_duplicate, 0.5).otherwise(0.0)


def shot_ranges(shots: DataFrame, frame_ms: Column) -> DataFrame:
    """Source range of every shot. Between consecutive shots the boundary is moved so that no export grid
    leaks a frame across it. shots: asset_id, shot, start_frame, end_frame, start_ms, end_ms, duration_ms."""
    s = scan.ordered_scan(shots, ["asset_id"], [F.col("shot")], bucket_of(F.col("shot"), BLOCK),
                          before=scan.lag(F.struct("end_frame", "end_ms")), after=scan.lead(F.struct("start_frame", "start_ms")))
    join_in = (F.col("before.end_frame") + 1 == F.col("start_frame")) & (F.col("start_ms") > F.col("before.end_ms"))
    join_out = (F.col("end_frame") + 1 == F.col("after.start_frame")) & (F.col("after.start_ms") > F.col("end_ms"))
    a = F.when(F.coalesce(join_in, F.lit(False)), rates.cut_points(F.col("start_ms"))["in_ms"]).otherwise(F.col("start_ms"))
    b = F.when(F.coalesce(join_out, F.lit(False)), rates.cut_points(F.col("after.start_ms"))["out_ms"]).otherwise(F.col("end_ms") + frame_ms)
    b = F.when(F.col("duration_ms") > 0, F.least(b, F.col("duration_ms"))).otherwise(b)
    return s.select(*shots.columns, F.round(a, 3).alias("in_ms"), F.round(b, 3).alias("out_ms"))


def fit_durations(shots: DataFrame, targets: DataFrame, min_ms: int = MIN_CLIP_MS) -> DataFrame:
    """Shorten the longest shots of a group to one level until the group fits its target.

    When even min(duration, min_ms) does not fit, the least valuable shots (later first on a tie, never the
    first shot) get 0. shots: group_id, pos (0-based), dur_ms, value; targets: group_id, target_ms. Whole ms.

    Keeping is a prefix of the shots by falling value, cut where the running sum of floors passes the target;
    the level is (target - sum of the k shortest) / (kept - k) at the first k where it does not exceed the next."""
    by = ["group_id"]
    floor = F.least(F.col("dur_ms"), F.lit(min_ms))
    s = shots.withColumn("_late", (F.col("pos") > 0).cast("int"))
    ranked = scan.ordered_scan(s, by, [F.col("_late"), F.col("value").desc(), F.col("pos")],
                               F.struct(F.col("_late"), (-F.col("value")).alias("v"), bucket_of(F.col("pos"), BLOCK).alias("p")),
                               _floors=scan.running_sum(floor))
    # one row per shot, read by every branch below: written once so the plan does not double per scan
    ranked = cut_lineage(ranked)
    sums = ranked.groupBy(*by).agg(F.sum("dur_ms").alias("_total")).join(targets, "group_id")
    r = ranked.join(sums, "group_id")
    over = F.col("_total") > F.col("target_ms")
    kept = r.filter(~over | (F.col("_floors") <= F.col("target_ms")) | (F.col("_late") == 0))
    sized = scan.ordered_scan(kept.filter(over), by, [F.col("dur_ms"), F.col("pos")], bucket_of(F.col("dur_ms"), 250),
                              _k=scan.number(), _short=scan.prefix_sum(F.col("dur_ms")), _n=scan.total(F.lit(1)))
    level = (F.col("target_ms") - F.col("_short")) / (F.col("_n") - F.col("_k") + 1)
    first = sized.filter(level <= F.col("dur_ms")).groupBy("group_id").agg(F.min(F.struct("_k", level.alias("level"))).alias("_m"))
    out = r.join(kept.select("group_id", "pos", F.lit(True).alias("_kept")), ["group_id", "pos"], "left").join(first, "group_id", "left")
    limit = F.coalesce(F.col("_m.level"), F.col("dur_ms").cast("double"))
    fitted = F.when(F.col("_kept").isNull(), 0).when(~over, F.col("dur_ms")).otherwise(F.least(F.col("dur_ms"), F.greatest(F.floor(limit), F.lit(min_ms))))
    return out.select(*shots.columns, fitted.cast("bigint").alias("fitted_ms"))


def assemble_timeline(ranges: DataFrame, targets: DataFrame, beats: DataFrame, width_ms: int = 86_400_000) -> DataFrame:
    """Place fitted shots one after another.

    ranges: group_id, asset_id, pos (story position over all assets of the group), shot, in_ms, out_ms, value, has_audio
    (whole ms); beats: asset_id, time_us (same unit as in_ms). A shortened shot keeps its middle, or ends on the
    nearest beat that fits. Returns one row per placed video clip and one for its linked audio."""
    spans = ranges.withColumn("dur_ms", F.col("out_ms") - F.col("in_ms"))
    fitted = fit_durations(spans.select("group_id", "pos", "dur_ms", "value"), targets).select("group_id", "pos", "fitted_ms").filter(F.col("fitted_ms") > 0)
    placed = scan.ordered_scan(spans.join(fitted, ["group_id", "pos"]), ["group_id"], [F.col("pos")], bucket_of(F.col("pos"), BLOCK), start_ms=scan.prefix_sum(F.col("fitted_ms")))
    # a span id unique over groups
    keyed = cut_lineage(placed).withColumn("span_id", F.struct("group_id", "pos"))
    cut = trim_window(keyed.select("asset_id", "span_id", F.col("in_ms").alias("in_us"), F.col("out_ms").alias("out_us"), F.col("fitted_ms").alias("dur_us")), beats, width_ms)
    cut = cut.select("span_id", F.col("in_us").alias("clip_in"), F.col("out_us").alias("clip_out"), "on_beat")
    j = keyed.join(cut, "span_id")
    kinds = F.when(F.col("has_audio"), F.array(F.lit("video"), F.lit("audio"))).otherwise(F.array(F.lit("video")))
    return j.withColumn("kind", F.explode(kinds)).select("group_id", "asset_id", "pos", "shot", "kind", "start_ms", F.col("clip_in").alias("in_ms"), F.col("clip_out").alias("out_ms"), "on_beat")


def timeline_beats(placed: DataFrame, beats: DataFrame, width_ms: int = 86_400_000) -> DataFrame:
    """Source beats inside the placed clips, on the timeline."""
    spans = placed.filter(F.col("kind") == "video").select("asset_id", "group_id", "pos", F.col("start_ms").alias("start_us"), F.col("in_ms").alias("in_us"), F.col("out_ms").alias("out_us"))
    return beats_in_spans(spans, beats, width_ms).select("group_id", "pos", "asset_id", "time_us", F.col("timeline_us").alias("time_ms"))


def cross_clip_cuts(shots: DataFrame) -> DataFrame:
    """The last shot of each clip with the first shot of the clip after it in story order.

    shots: group_id, story_pos, asset_id, shot."""
    ends = shots.groupBy("group_id", "story_pos", "asset_id").agg(F.max("shot").alias("last_shot"), F.min("shot").alias("first_shot"))
    s = scan.ordered_scan(ends, ["group_id"], [F.col("story_pos")], bucket_of(F.col("story_pos"), BLOCK), nxt=scan.lead(F.struct("asset_id", "first_shot")))
    return s.filter(F.col("nxt").isNotNull()).select("group_id", F.col("asset_id").alias("from_asset"), F.col("last_shot").alias("from_shot"), F.col("nxt.asset_id").alias("to_asset"), F.col("nxt.first_shot").alias("to_shot"))


# fixed values: share of the progress bar
SETUP_END, CLIPS_END, CACHED_WEIGHT = 0.02, 0.97, 0.03
STAGES = (("ingest", 0.01), ("shots", 0.06), ("perception", 0.55), ("reframe", 0.30), ("audio", 0.04), ("transitions", 0.04))


def progress_weights(assets: DataFrame) -> DataFrame:
    """Start offset and span of every (asset, stage) on the progress bar, weighted by duration; cached assets
    count 3 %. assets: group_id, pos, duration_ms, cached."""
    w = F.greatest(F.lit(1000.0), F.col("duration_ms").cast("double")) * F.when(F.col("cached"), CACHED_WEIGHT).otherwise(1.0)
    s = scan.ordered_scan(assets.withColumn("_w", F.round(w * 1000).cast("bigint")), ["group_id"], [F.col("pos")], bucket_of(F.col("pos"), BLOCK),
                          _before=scan.prefix_sum(F.col("_w")), _all=scan.total(F.col("_w")))
    span = F.lit(CLIPS_END - SETUP_END) * F.col("_w") / F.col("_all")
    base = F.lit(SETUP_END) + F.lit(CLIPS_END - SETUP_END) * F.col("_before") / F.col("_all")
    acc, rows = 0.0, []
    for name, share in STAGES:
        rows.append(F.struct(F.lit(name).alias("stage"), F.lit(acc).alias("at"), F.lit(share).alias("share")))
        acc += share
    return s.withColumn("_s", F.explode(F.array(*rows))).select("group_id", "pos", F.col("_s.stage").alias("stage"), (base + span * F.col("_s.at")).alias("start"), (span * F.col("_s.share")).alias("span"))
