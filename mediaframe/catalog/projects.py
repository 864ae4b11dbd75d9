"""Document rules, speed ramps, frame supply and text functions."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import presets, supply, text
from mediaframe.operators import projects as op
from mediaframe.operators import speed as sp

W = f"w as ({fx.WIDE_SQL})"
FPS = "case project_id % 4 when 0 then 24.0 when 1 then 29.97 when 2 then 33.0 else 60.0 end::double"


@query("validate_projects", f"""with {W}, p as (select project_id, case when project_id % 9 = 0 then 8 else 1280 end as width, 720 as height, {FPS} as fps from w group by 1),
 t as (select project_id, count(distinct track_index) as n, count(*) as c, max(case when out_ms > in_ms then start_ms * 40 + dur_ms end) as e from w group by 1)
 select project_id, null::bigint as clip_id, unnest(list_filter([case when width < 16 then 'size' end, case when fps = 33 then 'fps' end, case when n > 256 then 'tracks' end, case when c > 50000 then 'clips' end, case when e > 14400000 then 'duration' end], lambda x: x is not null)) as rule from p join t using (project_id)
 union all select project_id, clip_id, 'fade' from w where clip_id % 100 = 1 union all select project_id, clip_id, 'times' from w where clip_id % 500 = 7""")
def validate_projects(spark, sf):
    w = fx.wide_clips(spark, sf)
    i, p = F.col("clip_id"), F.col("project_id")
    fps = F.when(p % 4 == 0, 24.0).when(p % 4 == 1, 29.97).when(p % 4 == 2, 33.0).otherwise(60.0)
    projects = w.select("project_id").distinct().select("project_id", F.when(p % 9 == 0, 8).otherwise(1280).alias("width"), F.lit(720).alias("height"), fps.alias("fps"))
    c = w.withColumn("start_ms", F.col("start_ms") * 40).withColumn("fade_in_ms", F.when(i % 100 == 1, -5).otherwise(F.col("fade_in_ms"))).withColumn("min_speed", F.when(i % 500 == 7, 0.0).otherwise(1.0))
    return op.validate_projects(projects, w.select("project_id", "track_index").distinct(), c)


@query("sanitize", f"with {W} select clip_id, case when transition_type in ('dissolve') then transition_type end as transition_type, case when transition_type = 'dissolve' then coalesce(case when clip_id % 5 > 0 then transition_ms end, 500) end as transition_ms, case when effect in ('shake', 'zoomPunch') then effect end as effect from w where not (kind = 'fx' and effect not in ('shake', 'zoomPunch'))")
def sanitize(spark, sf):
    w = fx.wide_clips(spark, sf).withColumn("transition_ms", F.when(F.col("clip_id") % 5 > 0, F.col("transition_ms"))).withColumn("asset_id", F.when(F.col("kind") != "fx", F.col("asset_id")))
    return op.sanitize(w, ["dissolve"], ["shake", "zoomPunch"]).select("clip_id", "transition_type", "transition_ms", "effect")


@query("with_defaults", f"with {W} select clip_id, coalesce(fade_in_ms, 0)::double as fade_in_ms, coalesce(case when clip_id % 2 = 0 then clip_id % 3 = 0 end, true) as keep_pitch, case when clip_id % 4 = 1 then 'none' else 'opticalFlow' end as frame_interpolation from w")
def with_defaults(spark, sf):
    i = F.col("clip_id")
    w = fx.wide_clips(spark, sf).withColumn("fade_in_ms", F.col("fade_in_ms").cast("double")).withColumn("keep_pitch", F.when(i % 2 == 0, i % 3 == 0)).withColumn("frame_interpolation", F.when(i % 4 == 1, "none").when(i % 4 == 2, "warp"))
    return op.with_defaults(w).select("clip_id", "fade_in_ms", "keep_pitch", "frame_interpolation")


NEED = "(60 > 1.1::double * fps * rate)"


@query("frame_supply", f"""with a as (select asset_id, fps, (1 + asset_id % 4) / 4.0::double as rate, case asset_id % 3 when 0 then 'none' when 1 then 'frameBlend' else 'opticalFlow' end as mode from ({fx.ASSETS_SQL})), g as (select *, case when rate >= 0.999 then 1 else least(greatest(least(ceil(1 / rate), round(fps / 60)), 1), 8) end as grid from a)
 select asset_id, case when {NEED} and mode <> 'none' and fps < 60 then fps else 60 * grid end::double as grid_fps, round(case when mode = 'none' then 0 when {NEED} then 59.94 else 60 * grid * 0.999 end, 6)::double as blend_below_fps,
  case when {NEED} and mode = 'opticalFlow' and least(ceil(60 / rate - 1e-6), fps * 8, 480) > fps * 1.05 then least(ceil(60 / rate - 1e-6), fps * 8, 480) end::double as flow_target, {NEED} as needs_frames from g""")
def frame_supply(spark, sf):
    i, p = F.col("asset_id"), F.lit(60.0)
    rate = (i % 4 + 1) / 4.0
    mode = F.when(i % 3 == 0, "none").when(i % 3 == 1, "frameBlend").otherwise("opticalFlow")
    s = supply.frame_supply(mode, F.lit(True), F.col("fps"), rate, p, supply.slow_grid(rate, F.col("fps"), p))
    return fx.assets(spark, sf).select("asset_id", s["grid_fps"].alias("grid_fps"), F.round(s["blend_below_fps"], 6).alias("blend_below_fps"), s["flow_target"].alias("flow_target"), s["needs_frames"].alias("needs_frames"))


@query("frame_request", """with e as (select event_id, value * 10 as ms, event_id % 3 = 0 as frozen, case when event_id % 2 = 0 then 0.5 else 1.0 end as rate from events), f as (select *, greatest(ms * 0.024::double, 0) as f from e),
 g as (select *, least(floor(f), 99)::bigint as a, f - floor(f) as w, not frozen and 24 * rate < 20 as bl from f)
 select event_id, case when bl then case when w < 1e-3 or a >= 99 then a when w > 0.999 then a + 1 else a end else least(floor(f + 1e-3), 99)::bigint end as a, case when bl then case when w < 1e-3 or a >= 99 then a else a + 1 end else least(floor(f + 1e-3), 99)::bigint end as b,
  round(case when bl and w >= 1e-3 and w <= 0.999 and a < 99 then w else 0 end, 6)::double as w from g""")
def frame_request(spark, sf):
    r = supply.frame_request(F.col("value") * 10, F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(1.0), F.col("event_id") % 3 == 0, F.lit(0.024), F.lit(100), F.lit(24.0), F.lit(20.0), F.lit(0.0))
    return fx.table(spark, sf, "events").select("event_id", r["a"].alias("a"), r["b"].alias("b"), F.round(r["w"], 6).alias("w"))


@query("sound_source", f"""with {W}, v as (select *, case clip_id % 3 when 0 then 'original' when 1 then 'voice' else 'background' end as voice, case when clip_id % 4 = 0 then null when clip_id % 4 = 1 then '' else 'v' end as vo, case when clip_id % 4 = 0 then null else 'b' end as ba from w)
 select clip_id, case when voice = 'voice' and vo = 'v' then 'v' when voice = 'background' and ba = 'b' then 'b' else 'src' end as path, case when voice = 'voice' and vo = 'v' then 'vocals' when voice = 'background' and ba = 'b' then 'background' end as stem,
 case when voice <> 'original' and vo is null and ba is null then 'not separated yet' when voice = 'voice' and vo = '' then 'stem missing' end as warning, case when factor = 1 then 'direct' when clip_id % 2 = 0 then 'stretch' else 'varispeed' end as mode from v""")
def sound_source(spark, sf):
    i = F.col("clip_id")
    voice = F.when(i % 3 == 0, "original").when(i % 3 == 1, "voice").otherwise("background")
    s = supply.sound_source(voice, F.lit("src"), F.when(i % 4 == 0, F.lit(None).cast("string")).when(i % 4 == 1, "").otherwise("v"), F.when(i % 4 != 0, "b"), F.lit(False))
    return fx.wide_clips(spark, sf).select("clip_id", s["path"].alias("path"), s["stem"].alias("stem"), s["warning"].alias("warning"), supply.play_mode(F.col("factor") == 1, i % 2 == 0).alias("mode"))


@query("normalize_director", """select event_id, event_id % 2 = 0 as has_duplicate, case when event_id % 3 > 0 then round(value, 2) end as first, case when event_id % 5 > 0 then 1.5 end::double as zoom, case when event_id % 4 > 0 then 'CROP' else 'NONE' end as action from events""")
def normalize_director(spark, sf):
    i = F.col("event_id")
    crop = F.when(i % 3 > 0, F.format_string("[%.2f, 0, \"100\", 200]", F.col("value"))).otherwise("[1, 2, 3]")
    body = F.concat(F.lit("Sure: {\"has_duplicate\": "), (i % 2 == 0).cast("string"), F.lit(", \"crop_bounding_box\": "), crop, F.lit(", \"zoom_factor\": "), F.when(i % 5 > 0, "1.5").otherwise("\"x\""),
                    F.when(i % 4 > 0, ", \"recommended_action\": \"CROP\"").otherwise(""), F.lit(", \"duplicate_ids\": [3, 4]} done"))
    d = supply.director_reply(body)
    return fx.table(spark, sf, "events").select("event_id", d["has_duplicate"].alias("has_duplicate"), F.get(d["crop"], 0).alias("first"), d["zoom"].alias("zoom"), d["recommended_action"].alias("action"))


@query("preset_usage", f"with {W} select coalesce(transition_type, 'none') as type, count(*) as uses, max(case when transition_type in ('dissolve', 'wipeLeft') then case transition_type when 'dissolve' then 0 else 3 end end)::int as code from w group by 1")
def preset_usage(spark, sf):
    w = fx.wide_clips(spark, sf).select(F.coalesce("transition_type", F.lit("none")).alias("type"))
    return w.join(F.broadcast(presets.transition_types(spark)), "type", "left").groupBy("type").agg(F.count("*").alias("uses"), F.max("code").alias("code"))


@query("speed_lut", """with c as (select event_id as curve_id, 0.5 + (event_id % 4) * 0.5::double as a, 1.0 + (event_id % 3)::double as b from events), g as (select *, unnest(range(0, 33)) as k from c), v as (select *, a + (b - a) * (k / 32.0::double) as s from g),
 t as (select curve_id, k, coalesce((1 / s + lag(1 / s) over w) / 64, 0) as ar, 1 / s as inv from v window w as (partition by curve_id order by k))
 select curve_id, round(sum(ar), 6) as factor, round(33 / sum(inv), 6) as average_speed, max(inv > 1 / 0.999) as has_slow_motion from t group by 1""")
def speed_lut(spark, sf):
    # two-point curves are straight lines, so the oracle needs no tangents
    i = F.col("event_id")
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    curves = fx.events(spark, sf).select(i.alias("curve_id"), F.array(pt(0.0, F.lit(0.5) + (i % 4) * 0.5), pt(1.0, (F.lit(1.0) + (i % 3)))).alias("points"))
    f = sp.speed_factor(sp.speed_lut(curves, 33))
    return f.select("curve_id", F.round("factor", 6).alias("factor"), F.round("average_speed", 6).alias("average_speed"), "has_slow_motion")


@query("speed_ramp_times")
def speed_ramp_times(spark, sf):
    """Every clip with one of the preset ramps: its source offset after half its output time, and back."""
    c = presets.speed_presets(spark).withColumnRenamed("preset", "curve_id")
    lut = sp.speed_lut(c, 256)
    names = F.array(*[F.lit(n) for n in presets.SPEED])
    clips = fx.clips(spark, sf).select("clip_id", F.get(names, (F.col("clip_id") % 7).cast("int")).alias("curve_id"), F.col("dur_ms").cast("double").alias("source_ms"))
    t = clips.join(sp.speed_factor(lut).select("curve_id", "factor"), "curve_id").withColumn("play_ms", F.col("source_ms") * F.col("factor") / 2)
    return sp.source_to_output(sp.output_to_source(t, lut), lut)


@query("time_texts", """select event_id, lpad((t // 24 // 3600)::varchar, 2, '0') || ':' || lpad((t // 24 // 60 % 60)::varchar, 2, '0') || ':' || lpad((t // 24 % 60)::varchar, 2, '0') || ':' || lpad((t % 24)::varchar, 2, '0') as tc,
  case when ms >= 6000000 then (ms // 60000)::varchar else lpad((ms // 60000)::varchar, 2, '0') end || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') as short, sha1(event_id || '|' || ms) as key, 'ast_' || sha1(event_id::varchar) as id, case when ms >= 60000 then (ms // 60000) || 'm ' || round((ms % 60000) / 1000.0)::bigint || 's' end as long_
  from (select event_id, event_id * 1237 as ms, floor(event_id * 1237 / 1000.0::double * 24 + 1e-6)::bigint as t from events)""")
def time_texts(spark, sf):
    ms = F.col("event_id") * 1237
    e = fx.table(spark, sf, "events")
    return e.select("event_id", text.timecode(ms, F.lit(24)).alias("tc"), text.short_time(ms).alias("short"), text.fingerprint(F.col("event_id"), ms).alias("key"), text.new_id("ast", F.col("event_id")).alias("id"),
                    F.when(ms >= 60000, text.fmt_duration(ms)).alias("long_"))


def _ramped(spark, sf):
    """Clips of which three in four have a preset ramp."""
    from mediaframe.operators import ramps

    c = presets.speed_presets(spark).select(F.col("preset").alias("_preset"), F.col("points").cast(ramps.RAMP).alias("speed"))
    names = F.array(*[F.lit(n) for n in presets.SPEED])
    w = fx.wide_clips(spark, sf).withColumn("_name", F.when(F.col("clip_id") % 4 != 0, F.get(names, (F.col("clip_id") % 7).cast("int"))))
    return ramps.with_factor(w.join(c, F.col("_name") == F.col("_preset"), "left").drop("_name", "_preset"))


@query("split_ramped")
def split_ramped(spark, sf):
    """Every third clip cut at 40 % of its length on the timeline."""
    from mediaframe.operators import ramps

    c = _ramped(spark, sf)
    cut = c.filter(F.col("clip_id") % 3 == 0).select("project_id", "clip_id", (F.col("start_ms") + F.col("dur_ms") * 0.4).alias("at_ms"))
    return ramps.split(c, cut).select("clip_key", "half", "start_ms", "dur_ms", "in_ms", "out_ms", "factor", F.size("speed").alias("knots"))


@query("audio_schedule_ramped")
def audio_schedule_ramped(spark, sf):
    """Source windows of all ramped and plain clips in the mix."""
    from mediaframe.operators import ramps

    return ramps.audio_schedule(_ramped(spark, sf).filter(~F.col("muted") & ~F.col("track_muted")), 0.0, 1e9).select("project_id", "clip_id", "i0", "i1", "w0", "w1")
