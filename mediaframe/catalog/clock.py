"""Time lookups over ``events``: clocks, keyframes, resampling, beats, snapping."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import easing as ez
from mediaframe.functions import rates
from mediaframe.operators import clock as op

HALF_HOUR = 1_800_000_000
TIMES = f"""f as ({fx.FRAMES_SQL}), t as (select asset_id, event_id, pts_us + {HALF_HOUR} * (event_id % 5 - 2) as t_us from f where label = 'view')"""


def _times(spark, sf):
    e = fx.events(spark, sf).filter(F.col("label") == "view")
    return e.select("asset_id", "event_id", (F.col("pts_us") + (F.col("event_id") % 5 - 2) * HALF_HOUR).alias("t_us"))


def _clock(spark, sf):
    return fx.frames(spark, sf).select("asset_id", "frame", "pts_us")


@query("frame_times", """select user_id as asset_id, row_number() over (partition by user_id order by tick) - 1 as frame,
  cast(tick // 90000 * 1000000 + round((tick % 90000) * 1000000 / 90000) - 500 as bigint) as pts_us from (select *, coalesce(case when event_id % 9 <> 0 then epoch_us(ts) // 1000 * 90 end, epoch_us(ts) // 1000 * 90 + 7) as tick
  from events where event_type <> 'error')""")
def frame_times(spark, sf):
    tick = F.floor(F.col("pts_us") / 1000) * 90
    packets = fx.events(spark, sf).select("asset_id", F.when(F.col("event_id") % 9 != 0, tick).alias("pts"), (tick + 7).alias("dts"),
                                          F.when(F.col("label") == "error", "_D").otherwise("K_").alias("flags"), F.lit(1).cast("bigint").alias("tb_num"),
                                          F.lit(90000).cast("bigint").alias("tb_den"), F.lit(500).cast("bigint").alias("start_us"))
    return op.frame_times(packets)


@query("clock_index_at", f"with {TIMES} select t.asset_id, t.event_id, t_us, coalesce(f.frame, 0) as frame from t asof left join f on t.asset_id = f.asset_id and t.t_us >= f.pts_us")
def clock_index_at(spark, sf):
    return op.index_at(_times(spark, sf), _clock(spark, sf))


@query("clock_nearest", f"""with {TIMES} select t.asset_id, t.event_id, t_us, case when a.frame is null or (b.frame is not null and b.pts_us - t_us < t_us - a.pts_us) then b.frame else a.frame end as frame
  from t asof left join f a on t.asset_id = a.asset_id and t.t_us >= a.pts_us asof left join f b on t.asset_id = b.asset_id and t.t_us < b.pts_us""")
def clock_nearest(spark, sf):
    return op.nearest(_times(spark, sf), _clock(spark, sf))


INDEX = f"""f as ({fx.FRAMES_SQL}), n as (select asset_id, max(frame) as last from f group by 1),
  q as (select asset_id, event_id, (event_id % 120) - 5 + (event_id % 4) * 0.25 as index from f),
  ms as (select q.asset_id, q.event_id, q.index, case when index <= 0 then a.pts_us + index * 40000.0 when index >= last then a.pts_us + (index - last) * 40000.0
    else a.pts_us + (index - a.frame) * (b.pts_us - a.pts_us) end as us from q join n using (asset_id)
    join f a on a.asset_id = q.asset_id and a.frame = least(greatest(floor(index), 0), last) left join f b on b.asset_id = q.asset_id and b.frame = a.frame + 1)"""


@query("clock_ms", f"with {INDEX} select asset_id, event_id, round(us, 2)::double as us from ms")
def clock_ms(spark, sf):
    q = fx.events(spark, sf).select("asset_id", "event_id", ((F.col("event_id") % 120) - 5 + (F.col("event_id") % 4) * F.lit(0.25)).alias("index"))
    return op.time_of(q, _clock(spark, sf)).select("asset_id", "event_id", F.round("us", 2).alias("us"))


@query("clock_seek", f"""with f as ({fx.FRAMES_SQL}) select asset_id, frame, case when frame = 0 then 0.0 else (pts_us + lag(pts_us) over (partition by asset_id order by frame)) / 2.0 end as us from f""")
def clock_seek(spark, sf):
    f = fx.frames(spark, sf)
    return op.seek_time(f.select("asset_id", "frame"), f.select("asset_id", "frame", "pts_us"))


SPANS = f"""sp as (select asset_id, event_id as span_id, pts_us as in_us, pts_us + {4 * HALF_HOUR} + event_id % 7 * 1000003 as out_us,
  event_id % 1000 * 40000000 as start_us, {2 * HALF_HOUR} * (1 + event_id % 3) as dur_us from ({fx.EVENTS_SQL}) where label = 'signup')"""


def _spans(spark, sf):
    e = fx.events(spark, sf).filter(F.col("label") == "signup")
    return e.select("asset_id", F.col("event_id").alias("span_id"), F.col("pts_us").alias("in_us"),
                    (F.col("pts_us") + 4 * HALF_HOUR + F.col("event_id") % 7 * 1000003).alias("out_us"),
                    (F.col("event_id") % 1000 * 40000000).alias("start_us"), ((F.col("event_id") % 3 + 1) * (2 * HALF_HOUR)).alias("dur_us"))


@query("frames_in_shots", f"""with f as ({fx.FRAMES_SQL}), s as (select asset_id, frame as start_frame, frame + event_id % 6 as end_frame, event_id as shot from f where label = 'signup')
  select f.asset_id, f.frame, s.shot from f join s on f.asset_id = s.asset_id and f.frame between s.start_frame and s.end_frame""")
def frames_in_shots(spark, sf):
    f = fx.frames(spark, sf)
    s = f.filter(F.col("label") == "signup").select("asset_id", F.col("frame").alias("start_frame"), (F.col("frame") + F.col("event_id") % 6).alias("end_frame"), F.col("event_id").alias("shot"))
    return op.frames_in_shots(f.select("asset_id", "frame"), s).select("asset_id", "frame", "shot")


@query("sample_frames", f"""with f as ({fx.FRAMES_SQL}), s as (select asset_id, event_id as shot, frame as start_frame, coalesce(lead(frame, 5) over w, frame) as end_frame, pts_us as start_us,
    coalesce(lead(pts_us, 5) over w, pts_us) as end_us, label from f window w as (partition by asset_id order by frame)),
  g as (select asset_id, shot, start_frame, end_frame, start_us, unnest(range(0, (end_us - start_us) // {6 * HALF_HOUR} + 1)) as k from s where label = 'purchase'),
  t as (select *, start_us + k * {6 * HALF_HOUR} as t_us from g)
  select t.asset_id, shot, k, least(end_frame, greatest(start_frame, case when b.frame is not null and b.pts_us - t_us < t_us - a.pts_us then b.frame else a.frame end)) as frame
  from t asof left join f a on t.asset_id = a.asset_id and t.t_us >= a.pts_us asof left join f b on t.asset_id = b.asset_id and t.t_us < b.pts_us""")
def sample_frames(spark, sf):
    f = fx.frames(spark, sf)
    ends = f.select("asset_id", (F.col("frame") - 5).alias("frame"), F.col("frame").alias("ef"), F.col("pts_us").alias("eu"))
    s = f.filter(F.col("label") == "purchase").join(ends, ["asset_id", "frame"], "left").select(
        "asset_id", F.col("event_id").alias("shot"), F.col("frame").alias("start_frame"), F.coalesce("ef", "frame").alias("end_frame"),
        F.col("pts_us").alias("start_us"), F.coalesce("eu", "pts_us").alias("end_us"))
    return op.sample_frames(s, f.select("asset_id", "frame", "pts_us"), 6 * HALF_HOUR).select("asset_id", "shot", "k", "frame")


SNAP = f"""c as ({fx.CLIPS_SQL}), t as (select project_id, clip_id, start_ms + dur_ms // 2 as t from c),
  g as (select project_id, start_ms as target, 2 as ord from c union all select project_id, start_ms + dur_ms, 3 from c union all select project_id, 0, 0 from c),
  d as (select project_id, target, min(ord) as ord from g group by 1, 2),
  m as (select t.project_id, clip_id, t, target, row_number() over (partition by t.project_id, clip_id order by abs(target - t), ord, target) as rn from t join d on d.project_id = t.project_id and abs(target - t) < 400)"""


@query("snap", f"with {SNAP} select t.project_id, t.clip_id, coalesce(m.target, t.t) as snapped_t, m.target is not null as snapped from t left join m on m.project_id = t.project_id and m.clip_id = t.clip_id and m.rn = 1")
def snap(spark, sf):
    c = fx.clips(spark, sf)
    targets = c.select("project_id", F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(2).alias("ord")), F.struct((F.col("start_ms") + F.col("dur_ms")).alias("t"), F.lit(3).alias("ord")),
        F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).alias("ord")))).alias("s")).select("project_id", "s.t", "s.ord")
    times = c.select("project_id", "clip_id", (F.col("start_ms") + F.floor(F.col("dur_ms") / 2)).alias("t"))
    return op.snap(times, targets, 400, 100_000).select("project_id", "clip_id", "snapped_t", "snapped")


def bezier_sql(x, h):
    cubic = lambda a, b, t: f"((1 - {t}) * (1 - {t}) * {t} * 3.0 * {a} + (1 - {t}) * {t} * {t} * 3.0 * {b} + {t} * {t} * {t})"
    t = f"list_reduce(list_prepend(0.5::double, list_transform(range(2, 41), lambda i: power(2.0, -i))), lambda t, s: case when {cubic(h[0], h[2], 't')} < {x} then t + s else t - s end)"
    return f"(case when {x} <= 0 then 0.0 when {x} >= 1 then 1.0 else list_transform([{t}], lambda p: {cubic(h[1], h[3], 'p')})[1] end)"


def ease_sql(u, e):
    bounce = f"(case when {u} < 1/2.75 then 7.5625*{u}*{u} when {u} < 2/2.75 then 7.5625*({u}-1.5/2.75)*({u}-1.5/2.75)+0.75 when {u} < 2.5/2.75 then 7.5625*({u}-2.25/2.75)*({u}-2.25/2.75)+0.9375 else 7.5625*({u}-2.625/2.75)*({u}-2.625/2.75)+0.984375 end)"
    arms = " ".join(f"when '{k}' then {bezier_sql(u, v)}" for k, v in ez.BEZIER.items())
    return f"(case {e} when 'bounce' then {bounce} {arms} else {u} end)"


@query("eval_keyframes", f"""with k as ({fx.KEYFRAMES_SQL}), t as (select asset_id as clip_id, event_id, pts_us + {HALF_HOUR} * (event_id % 5 - 2) as t_us from ({fx.EVENTS_SQL}) where label = 'view'),
  b as (select t.clip_id, t.event_id, a.value as av, a.easing as easing, z.value as bv, (t_us - a.time_us) / (z.time_us - a.time_us) as u from t
    asof left join k a on t.clip_id = a.clip_id and t.t_us >= a.time_us asof left join k z on t.clip_id = z.clip_id and t.t_us < z.time_us)
  select clip_id, event_id, round(case when av is null then bv when bv is null then av else av + (bv - av) * {ease_sql('u', 'easing')} end, 6) as value from b""")
def eval_keyframes(spark, sf):
    t = _times(spark, sf).withColumnRenamed("asset_id", "clip_id")
    return op.evaluate_keyframes(t, fx.keyframes(spark, sf)).select("clip_id", "event_id", F.round("value", 6).alias("value"))


@query("easing_curves", f"""select event_id, round({bezier_sql('u', (0.25, 0.1, 0.25, 1.0))}, 7) as bezier, round(case when u <= 0 then 0 when u >= 1 then 1 else power(2.0, -10 * u) * sin((u * 10 - 0.75) * (2 * pi() / 3)) + 1 end, 7) as elastic,
  round(2.70158 * power(u - 1, 3) + 1.70158 * power(u - 1, 2) + 1, 7) + 0.0 as back, round(case when u < 0.5 then 4 * u * u * u else 1 - power(-2 * u + 2, 3) / 2 end, 7) as in_out, round(1 - power(1 - u, 3), 7) as out_cubic
  from (select event_id, least(1.0, value / 100.0) as u from events)""")
def easing_curves(spark, sf):
    u = F.least(F.lit(1.0), F.col("value") / 100.0)
    r = lambda c, n: F.round(c, 7).alias(n)
    return fx.events(spark, sf).select("event_id", r(ez.cubic_bezier(*ez.DEFAULT_HANDLES, u), "bezier"), r(ez.elastic_out(u), "elastic"), r(ez.ease_out_back(u), "back"),
                                       r(ez.ease_in_out_cubic(u), "in_out"), r(ez.ease_out_cubic(u), "out_cubic"))


@query("reframe_crop_at", f"""with k as (select asset_id, pts_us as time_us, value as x1, value / 2 as y1, value + 300 as x2, value / 2 + 200 as y2 from ({fx.EVENTS_SQL}) where label <> 'view'), {TIMES},
  b as (select t.asset_id, t.event_id, a.x1 as ax, z.x1 as zx, a.y2 as ay, z.y2 as zy, (t_us - a.time_us) / (z.time_us - a.time_us) as u from t
    asof left join k a on t.asset_id = a.asset_id and t.t_us >= a.time_us asof left join k z on t.asset_id = z.asset_id and t.t_us < z.time_us)
  select asset_id, event_id, round(case when ax is null then zx when zx is null then ax else ax + (zx - ax) * u end, 6) as x1, round(case when ay is null then zy when zy is null then ay else ay + (zy - ay) * u end, 6) as y2 from b""")
def reframe_crop_at(spark, sf):
    k = fx.events(spark, sf).filter(F.col("label") != "view").select("asset_id", F.col("pts_us").alias("time_us"), F.col("value").alias("x1"), (F.col("value") / 2).alias("y1"),
                                                                    (F.col("value") + 300).alias("x2"), (F.col("value") / 2 + 200).alias("y2"))
    return op.reframe_crop_at(_times(spark, sf), k).select("asset_id", "event_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"))


BOXES = f"""f as ({fx.FRAMES_SQL}), s as (select asset_id, frame as sf, case when label <> 'error' then value end as x1, case when label <> 'error' then value + 200 end as x2 from f where frame % 4 = 0)"""


def _box_samples(f):
    seen = F.col("label") != "error"
    return f.filter(F.col("frame") % 4 == 0).select("asset_id", "frame", F.when(seen, F.col("value")).alias("x1"), F.when(seen, F.col("value") / 3).alias("y1"),
                                                    F.when(seen, F.col("value") + 200).alias("x2"), F.when(seen, F.col("value") / 3 + 100).alias("y2"))


@query("interp_boxes", f"""with {BOXES} select f.asset_id, f.frame, round(case when a.sf = f.frame then a.x1 when a.x1 is not null and b.x1 is not null then (1 - (f.frame - a.sf) / (b.sf - a.sf)) * a.x1 + (f.frame - a.sf) / (b.sf - a.sf) * b.x1 else coalesce(a.x1, b.x1) end, 6) as x1
  from f asof left join s a on a.asset_id = f.asset_id and f.frame >= a.sf asof left join s b on b.asset_id = f.asset_id and f.frame < b.sf""")
def interp_boxes(spark, sf):
    f = fx.frames(spark, sf)
    return op.interp_boxes(f.select("asset_id", "frame"), _box_samples(f), False).select("asset_id", "frame", F.round("x1", 6).alias("x1"))


@query("interp_boxes_conservative", f"""with {BOXES} select f.asset_id, f.frame, round(case when a.sf = f.frame then a.x1 else least(a.x1, b.x1) end, 6) as x1, round(case when a.sf = f.frame then a.x2 else greatest(a.x2, b.x2) end, 6) as x2
  from f asof left join s a on a.asset_id = f.asset_id and f.frame >= a.sf asof left join s b on b.asset_id = f.asset_id and f.frame < b.sf""")
def interp_boxes_conservative(spark, sf):
    f = fx.frames(spark, sf)
    return op.interp_boxes(f.select("asset_id", "frame"), _box_samples(f), True).select("asset_id", "frame", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@query("resample_plan", f"""with f as ({fx.FRAMES_SQL}), {SPANS}, g as (select asset_id, span_id, in_us, unnest(range(0, greatest(1, cast(floor((out_us - in_us) / 600000000.0 + 0.5) as bigint)))) as k from sp),
  t as (select *, in_us + k * 600000000 as t, in_us + k * 600000000 + 500 as probe from g),
  b as (select t.asset_id, span_id, k, t, a.frame as af, a.pts_us as ap, z.frame as zf, z.pts_us as zp, z.label = 'error' as cut from t
    asof left join f a on a.asset_id = t.asset_id and t.probe >= a.pts_us asof left join f z on z.asset_id = t.asset_id and t.probe < z.pts_us),
  c as (select *, case when af is null then 'hold' when abs(t - ap) <= 500 then 'copy' when zf is not null then 'interp' else 'hold' end as kind, (t - ap) / (zp - ap) as al from b)
  select asset_id, span_id, k, case when kind = 'interp' and cut then 'cut' else kind end as kind, case when kind = 'interp' and cut and al >= 0.5 then zf else coalesce(af, zf) end as a,
    case when kind = 'interp' and not cut then zf end as b, round(case when kind = 'interp' then al else 0.0 end, 7) as alpha from c""")
def resample_plan(spark, sf):
    f = fx.frames(spark, sf)
    cuts = f.filter(F.col("label") == "error").select("asset_id", "frame")
    return op.resample_plan(_spans(spark, sf), f.select("asset_id", "frame", "pts_us"), 1, 600, cuts).withColumn("alpha", F.round("alpha", 7))


@query("beats_in_clips", f"with {SPANS}, b as ({fx.BEATS_SQL}) select b.asset_id, b.event_id, span_id, start_us + time_us - in_us as timeline_us from b join sp on b.asset_id = sp.asset_id and time_us >= in_us and time_us < out_us")
def beats_in_clips(spark, sf):
    return op.beats_in_spans(_spans(spark, sf), fx.beats(spark, sf)).select("asset_id", "event_id", "span_id", "timeline_us")


@query("trim_window", f"""with {SPANS}, b as ({fx.BEATS_SQL}), c as (select *, in_us + (out_us - in_us + dur_us) / 2.0 as ce from sp),
  m as (select c.span_id, min({{'d': abs(time_us - ce), 't': time_us}}).t as beat from c join b on b.asset_id = c.asset_id and time_us between in_us + dur_us and out_us where dur_us < out_us - in_us group by 1)
  select asset_id, span_id, case when dur_us >= out_us - in_us then in_us::double else coalesce(beat::double, ce) - dur_us end as in_us, case when dur_us >= out_us - in_us then out_us::double else coalesce(beat::double, ce) end as out_us,
   beat is not null as on_beat from c left join m using (span_id)""")
def trim_window(spark, sf):
    return op.trim_window(_spans(spark, sf), fx.beats(spark, sf))


@query("nearest_anchor", f"""with f as ({fx.FRAMES_SQL}), s as (select asset_id, frame as sample from f where label in ('view', 'click')), a as (select asset_id, frame from f where label = 'error')
  select a.asset_id, a.frame, case when l.sample is null or (h.sample is not null and h.sample - a.frame < a.frame - l.sample) then h.sample else l.sample end as sample
  from a asof left join s l on l.asset_id = a.asset_id and a.frame >= l.sample asof left join s h on h.asset_id = a.asset_id and a.frame < h.sample""")
def nearest_anchor(spark, sf):
    f = fx.frames(spark, sf)
    samples = f.filter(F.col("label").isin("view", "click")).select("asset_id", F.col("frame").alias("sample"))
    return op.nearest_anchor(f.filter(F.col("label") == "error").select("asset_id", "frame"), samples)


RATE_TEXT = "case p_size % 6 when 0 then '29.97' when 1 then '30000/1001' when 2 then '24' when 3 then '23.976' when 4 then '12.5' else '48/2' end"


@query("frame_rates", f"""select asset_id, case when d in ('29.97', '30000/1001') then 30000 when d = '23.976' then 24000 when d = '12.5' then 25 else 24 end as num,
  case when d in ('29.97', '30000/1001', '23.976') then 1001 when d = '12.5' then 2 else 1 end as den, round(case when f in (24.0, 25.0, 30.0, 60.0) then f when abs(f - 30000/1001.0) <= 0.005 * 30000/1001.0 then 29.97 else f end, 3)::double as snapped,
  true as allowed, greatest(1, cast(floor((duration_ms * 24 * 2 + 1000) / 2000.0) as bigint)) as n_frames, cast(greatest(0, ceil(duration_ms / 3.0 / 1000 * f - 0.1)) as bigint) as first_frame,
  cast(greatest(1, ceil((size + 1) / f * 4 - 1e-6)) as bigint) as samples
  from (select asset_id, fps as f, duration_ms, size, d from ({fx.ASSETS_SQL}) join (select p_partkey as asset_id, {RATE_TEXT} as d from part) using (asset_id))""")
def frame_rates(spark, sf):
    a = fx.assets(spark, sf)
    pick = F.col("size") % 6
    text = F.when(pick == 0, "29.97").when(pick == 1, "30000/1001").when(pick == 2, "24").when(pick == 3, "23.976").when(pick == 4, "12.5").otherwise("48/2")
    fr = a.withColumn("fr", rates.parse_fps(text))
    one = F.lit(1).cast("bigint")
    return fr.select("asset_id", F.col("fr.num").cast("int").alias("num"), F.col("fr.den").cast("int").alias("den"), F.round(rates.snap_fps(F.col("fps")), 3).alias("snapped"),
                     rates.is_allowed_fps(F.col("fps")).alias("allowed"), rates.target_frame_count(F.lit(0), F.col("duration_ms"), F.lit(24), one).alias("n_frames"),
                     rates.frame_range_start(F.col("duration_ms") / 3.0, F.col("fps")).alias("first_frame"),
                     rates.expected_samples(F.lit(0), F.col("size"), F.col("fps"), F.lit(4.0)).alias("samples"))
