"""The render plan's queries, over ``orders`` (clips) and ``lineitem`` (keyframes of the clip that is their order)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.catalog.clock import bezier_sql
from mediaframe.catalog.timeline import FADE, FRAME, KNOWN, TOTAL, _plan_clips, _snaps, map_sql
from mediaframe.functions.easing import BEZIER
from mediaframe.operators import color, render
from mediaframe.operators import timeline as op

GRID = render.Grid(2.0)
SOURCE_LEN = 9000.0
EFFECTS = ["cameraSnap", "zoomPunch", "fadeToBlack"]
T, SRC, RATE, FROZEN = map_sql("local")
TE, SE, RE, FE = map_sql("edge")
IN = f"local between 0 and {TOTAL}"

#: Clips, transitions, picture times and layers, frame by frame.
PLAN = f"""w0 as ({fx.WIDE_SQL}), w as (select * replace (case when kind = 'video' then {TOTAL} else dur_ms end as dur_ms) from w0),
 v as (select *, start_ms + dur_ms as end_ms from w where kind = 'video' and not track_muted and out_ms > in_ms and dur_ms > 0),
 p as (select a.project_id, a.clip_id, min({{'g': abs(b.end_ms - a.start_ms), 'id': b.clip_id, 'd': b.dur_ms}}) as m from v a join v b on a.project_id = b.project_id and a.track_index = b.track_index
   and abs(b.end_ms - a.start_ms) < {FRAME} and b.start_ms < a.start_ms group by 1, 2),
 tr as (select v.project_id, track_index, v.clip_id, m.id as prev_id, start_ms as cut_ms, case when transition_type in ('dissolve', 'wipeLeft') then transition_type else 'dissolve' end as type,
   greatest(0, least(least(3000, greatest(100, transition_ms)), m.d, dur_ms)) as d from v join p using (project_id, clip_id) where transition_type is not null),
 sp as (select v.*, start_ms - coalesce((select max(d) from tr where tr.clip_id = v.clip_id), 0) / 2 as from_ms, end_ms + coalesce((select max(d) from tr where tr.prev_id = v.clip_id), 0) / 2 as to_ms from v),
 s as (select project_id, start_ms, dur_ms from w where effect = 'cameraSnap' and not track_muted),
 fr as (select project_id, unnest(range(0, (select max(n) from (select max(ceil(to_ms / 500 - 1e-6)) as n from sp union all select max(ceil((start_ms + dur_ms) / 500)) from w))::bigint)) as frame from (select distinct project_id from w)),
 vt as (select fr.project_id, frame, coalesce(min(s.start_ms), frame * 500.0)::double as video_ms from fr left join s on s.project_id = fr.project_id and frame * 500.0 >= start_ms and frame * 500.0 < start_ms + dur_ms group by 1, 2),
 l0 as (select sp.*, frame, video_ms, video_ms - start_ms as local from vt join sp on vt.project_id = sp.project_id and video_ms >= from_ms and video_ms < to_ms),
 l1 as (select *, case when local < 0 then 0.0 else {TOTAL} end as edge, coalesce(freeze_at + freeze_hold >= {TOTAL} and local > 0, false) and {TOTAL} - 1e-6 >= freeze_at as held from l0),
 l as (select *, case when {IN} then {SRC} else least(greatest({SE} + case when reversed then -1 else 1 end * (local - edge) * case when held then 0 else 1 / factor end, 0), {SOURCE_LEN}) end as source_ms,
   case when {IN} then {RATE} else case when held then 0 else 1 / factor end end as rate, case when {IN} then {FROZEN} else held end as frozen, least(greatest(local, 0.0), {TOTAL}) as local_ms from l1)"""


def _plan(spark, sf, kind):
    w = _plan_clips(spark, sf).withColumn("source_len", F.lit(SOURCE_LEN))
    li = fx.table(spark, sf, "lineitem").withColumn("n", F.col("l_linenumber").cast("bigint"))
    # whether the greatest status is O, in two flags: a greatest text would have all rows sorted
    status = F.col("l_linestatus")
    one = li.groupBy(F.col("l_orderkey").alias("clip_id"), F.col("l_returnflag").alias("property"), "n").agg(F.max("l_discount").alias("d"), F.max(status == "O").alias("o"), F.max(status > "O").alias("above"))
    keys = one.select("clip_id", "property", (F.col("n") * 700 - 500).alias("time_ms"), (F.col("d") * 10).alias("value"), F.when(F.col("o") & ~F.col("above"), "linear").otherwise("easeInOut").alias("easing"))
    box = li.filter(F.col("l_orderkey") % 2 == 0).groupBy(F.col("l_orderkey").alias("clip_id"), "n").agg((F.max("l_partkey") % 100).cast("double").alias("x1"), (F.max("l_suppkey") % 50).cast("double").alias("y1"), F.max("l_quantity").alias("q"))
    boxes = box.select("clip_id", ((F.col("clip_id") % 50) * 100 + F.col("n") * 900 - 1200).alias("time_ms"), "x1", "y1", (F.col("x1") + F.col("q")).alias("x2"), (F.col("y1") + F.col("q")).alias("y2"))
    i, project = F.col("clip_id"), F.col("project_id")
    graded = w.select("project_id", "clip_id", (i % 101 - 50).cast("double").alias("exposure"), F.when(i % 3 == 0, (i % 41).cast("double")).alias("contrast"))
    adjust = w.select("project_id").distinct().filter(project % 2 == 0).select("project_id", (project % 4 == 0).alias("enabled"), F.lit(10.0).alias("exposure"), F.lit(-5.0).alias("contrast"))
    # keys are written when their rows are planned, so only what is asked for gets its own
    keys, boxes = keys if kind == "transforms" else None, boxes if kind == "crops" else None
    plan = render.render_plan(w, op.find_transitions(w, FRAME, KNOWN), _snaps(w), GRID, EFFECTS, keys, boxes, color.effective_grade(graded, adjust))
    return plan[kind]


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("render_layers", f"""with {PLAN} select project_id, frame, track_index, clip_id, video_ms, round(local_ms, 4)::double as local_ms, round(source_ms, 4)::double as source_ms, round(rate, 4)::double as rate, frozen,
 round({FADE.format(t='local_ms', d='dur_ms')}, 6)::double as fade from l""")
def render_layers(spark, sf):
    return _rounded(_rounded(_plan(spark, sf, "layers"), 4, "local_ms", "source_ms", "rate"), 6, "fade")


@query("render_transforms", f"""with {PLAN}, k0 as (select l_orderkey as clip_id, l_returnflag as property, l_linenumber::bigint * 700 - 500 as tm, max(l_discount) * 10 as value, case max(l_linestatus) when 'O' then 'linear' else 'easeInOut' end as easing from lineitem group by 1, 2, 3),
 k as (select *, lead(tm) over o as t1, lead(value) over o as v1, row_number() over o as n from k0 window o as (partition by clip_id, property order by tm)),
 k2 as (select clip_id, property, tm as t0, t1, value as v0, v1, easing from k union all select clip_id, property, null, tm, null, value, null from k where n = 1),
 q as (select l.project_id, l.frame, l.track_index, l.clip_id, property, t0, v0, v1, easing, (local_ms - t0) / (t1 - t0) as u, k2.t1 from l join k2 on k2.clip_id = l.clip_id and (t0 is null or local_ms >= t0) and (k2.t1 is null or local_ms < k2.t1))
 select project_id, frame, track_index, clip_id, property, round(case when t0 is null then v1 when t1 is null then v0 else v0 + (v1 - v0) * case easing when 'linear' then u else {bezier_sql('u', BEZIER['easeInOut'])} end end, 6) as value from q""")
def render_transforms(spark, sf):
    return _rounded(_plan(spark, sf, "transforms"), 6, "value")


@query("render_crops", f"""with {PLAN}, k0 as (select l_orderkey as clip_id, (l_orderkey % 50) * 100 + l_linenumber::bigint * 900 - 1200 as tm, (max(l_partkey) % 100)::double as x1, (max(l_suppkey) % 50)::double as y1, max(l_partkey) % 100 + max(l_quantity) as x2, max(l_suppkey) % 50 + max(l_quantity) as y2
   from lineitem where l_orderkey % 2 = 0 group by 1, 2),
 k as (select *, lead({{'tm': tm, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) over o as hi, row_number() over o as n from k0 window o as (partition by clip_id order by tm)),
 q as (select l.project_id, frame, track_index, l.clip_id, k.*, case when hi is null then 0 else least(1, greatest(0, (source_ms - tm) / (hi.tm - tm))) end as u from l join k on k.clip_id = l.clip_id and (source_ms >= tm or n = 1) and (hi is null or source_ms < hi.tm))
 select project_id, frame, track_index, q.clip_id, {", ".join(f"round({c} + (coalesce(hi.{c}, {c}) - {c}) * u, 4)::double as {c}" for c in ("x1", "y1", "x2", "y2"))} from q""")
def render_crops(spark, sf):
    return _rounded(_plan(spark, sf, "crops"), 4, "x1", "y1", "x2", "y2")


@query("render_grades", f"""with {PLAN}, g as (select *, (clip_id % 101 - 50)::double as e0, case when clip_id % 3 = 0 then (clip_id % 41)::double end as c0, project_id % 4 = 0 as moved from l),
 e as (select project_id, frame, track_index, clip_id, case when moved then least(50, greatest(-50, e0 + 10)) else e0 end as exposure, case when moved then least(50, greatest(-50, coalesce(c0, 0) - 5)) else c0 end as contrast from g)
 select * from e where coalesce(exposure, 0) <> 0 or coalesce(contrast, 0) <> 0""")
def render_grades(spark, sf):
    return _plan(spark, sf, "grades")


@query("render_transitions", f"""with {PLAN}, q as (select vt.project_id, frame, track_index, clip_id, prev_id, type, (video_ms - (cut_ms - d / 2)) / d as raw from vt join tr on vt.project_id = tr.project_id and d > 0 and video_ms >= cut_ms - d / 2 and video_ms < cut_ms + d / 2)
 select project_id, frame, track_index, clip_id, prev_id, type, round(raw, 6)::double as raw, round({bezier_sql('raw', BEZIER['easeInOut'])}, 6)::double as progress from q""")
def render_transitions(spark, sf):
    return _rounded(_plan(spark, sf, "transitions"), 6, "raw", "progress")


@query("render_effects", f"""with {PLAN}, q as (select fr.project_id, frame, track_index, clip_id, effect, least(1.0, greatest(0.0, intensity)) as s, frame * 500.0 - start_ms as t, (frame * 500.0 - start_ms) / dur_ms as u
   from fr join w on fr.project_id = w.project_id and kind = 'fx' and not track_muted and frame * 500.0 >= start_ms and frame * 500.0 < start_ms + dur_ms where effect in ('cameraSnap', 'zoomPunch', 'fadeToBlack'))
 select project_id, frame, track_index, clip_id, effect, round(s, 6)::double as strength, round(case effect when 'fadeToBlack' then s * u when 'cameraSnap' then s * greatest(0, 1 - t / 250)
   else 1 + 0.15 * s * (case when u < 0.35 then 1 + 2.70158 * power(u / 0.35 - 1, 3) + 1.70158 * power(u / 0.35 - 1, 2) else 1 - (case when (u - 0.35) / 0.65 < 0.5 then 4 * power((u - 0.35) / 0.65, 3) else 1 - power(-2 * (u - 0.35) / 0.65 + 2, 3) / 2 end) end) end, 6)::double as amount from q""")
def render_effects(spark, sf):
    return _rounded(_plan(spark, sf, "effects"), 6, "strength", "amount")
