"""Bulk edits over the ``orders`` clips: the edited clip of each project is chosen by its id."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.catalog.clock import ease_sql
from mediaframe.catalog.timeline import FRAME, KNOWN, TOTAL
from mediaframe.operators import edits as op

W = f"w as ({fx.WIDE_SQL})"
# the unlocked link group of every chosen clip
GROUP = """own as (select w.project_id, w.clip_id, w.link_id, pick.* exclude (project_id, clip_id) from w join pick using (project_id, clip_id) where not locked),
 g as (select project_id, clip_id, {cols} from own union select w.project_id, w.clip_id, {ocols} from w join own using (project_id, link_id) where not w.locked)"""


def group(cols):
    return GROUP.format(cols=", ".join(cols) or "true as hit", ocols=", ".join("own." + c for c in cols) or "true as hit")


ONE = "select project_id, min(clip_id) as clip_id from w where kind = '{k}' and not locked group by 1"


def _one(w, kind="video"):
    return w.filter((F.col("kind") == kind) & ~F.col("locked")).groupBy("project_id").agg(F.min("clip_id").alias("clip_id"))


@query("move", f"""with {W}, pick as (select *, 370000 as anchor_start, 1 as target_track from ({ONE.format(k='video')})), {group([])},
 a as (select pick.project_id, anchor_start - start_ms as delta, target_track, track_index as src from pick join w using (project_id, clip_id)),
 lo as (select project_id, min(start_ms) as lo from w join g using (project_id, clip_id) group by 1),
 tk as (select project_id, track_index, any_value(locked) as lk from w group by 1, 2)
 select w.project_id, w.clip_id, case when g.hit then greatest(0, start_ms + greatest(delta, -lo)) else start_ms end as start_ms,
  case when g.hit and w.track_index = src and not coalesce(tk.lk, true) then target_track else w.track_index end as track_index
 from w left join g using (project_id, clip_id) left join a on a.project_id = w.project_id left join lo on lo.project_id = w.project_id left join tk on tk.project_id = w.project_id and tk.track_index = target_track""")
def move(spark, sf):
    w = fx.wide_clips(spark, sf)
    e = _one(w).withColumn("anchor_start", F.lit(370000).cast("bigint")).withColumn("target_track", F.lit(1).cast("bigint"))
    return op.move(w, e).select("project_id", "clip_id", "start_ms", "track_index")


MAIN = "select project_id, min(clip_id) as clip_id, 400000 as anchor_start from w where track_index = 0 and not locked group by 1"


@query("insert_reorder", f"""with {W}, pick as ({MAIN}), {group([])}, m as (select w.*, coalesce(hit, false) as mv from w left join g using (project_id, clip_id) where track_index = 0),
 b as (select m.project_id, any_value(anchor_start) - (any_value(x.start_ms) - min(m.start_ms)) + sum(m.dur_ms) / 2 as centre from m join pick on pick.project_id = m.project_id join w x on x.project_id = pick.project_id and x.clip_id = pick.clip_id where mv group by 1),
 pv as (select m.project_id, min({{'s': start_ms, 'c': clip_id}}) as pv from m join b using (project_id) where not mv and start_ms + dur_ms / 2 >= centre group by 1),
 z as (select m.*, case when mv then 1 when pv is null or {{'s': start_ms, 'c': clip_id}} < pv then 0 else 2 end as part from m join b using (project_id) left join pv using (project_id)),
 n as (select project_id, clip_id, (sum(dur_ms) over (partition by project_id order by part, start_ms, clip_id) - dur_ms)::bigint as ns from z)
 select w.project_id, w.clip_id, coalesce(ns, start_ms) as start_ms from w left join n using (project_id, clip_id)""")
def insert_reorder(spark, sf):
    w = fx.wide_clips(spark, sf)
    e = w.filter((F.col("track_index") == 0) & ~F.col("locked")).groupBy("project_id").agg(F.min("clip_id").alias("clip_id")).withColumn("anchor_start", F.lit(400000).cast("bigint"))
    return op.insert_reorder(w, e).select("project_id", "clip_id", "start_ms")


def _timed(w):
    """Timeline length consistent with speed and freeze."""
    return w.withColumn("dur_ms", (F.col("out_ms") - F.col("in_ms")) * F.col("factor") + F.coalesce("freeze_hold", F.lit(0))).withColumn("asset_ms", F.when(F.col("clip_id") % 3 != 0, F.col("out_ms") + 800))


WT = f"w0 as ({fx.WIDE_SQL}), w as (select * replace ({TOTAL} as dur_ms), case when clip_id % 3 <> 0 then out_ms + 800 end as asset_ms from w0)"


def _trim_sql(edge):
    if edge == "out":
        body = """t as (select *, greatest(40 - dur_ms, least(case when reversed then in_ms else coalesce(asset_ms, 'infinity'::double) - out_ms end * factor, delta)) as d from j),
 u as (select *, dur_ms + d as total, freeze_at is not null and d < 0 and dur_ms + d < freeze_at + freeze_hold and dur_ms + d > freeze_at as ih, freeze_at is not null and d < 0 and dur_ms + d <= freeze_at as bh from t),
 v as (select *, case when ih then -(dur_ms - freeze_at - freeze_hold) when bh then total - (dur_ms - freeze_hold) else d end / factor as s0 from u),
 x as (select *, case when out_ms - in_ms + s0 < 40 / factor then least(0, 40 / factor - (out_ms - in_ms)) else s0 end as s from v),
 r as (select *, start_ms as ns, case when reversed then greatest(0, in_ms - s) else in_ms end as ni, case when reversed then out_ms else least(coalesce(asset_ms, 'infinity'::double), out_ms + s) end as no,
   case when not bh then freeze_at end as na, case when ih then total - freeze_at when not bh then freeze_hold end as nh from x)"""
    else:
        body = """t as (select *, least(dur_ms - 40, greatest(-case when reversed then coalesce(asset_ms, 'infinity'::double) - out_ms else in_ms end * factor, delta)) as d from j),
 u as (select *, freeze_at is null or d <= freeze_at as ea, freeze_at is not null and d > freeze_at and d < freeze_at + freeze_hold as ih from t),
 v as (select *, case when ea then d / factor when ih then freeze_at / factor else (d - freeze_hold) / factor end as s0 from u),
 x as (select *, case when out_ms - in_ms - s0 < 40 / factor then greatest(0, out_ms - in_ms - 40 / factor) else s0 end as s from v),
 r as (select *, greatest(0, start_ms + d) as ns, case when reversed then in_ms else greatest(0, in_ms + s) end as ni, case when reversed then least(coalesce(asset_ms, 'infinity'::double), out_ms - s) else out_ms end as no,
   case when ea then freeze_at - d when ih then 0 end as na, case when ea then freeze_hold when ih then freeze_at + freeze_hold - d end as nh from x)"""
    return f"""with {WT}, pick as (select project_id, clip_id, clip_id % 9000 - 4000 as delta from w where link_id is null), j as (select w.*, delta from w join pick using (project_id, clip_id) where not locked), {body}
 select clip_id, round(ns, 4)::double as start_ms, round(ni, 4)::double as in_ms, round(no, 4)::double as out_ms, round(na, 4)::double as freeze_at, round(nh, 4)::double as freeze_hold, round((no - ni) * factor + coalesce(nh, 0), 4)::double as dur_ms from r
 union all select clip_id, start_ms::double, in_ms::double, out_ms::double, freeze_at::double, freeze_hold::double, dur_ms::double from w where locked or link_id is not null"""


def _trim(spark, sf, edge):
    w = _timed(fx.wide_clips(spark, sf))
    e = w.filter(F.col("link_id").isNull()).select("project_id", "clip_id", F.lit(edge).alias("edge"), (F.col("clip_id") % 9000 - 4000).alias("delta_ms"))
    out = op.trim(w, e, magnet=False)
    return out.select("clip_id", *[F.round(c, 4).alias(c) for c in ("start_ms", "in_ms", "out_ms", "freeze_at", "freeze_hold", "dur_ms")])


@query("trim_out", _trim_sql("out"))
def trim_out(spark, sf):
    return _trim(spark, sf, "out")


@query("trim_in", _trim_sql("in"))
def trim_in(spark, sf):
    return _trim(spark, sf, "in")


@query("split", f"""with {WT}, pick as (select project_id, clip_id, start_ms + 1500 as at_ms from w where link_id is null),
 j as (select w.*, at_ms, at_ms - start_ms as local from w left join (select pick.* from pick join w using (project_id, clip_id) where not locked) p using (project_id, clip_id)),
 k as (select *, coalesce(local > 20 and local < dur_ms - 20, false) as cut, case when freeze_at is null or local <= freeze_at then local when local < freeze_at + freeze_hold then freeze_at else local - freeze_hold end as play from j),
 s as (select *, case when reversed then out_ms - greatest(0, least(out_ms - in_ms, play / factor)) else in_ms + greatest(0, least(out_ms - in_ms, play / factor)) end as point, freeze_at is not null and local <= freeze_at as bf, freeze_at is not null and local > freeze_at and local < freeze_at + freeze_hold as wi from k)
 select clip_id, 'whole' as half, start_ms::double as start_ms, in_ms::double as in_ms, out_ms::double as out_ms, freeze_at::double as freeze_at, freeze_hold::double as freeze_hold, dur_ms::double as dur_ms, clip_id::varchar as clip_key from s where not cut
 union all select clip_id, 'left', start_ms, case when reversed then point else in_ms end, case when reversed then out_ms else point end, case when not bf then freeze_at end, case when wi then local - freeze_at when not bf then freeze_hold end, local, clip_id::varchar from s where cut
 union all select clip_id, 'right', at_ms, case when reversed then in_ms else point end, case when reversed then point else out_ms end, case when bf then freeze_at - local when wi then 0 end, case when bf then freeze_hold when wi then freeze_at + freeze_hold - local end, dur_ms - local,
   'clp_' || sha1(project_id || '|' || clip_id || '|' || at_ms) from s where cut""")
def split(spark, sf):
    w = _timed(fx.wide_clips(spark, sf))
    e = w.filter(F.col("link_id").isNull()).select("project_id", "clip_id", (F.col("start_ms") + 1500).alias("at_ms"))
    return op.split(w, e).select("clip_id", "half", "start_ms", "in_ms", "out_ms", "freeze_at", "freeze_hold", "dur_ms", "clip_key")


@query("delete", f"""with w0 as ({fx.WIDE_SQL}), o as (select *, (sum(dur_ms) over (partition by project_id, track_index order by start_ms, clip_id) - dur_ms)::bigint as b from w0), w as (select * exclude (b) replace (b as start_ms) from o),
 pick as (select project_id, clip_id from w where clip_id % 17 = 0), {group([])},
 k as (select w.* from w left join g using (project_id, clip_id) where hit is null), x as (select w.* from w join g using (project_id, clip_id) where track_index <> 0)
 select k.project_id, k.clip_id, greatest(0, k.start_ms - coalesce((select sum(x.dur_ms) from x where x.project_id = k.project_id and x.track_index = k.track_index and x.start_ms + x.dur_ms <= k.start_ms), 0))::bigint as start_ms from k""")
def delete(spark, sf):
    from mediaframe.operators import timeline as tl

    w = tl.compact_track(fx.wide_clips(spark, sf)).withColumn("start_ms", F.col("new_start")).drop("new_start")
    return op.delete(w, w.filter(F.col("clip_id") % 17 == 0).select("project_id", "clip_id"), magnet=True).select("project_id", "clip_id", "start_ms")


@query("set_speed", f"""with {WT}, pick as (select project_id, clip_id, 0.05 + (clip_id % 5) * 0.5 as speed from w where link_id is null), j as (select w.*, case when not locked and speed is not null then 1.0 / least(10.0, greatest(0.1, speed)) else factor end::double as nf, speed is not null and not locked as hit from w left join pick using (project_id, clip_id))
 select clip_id, round(nf, 6)::double as factor, round(freeze_at / factor * nf, 4)::double as freeze_at, round(case when hit then (out_ms - in_ms) * nf + coalesce(freeze_hold, 0) else dur_ms end, 4)::double as dur_ms from j""")
def set_speed(spark, sf):
    w = _timed(fx.wide_clips(spark, sf))
    e = w.filter(F.col("link_id").isNull()).select("project_id", "clip_id", (F.lit(0.05) + (F.col("clip_id") % 5) * 0.5).alias("speed"))
    return op.set_speed(w, e).select("clip_id", F.round("factor", 6).alias("factor"), F.round("freeze_at", 4).alias("freeze_at"), F.round("dur_ms", 4).alias("dur_ms"))


@query("freeze", f"""with {W}, pick as (select project_id, clip_id, start_ms + 900 as at_ms, 250 as hold_ms from w where link_id is null), j as (select w.*, at_ms, hold_ms, greatest(0, least(dur_ms, 900)) as l, at_ms is not null and not locked as hit from w left join pick using (project_id, clip_id))
 select clip_id, case when hit then case when freeze_at is null or l <= freeze_at then l when l < freeze_at + freeze_hold then freeze_at else l - freeze_hold end else freeze_at end as freeze_at, case when hit then hold_ms else freeze_hold end::bigint as freeze_hold,
  case when hit then dur_ms - coalesce(freeze_hold, 0) + 250 else dur_ms end as dur_ms from j""")
def freeze(spark, sf):
    w = fx.wide_clips(spark, sf)
    e = w.filter(F.col("link_id").isNull()).select("project_id", "clip_id", (F.col("start_ms") + 900).alias("at_ms"), F.lit(250).cast("bigint").alias("hold_ms"))
    return op.freeze(w, e).select("clip_id", "freeze_at", "freeze_hold", "dur_ms")


@query("toggle_reverse", f"with {W}, pick as (select project_id, clip_id from w where clip_id % 9 = 0), {group([])} select w.clip_id, reversed <> coalesce(hit, false) as reversed from w left join g using (project_id, clip_id)")
def toggle_reverse(spark, sf):
    w = fx.wide_clips(spark, sf)
    return op.toggle_reverse(w, w.filter(F.col("clip_id") % 9 == 0).select("project_id", "clip_id")).select("clip_id", "reversed")


PREV = f"""pv as (select a.project_id, a.clip_id, min({{'g': abs(b.start_ms + b.dur_ms - a.start_ms), 'id': b.clip_id, 'd': b.dur_ms}}) as m from @A@ a join @A@ b on a.project_id = b.project_id and a.track_index = b.track_index
   and abs(b.start_ms + b.dur_ms - a.start_ms) < {FRAME} and b.start_ms < a.start_ms group by 1, 2)"""


@query("set_transition", f"""with {W}, v as (select * from w where kind = 'video' and not locked), {PREV.replace('@A@', 'v')}, e as (select project_id, clip_id, case when clip_id % 4 <> 0 then 'flash' end as nt, clip_id % 5000 as nm from w where clip_id % 3 > 0)
 select w.clip_id, case when e.clip_id is not null and kind = 'video' and not locked then case when nt is null then null when m is not null then nt else transition_type end else transition_type end as transition_type,
  case when e.clip_id is not null and kind = 'video' and not locked then case when nt is null then null when m is not null then greatest(0, least(least(3000, greatest(100, nm)), m.d, dur_ms)) else transition_ms end else transition_ms end as transition_ms
 from w left join e using (project_id, clip_id) left join pv using (project_id, clip_id)""")
def set_transition(spark, sf):
    w = fx.wide_clips(spark, sf)
    i = F.col("clip_id")
    e = w.filter(i % 3 > 0).select("project_id", "clip_id", F.when(i % 4 != 0, "flash").alias("new_type"), (i % 5000).alias("new_ms"))
    return op.set_transition(w, e, FRAME).select("clip_id", "transition_type", "transition_ms")


@query("set_transition_on_all_cuts", f"""with {W}, v as (select * from w where kind = 'video' and not locked), {PREV.replace('@A@', 'v')}
 select w.clip_id, case when m is not null and track_index = 0 then 'zoomIn' else transition_type end as transition_type, case when m is not null and track_index = 0 then greatest(0, least(800, m.d, dur_ms)) else transition_ms end as transition_ms
 from w left join pv using (project_id, clip_id)""")
def set_transition_on_all_cuts(spark, sf):
    return op.set_transition_on_all_cuts(fx.wide_clips(spark, sf), "zoomIn", 800, FRAME).select("clip_id", "transition_type", "transition_ms")


@query("reconcile_transitions", f"""with {W}, af as (select * replace (case when clip_id % 5 = 0 then start_ms + 40 else start_ms end as start_ms) from w where clip_id % 19 <> 0), av as (select * from af where kind = 'video'), bv as (select * from w where kind = 'video'),
 {PREV.replace('@A@', 'av')}, {PREV.replace('@A@', 'bv').replace('pv as', 'qv as')}
 select af.clip_id, case when ok then case when transition_type in ('dissolve', 'wipeLeft') then transition_type else 'dissolve' end end as transition_type, case when ok then greatest(0, least(least(3000, greatest(100, transition_ms)), pd, dur_ms)) end as transition_ms
 from (select af.*, pv.m.d as pd, transition_type is not null and kind = 'video' and pv.m is not null and (qv.m is null or qv.m.id = pv.m.id) as ok from af left join pv using (project_id, clip_id) left join qv using (project_id, clip_id)) af""")
def reconcile_transitions(spark, sf):
    w = fx.wide_clips(spark, sf)
    after = w.filter(F.col("clip_id") % 19 != 0).withColumn("start_ms", F.when(F.col("clip_id") % 5 == 0, F.col("start_ms") + 40).otherwise(F.col("start_ms")))
    return op.reconcile_transitions(after, w, FRAME, KNOWN).select("clip_id", "transition_type", "transition_ms")


KEY_EDITS = "e as (select clip_id, time_us + 300 as time_us, value + 1 as value, 'elastic' as easing from k where event_id % 6 = 0)"


@query("set_keyframe", f"with k as ({fx.KEYFRAMES_SQL}), {KEY_EDITS} select clip_id, time_us, value, easing from k where not exists (select 1 from e where e.clip_id = k.clip_id and abs(e.time_us - k.time_us) <= 500) union all select * from e")
def set_keyframe(spark, sf):
    k = fx.keyframes(spark, sf)
    e = k.filter(F.col("event_id") % 6 == 0).select("clip_id", (F.col("time_us") + 300).alias("time_us"), (F.col("value") + 1).alias("value"), F.lit("elastic").alias("easing"))
    return op.set_keyframe(k.drop("event_id"), e, 500)


@query("remove_keyframe", f"with k as ({fx.KEYFRAMES_SQL}), {KEY_EDITS} select clip_id, time_us, value, easing from k where not exists (select 1 from e where e.clip_id = k.clip_id and abs(e.time_us - k.time_us) <= 500)")
def remove_keyframe(spark, sf):
    k = fx.keyframes(spark, sf)
    e = k.filter(F.col("event_id") % 6 == 0).select("clip_id", (F.col("time_us") + 300).alias("time_us"), "value", "easing")
    return op.set_keyframe(k.drop("event_id"), e, 500, remove=True)


@query("split_keyframes", f"""with k as ({fx.KEYFRAMES_SQL}), c as (select clip_id, 1705000000000000 + clip_id * 3600000000 as at_us from k group by 1),
 b as (select c.*, a.value as av, a.easing, z.value as bv, (at_us - a.time_us) / (z.time_us - a.time_us) as u from c asof left join k a on c.clip_id = a.clip_id and c.at_us >= a.time_us asof left join k z on c.clip_id = z.clip_id and c.at_us < z.time_us),
 f as (select clip_id, arg_min(easing, time_us) as fe from k group by 1),
 v as (select clip_id, at_us, round(case when av is null then bv when bv is null then av else av + (bv - av) * {ease_sql('u', 'easing')} end, 6) as value, coalesce(easing, fe) as easing from b join f using (clip_id))
 select clip_id, 'left' as half, time_us, round(value, 6) as value, easing from k join c using (clip_id) where time_us - at_us < -500 union all select clip_id, 'right', time_us - at_us, round(value, 6), easing from k join c using (clip_id) where time_us - at_us > 500
 union all select clip_id, 'left', at_us, value, easing from v union all select clip_id, 'right', 0, value, easing from v""")
def split_keyframes(spark, sf):
    k = fx.keyframes(spark, sf).drop("event_id")
    cuts = k.select("clip_id").distinct().withColumn("at_us", F.lit(1705000000000000) + F.col("clip_id") * 3600000000)
    return op.split_keyframes(k, cuts, 500, 86_400_000_000).withColumn("value", F.round("value", 6))


@query("retime_keyframes", f"""with {W}, k as (select clip_id, unnest([100, dur_ms // 3 + 150, dur_ms - 50]) as time_ms from w), t as (select clip_id, factor, freeze_at, freeze_hold, 0.25 as nf, case when clip_id % 2 = 0 then 700 end as na, 300 as nh from w where clip_id % 3 > 0),
 p as (select k.*, t.* exclude (clip_id), case when freeze_at is null or time_ms <= freeze_at then time_ms when time_ms < freeze_at + freeze_hold then freeze_at else time_ms - freeze_hold end / factor * nf as np from k left join t using (clip_id))
 select clip_id, round(case when factor is null then time_ms when na is null then np when time_ms > freeze_at and time_ms < freeze_at + freeze_hold then na + time_ms - freeze_at when np <= na + 0.001 then np else np + nh end, 4)::double as time_ms from p""")
def retime_keyframes(spark, sf):
    w = fx.wide_clips(spark, sf)
    d = F.col("dur_ms")
    keys = w.select("clip_id", F.explode(F.array(F.lit(100).cast("bigint"), F.floor(d / 3) + 150, d - 50)).alias("time_ms"))
    timing = w.filter(F.col("clip_id") % 3 > 0).select("clip_id", F.col("factor").alias("old_factor"), F.col("freeze_at").alias("old_at"), F.col("freeze_hold").alias("old_hold"), F.lit(0.25).alias("new_factor"),
                                                      F.when(F.col("clip_id") % 2 == 0, 700).alias("new_at"), F.lit(300).alias("new_hold"))
    return op.retime_keyframes(keys, timing).select("clip_id", F.round("time_ms", 4).alias("time_ms"))


VOICE = "v as (select *, case clip_id % 3 when 0 then 'original' when 1 then 'voice' else 'background' end as voice, clip_id % 23 as grade_id from w)"


def _voiced(spark, sf):
    i = F.col("clip_id")
    return fx.wide_clips(spark, sf).withColumn("voice", F.when(i % 3 == 0, "original").when(i % 3 == 1, "voice").otherwise("background")).withColumn("grade_id", i % 23)


MIRROR = """av as (select * from v where kind in ('video', 'audio')), mi as (select a.project_id, a.clip_id, min({'t': b.track_index, 'c': b.clip_id}).c as mirror_id from av a join av b on a.project_id = b.project_id and a.kind <> b.kind and a.asset_id = b.asset_id
   and ((a.link_id is not null and a.link_id = b.link_id) or (a.link_id is null and b.link_id is null and abs(a.start_ms - b.start_ms) < 1)) group by 1, 2)"""


@query("set_voice_mode", f"""with {W}, {VOICE}, {MIRROR}, e as (select av.project_id, av.clip_id, mirror_id from av left join mi using (project_id, clip_id) where av.clip_id % 8 = 0 and kind = 'video'), h as (select project_id, clip_id from e union select project_id, mirror_id from e where mirror_id is not null)
 select v.clip_id, case when h.clip_id is not null then 'voice' else voice end as voice from v left join h using (project_id, clip_id)""")
def set_voice_mode(spark, sf):
    v = _voiced(spark, sf)
    e = v.filter((F.col("clip_id") % 8 == 0) & (F.col("kind") == "video")).select("project_id", "clip_id", F.lit("voice").alias("mode"))
    return op.set_voice_mode(v, e).select("clip_id", "voice")


@query("audio_mirrors", f"""with {W}, o as (select project_id, clip_id, link_id, asset_id from w where clip_id % 21 = 0) select project_id, clip_id from o union select w.project_id, w.clip_id from w join o using (project_id, link_id, asset_id)""")
def audio_mirrors(spark, sf):
    w = fx.wide_clips(spark, sf)
    return op.audio_mirrors(w, w.filter(F.col("clip_id") % 21 == 0).select("project_id", "clip_id"))


@query("apply_grade_to_all", f"with {W}, {VOICE}, s as (select project_id, arg_min(grade_id, clip_id) as g, arg_min(asset_id, clip_id) as a from v where kind = 'video' group by 1) select clip_id, case when kind = 'video' and not locked and asset_id = a then g else grade_id end as grade_id from v left join s using (project_id)")
def apply_grade_to_all(spark, sf):
    v = _voiced(spark, sf)
    e = v.filter(F.col("kind") == "video").groupBy("project_id").agg(F.min("clip_id").alias("clip_id"))
    return op.apply_grade_to_all(v, e, same_source_only=True).select("clip_id", "grade_id")


@query("paste_attributes", f"""with {W}, {VOICE}, s as (select project_id, arg_min(grade_id, clip_id) as g, arg_min(factor, clip_id) as f, arg_min(voice, clip_id) as o from v group by 1)
 select clip_id, case when clip_id % 4 in (0, 1) and not locked then g else grade_id end as grade_id, case when clip_id % 4 in (1, 2) and not locked then f else factor end as factor, voice from v join s using (project_id)""")
def paste_attributes(spark, sf):
    v = _voiced(spark, sf)
    src = v.groupBy("project_id").agg(F.min("clip_id").alias("source_id"))
    m = F.col("clip_id") % 4
    parts = F.when(m == 0, F.array(F.lit("color"))).when(m == 1, F.array(F.lit("color"), F.lit("speed"))).when(m == 2, F.array(F.lit("speed"))).otherwise(F.array().cast("array<string>"))
    e = v.select("project_id", "clip_id", parts.alias("parts")).join(src, "project_id")
    return op.paste_attributes(v, e, {"color": ["grade_id"], "speed": ["factor"], "audio": ["voice"]}).select("clip_id", "grade_id", "factor", "voice")


@query("separate_to_tracks", f"""with recursive {W}, {VOICE}, {MIRROR}, an as (select v.*, mirror_id from v left join mi on mi.project_id = v.project_id and mi.clip_id = v.clip_id and v.link_id is not null where kind = 'video' and asset_id <> 4 and v.clip_id % 10 = 0),
 q as (select an.*, coalesce(o.muted, an.muted) as om, coalesce(o.voice, an.voice) as ov from an left join v o on o.project_id = an.project_id and o.clip_id = an.mirror_id),
 st as (select *, unnest(['vocals', 'background']) as stem from q), mu as (select distinct project_id, coalesce(mirror_id, clip_id) as clip_id from q)
 select clip_id::varchar as clip_key, null::varchar as stem, null::varchar as role, v.muted or mu.clip_id is not null as muted, start_ms from v left join mu using (project_id, clip_id)
 union all select 'clp_' || sha1(project_id || '|' || clip_id || '|' || stem), stem, case stem when 'vocals' then 'voice' else 'background' end, om or (ov = 'voice' and stem = 'background') or (ov = 'background' and stem = 'vocals'), start_ms from st""")
def separate_to_tracks(spark, sf):
    v = _voiced(spark, sf)
    assets = spark.createDataFrame([(i, f"v{i}" if i != 4 else None, f"b{i}") for i in range(7)], "asset_id bigint, vocals string, background string")
    out = op.separate_to_tracks(v, assets, v.filter(F.col("clip_id") % 10 == 0).select("project_id", "clip_id"))
    return out.select("clip_key", "stem", "role", "muted", "start_ms")


@query("rough_cut", f"""with a as (select asset_id // 100 as project_id, asset_id, duration_ms, asset_id % 3 > 0 as has_audio from ({fx.ASSETS_SQL}) where kind = 'video'), p as (select *, (sum(duration_ms) over (partition by project_id order by asset_id) - duration_ms)::bigint as start_ms from a),
 k as (select *, unnest(case when has_audio then ['video', 'audio'] else ['video'] end) as kind from p)
 select project_id, asset_id, kind, start_ms, 0 as in_ms, duration_ms as out_ms, case when has_audio then 'lnk_' || sha1(project_id || '|' || asset_id) end as link_key from k""".replace("0 as in_ms", "0::bigint as in_ms"))
def rough_cut(spark, sf):
    a = fx.assets(spark, sf).filter(F.col("kind") == "video")
    return op.rough_cut(a.select(F.floor(F.col("asset_id") / 100).alias("project_id"), "asset_id", F.col("asset_id").alias("story_pos"), "duration_ms", (F.col("asset_id") % 3 > 0).alias("has_audio")))


@query("apply_analysis", f"""with {W}, c as (select * from w where project_id % 2 = 0 union all select * replace (start_ms // 4000 * 4000 as start_ms, clip_id % 3 * 100 as in_ms, clip_id % 3 * 100 + 900 as out_ms, null::bigint as link_id) from w where project_id % 2 = 1),
 v as (select *, row_number() over (partition by project_id, asset_id, start_ms, in_ms, out_ms order by track_index, clip_id) as k from c where kind = 'video' and link_id is null), a as (select *, row_number() over (partition by project_id, asset_id, start_ms, in_ms, out_ms order by track_index, clip_id) as k from c where kind = 'audio' and link_id is null),
 p as (select project_id, v.clip_id as vid, a.clip_id as aid from v join a using (project_id, asset_id, start_ms, in_ms, out_ms, k)), l as (select project_id, vid as clip_id, vid as link from p union all select project_id, aid, vid from p)
 select c.project_id, c.clip_id, coalesce(c.link_id, link) as link_id from c left join l using (project_id, clip_id)""")
def apply_analysis(spark, sf):
    w = fx.wide_clips(spark, sf)
    t = F.col("clip_id") % 3 * 100
    new = w.filter(F.col("project_id") % 2 == 1).withColumn("start_ms", F.floor(F.col("start_ms") / 4000) * 4000).withColumn("in_ms", t).withColumn("out_ms", t + 900).withColumn("link_id", F.lit(None).cast("bigint"))
    a = fx.assets(spark, sf).select(F.col("path").alias("path_key"), "asset_id", F.col("size").alias("order"), F.lit("t").alias("tags"))
    b = fx.beats(spark, sf).select(F.col("asset_id").alias("project_id"), "time_us")
    done = op.apply_analysis({"clips": w, "assets": a, "beats": b}, {"clips": new, "assets": a, "beats": b})
    return done["clips"].select("project_id", "clip_id", "link_id")
