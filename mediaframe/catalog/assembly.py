"""Fitting and placing shots: ``orders`` for durations, ``events`` for the whole way from scores to clips."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.catalog.shots import SHOTS
from mediaframe.functions import rates
from mediaframe.operators import assembly as op
from mediaframe.operators import shots as shot_op
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of
from mediaframe.session import cut_lineage


def fit_sql(src):
    """src needs group_id, pos, dur_ms, value, target_ms."""
    return f"""rk as (select *, sum(least(dur_ms, 1500)) over (partition by group_id order by pos > 0, value desc, pos) as fl, sum(dur_ms) over (partition by group_id) as tot from {src}),
 k as (select * from rk where tot <= target_ms or fl <= target_ms or pos = 0),
 z as (select *, row_number() over w as kk, sum(dur_ms) over w - dur_ms as sh, count(*) over (partition by group_id) as n from k where tot > target_ms window w as (partition by group_id order by dur_ms, pos)),
 lv as (select group_id, min({{'k': kk, 'l': (target_ms - sh) / (n - kk + 1)}}).l as lvl from z where (target_ms - sh) / (n - kk + 1) <= dur_ms group by 1),
 fit as (select rk.*, cast(case when k.pos is null then 0 when rk.tot <= rk.target_ms then rk.dur_ms else least(rk.dur_ms, greatest(floor(coalesce(lvl, rk.dur_ms::double)), 1500)) end as bigint) as fitted_ms
   from rk left join k using (group_id, pos) left join lv using (group_id))"""


@query("fit_durations", f"""with s as (select asset_id as group_id, shot as pos, dur_ms, value from ({fx.SHOTS_SQL})), t as (select *, cast(sum(dur_ms) over (partition by group_id) * (group_id % 7 + 2) // 10 as bigint) as target_ms from s), {fit_sql('t')}
 select group_id, pos, fitted_ms from fit""")
def fit_durations(spark, sf):
    s = fx.shots(spark, sf).select(F.col("asset_id").alias("group_id"), F.col("shot").alias("pos"), "dur_ms", "value")
    t = s.groupBy("group_id").agg(F.sum("dur_ms").alias("all")).select("group_id", F.floor(F.col("all") * (F.col("group_id") % 7 + 2) / 10).alias("target_ms"))
    return op.fit_durations(s, t).select("group_id", "pos", "fitted_ms")


@query("shot_value", f"select asset_id, shot, round(shot % 3 + 0.25 * least(dur_ms / 1000, 4.0) - case when value > 8 then 0.5 else 0 end, 6)::double as worth from ({fx.SHOTS_SQL})")
def shot_value(spark, sf):
    s = fx.shots(spark, sf)
    return s.select("asset_id", "shot", F.round(op.shot_value(F.col("shot") % 3, F.col("dur_ms"), F.col("value") > 8), 6).alias("worth"))


def cut_sql(t):
    outs = [f"{t} - 0.25"] + [f"floor(({t} + 0.0) * {g!r}::double / 1000.0 + 0.5 - 1e-4) * 1000.0 / {g!r}::double - 0.25" for g in rates.EXPORT_GRIDS]
    ins = [f"{t} + 0.25"] + [f"floor(({t} + 1.0) * {g!r}::double / 1000.0 + 0.5 + 1e-4) * 1000.0 / {g!r}::double + 0.25" for g in rates.EXPORT_GRIDS]
    return f"least({', '.join(outs)})", f"greatest({', '.join(ins)})"


@query("shot_ranges", f"""with s as (select o.*, sum(dur_ms) over w - dur_ms as st from ({fx.SHOTS_SQL}) o window w as (partition by asset_id order by shot)),
 f as (select asset_id, shot, (st // 40)::bigint as start_frame, ((st + dur_ms) // 40 - 1 - case when shot % 4 = 0 then 1 else 0 end)::bigint as end_frame, st::double as start_ms, (st + dur_ms - 40)::double as end_ms, case when shot % 5 = 0 then st + dur_ms - 30 else 0 end::double as duration_ms from s),
 l as (select *, lag(end_frame) over w as pe, lag(end_ms) over w as pm, lead(start_frame) over w as nf, lead(start_ms) over w as nm from f window w as (partition by asset_id order by shot)),
 c as (select asset_id, shot, case when pe + 1 = start_frame and start_ms > pm then {cut_sql('start_ms')[1]} else start_ms end as a, case when end_frame + 1 = nf and nm > end_ms then {cut_sql('nm')[0]} else end_ms + 40.0 end as b, duration_ms from l)
 select asset_id, shot, round(a, 3) as in_ms, round(case when duration_ms > 0 then least(b, duration_ms) else b end, 3) as out_ms from c""")
def shot_ranges(spark, sf):
    s = scan.ordered_scan(fx.shots(spark, sf), ["asset_id"], [F.col("shot")], bucket_of(F.col("shot"), 65536), st=scan.prefix_sum(F.col("dur_ms")))
    st, end = F.col("st"), F.col("st") + F.col("dur_ms")
    f = s.select("asset_id", "shot", F.floor(st / 40).alias("start_frame"), (F.floor(end / 40) - 1 - F.when(F.col("shot") % 4 == 0, 1).otherwise(0)).alias("end_frame"), st.cast("double").alias("start_ms"),
                 (end - 40).cast("double").alias("end_ms"), F.when(F.col("shot") % 5 == 0, end - 30).otherwise(0).cast("double").alias("duration_ms"))
    return op.shot_ranges(f, F.lit(40.0)).select("asset_id", "shot", "in_ms", "out_ms")


def _ranges(spark, sf):
    """Shots of the event scores, ten projects of many assets, placed in (asset, shot) order."""
    s = shot_op.detect_shots(fx.frames(spark, sf))
    r = s.select((F.col("asset_id") % 10).alias("group_id"), "asset_id", "shot", F.floor(F.col("start_us") / 1000).alias("in_ms"), (F.floor(F.col("end_us") / 1000) + 41).alias("out_ms"))
    dur = F.col("out_ms") - F.col("in_ms")
    r = r.withColumn("value", op.shot_value(F.col("shot") % 3, dur, F.col("shot") % 5 == 0)).withColumn("has_audio", F.col("asset_id") % 4 > 0)
    n = scan.ordered_scan(r, ["group_id"], [F.col("asset_id"), F.col("shot")], F.struct(F.col("asset_id"), bucket_of(F.col("shot"), 65536).alias("b")), pos=scan.number())
    n = cut_lineage(n.withColumn("pos", F.col("pos") - 1))
    t = n.groupBy("group_id").agg(F.floor(F.sum(F.col("out_ms") - F.col("in_ms")) * 6 / 10).alias("target_ms"))
    beats = fx.beats(spark, sf).select("asset_id", F.floor(F.col("time_us") / 1000).alias("time_us")).distinct()
    return n, t, beats


ASSEMBLED = SHOTS + f""", q as (select asset_id % 10 as group_id, asset_id, shot, start_us // 1000 as in_ms, end_us // 1000 + 41 as out_ms from shots),
 p as (select *, row_number() over (partition by group_id order by asset_id, shot) - 1 as pos, out_ms - in_ms as dur_ms, (shot % 3 + least((out_ms - in_ms) / 1000.0::double, 4.0::double) * 0.25::double - case when shot % 5 = 0 then 0.5 else 0.0 end::double) as value from q),
 t as (select *, cast(sum(dur_ms) over (partition by group_id) * 6 // 10 as bigint) as target_ms from p), {fit_sql('t')},
 pl as (select *, (sum(fitted_ms) over (partition by group_id order by pos) - fitted_ms)::bigint as start_ms, in_ms + (out_ms - in_ms + fitted_ms) / 2.0::double as ce from fit where fitted_ms > 0),
 bt as (select distinct asset_id, time_us // 1000 as b from ({fx.BEATS_SQL})),
 bm as (select group_id, pos, min({{'d': abs(b - ce), 'b': b}}).b as beat from pl join bt on bt.asset_id = pl.asset_id and b between in_ms + fitted_ms and out_ms where fitted_ms < dur_ms group by 1, 2),
 tl as (select pl.*, case when fitted_ms >= dur_ms then in_ms::double else coalesce(beat::double, ce) - fitted_ms end as ci, case when fitted_ms >= dur_ms then out_ms::double else coalesce(beat::double, ce) end as co, beat is not null as on_beat from pl left join bm using (group_id, pos))
"""


@query("assemble_timeline", ASSEMBLED + """select group_id, asset_id, pos, shot, unnest(case when asset_id % 4 > 0 then ['video', 'audio'] else ['video'] end) as kind, start_ms, ci as in_ms, co as out_ms, on_beat from tl""")
def assemble_timeline(spark, sf):
    n, t, beats = _ranges(spark, sf)
    return op.assemble_timeline(n, t, beats)


@query("timeline_beats", ASSEMBLED + "select group_id, pos, tl.asset_id, b as time_us, start_ms + b - ci as time_ms from tl join bt on bt.asset_id = tl.asset_id and b >= ci and b < co")
def timeline_beats(spark, sf):
    n, t, beats = _ranges(spark, sf)
    return op.timeline_beats(op.assemble_timeline(n, t, beats), beats)


@query("cross_clip_cuts", f"""with e as (select asset_id % 10 as group_id, asset_id, max(shot) as l, min(shot) as f from ({fx.SHOTS_SQL}) group by 1, 2), n as (select *, lead(asset_id) over w as ta, lead(f) over w as ts from e window w as (partition by group_id order by asset_id))
 select group_id, asset_id as from_asset, l as from_shot, ta as to_asset, ts as to_shot from n where ta is not null""")
def cross_clip_cuts(spark, sf):
    s = fx.shots(spark, sf)
    return op.cross_clip_cuts(s.select((F.col("asset_id") % 10).alias("group_id"), F.col("asset_id").alias("story_pos"), "asset_id", "shot"))


@query("progress_weights", f"""with a as (select asset_id // 200 as group_id, asset_id as pos, round(greatest(1000.0, duration_ms) * case when asset_id % 3 = 0 then 0.03 else 1.0 end * 1000)::bigint as w from ({fx.ASSETS_SQL})),
 s as (select *, sum(w) over (partition by group_id order by pos) - w as b, sum(w) over (partition by group_id) as t from a),
 g as (select * from (values ('ingest', 0.0, 0.01), ('shots', 0.01, 0.06), ('perception', 0.07, 0.55), ('reframe', 0.62, 0.30), ('audio', 0.92, 0.04), ('transitions', 0.96, 0.04)) v(stage, pt, share))
 select group_id, pos, stage, round(0.02 + 0.95 * b::double / t + 0.95 * w::double / t * pt, 7)::double as start, round(0.95 * w::double / t * share, 7)::double as span from s cross join g""")
def progress_weights(spark, sf):
    a = fx.assets(spark, sf).select(F.floor(F.col("asset_id") / 200).alias("group_id"), F.col("asset_id").alias("pos"), "duration_ms", (F.col("asset_id") % 3 == 0).alias("cached"))
    return op.progress_weights(a).select("group_id", "pos", "stage", F.round("start", 7).alias("start"), F.round("span", 7).alias("span"))
