"""Timeline queries over ``orders`` (one clip per order)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.catalog.clock import bezier_sql
from mediaframe.functions import playback as pb
from mediaframe.functions.easing import BEZIER
from mediaframe.operators import timeline as op

FRAME = 1000 / 24
C = f"c as ({fx.CLIPS_SQL})"
Wd = f"w as ({fx.WIDE_SQL})"
KNOWN = ["dissolve", "wipeLeft"]


def sel(df, *cols):
    return df.select(*cols)


ADJ = f"""{C}, e as (select *, start_ms + dur_ms as end_ms from c),
 p as (select a.project_id, a.clip_id, min({{'g': abs(b.end_ms - a.start_ms), 'id': b.clip_id}}).id as prev_id from e a join e b on a.project_id = b.project_id and a.track_index = b.track_index
   and abs(b.end_ms - a.start_ms) < {FRAME} and b.start_ms < a.start_ms group by 1, 2),
 n as (select a.project_id, a.clip_id, min({{'g': abs(b.start_ms - a.end_ms), 'id': b.clip_id}}).id as next_id from e a join e b on a.project_id = b.project_id and a.track_index = b.track_index
   and abs(b.start_ms - a.end_ms) < {FRAME} and b.start_ms > a.start_ms group by 1, 2)"""


@query("adjacent_clips", f"with {ADJ} select c.project_id, c.clip_id, prev_id, next_id from c left join p using (project_id, clip_id) left join n using (project_id, clip_id)")
def adjacent_clips(spark, sf):
    return op.adjacent_clips(fx.clips(spark, sf), FRAME).select("project_id", "clip_id", "prev_id", "next_id")


@query("cuts", f"with {ADJ} select p.project_id, p.clip_id, prev_id, b.dur_ms as prev_dur_ms from p join c b on b.project_id = p.project_id and b.clip_id = prev_id")
def cuts(spark, sf):
    return op.previous_clips(fx.clips(spark, sf), FRAME)


TRANS = f"""with {Wd}, v as (select *, start_ms + dur_ms as end_ms from w where kind = 'video' and not track_muted),
 p as (select a.project_id, a.clip_id, min({{'g': abs(b.end_ms - a.start_ms), 'id': b.clip_id, 'd': b.dur_ms}}) as m from v a join v b on a.project_id = b.project_id and a.track_index = b.track_index
   and abs(b.end_ms - a.start_ms) < {FRAME} and b.start_ms < a.start_ms group by 1, 2),
 tr as (select v.project_id, track_index, v.clip_id, m.id as prev_id, start_ms as cut_ms, case when transition_type in ('dissolve', 'wipeLeft') then transition_type else 'dissolve' end as type,
   case when m.id is not null then greatest(0, least(least(3000, greatest(100, transition_ms)), m.d, dur_ms)) end as dur_ms,
   case when m.id is null then 'ignored: no clip ends where it starts' when transition_type = 'sparkle' then 'unknown type, rendered as a dissolve' end as warning
   from v left join p using (project_id, clip_id) where transition_type is not null)
"""


@query("find_transitions", TRANS + "select * from tr")
def find_transitions(spark, sf):
    return op.find_transitions(fx.wide_clips(spark, sf), FRAME, KNOWN)


@query("transition_at", TRANS + f""", t as (select distinct project_id, start_ms + 100 as t from w), h as (select tr.clip_id, t.project_id, t.t, (t.t - (cut_ms - dur_ms / 2)) / dur_ms as raw from t join tr on t.project_id = tr.project_id
   and t.t >= cut_ms - dur_ms / 2 and t.t < cut_ms + dur_ms / 2 where dur_ms > 0)
 select project_id, clip_id, t, round(raw, 6) as raw, round({bezier_sql('raw', BEZIER['easeInOut'])}, 6) as progress from h""")
def transition_at(spark, sf):
    w = fx.wide_clips(spark, sf)
    times = w.select("project_id", (F.col("start_ms") + 100).alias("t")).distinct()
    out = op.transition_at(op.find_transitions(w, FRAME, KNOWN), times)
    return out.select("project_id", "clip_id", "t", F.round("raw", 6).alias("raw"), F.round("progress", 6).alias("progress"))


MID = "t as (select project_id, clip_id as time_id, start_ms + dur_ms // 2 as t from c)"


def _mid(c):
    return c.select("project_id", F.col("clip_id").alias("time_id"), (F.col("start_ms") + F.floor(F.col("dur_ms") / 2)).alias("t"))


@query("clips_at", f"with {C}, {MID} select t.project_id, time_id, c.clip_id, c.track_index from t join c on c.project_id = t.project_id and t >= start_ms and t < start_ms + dur_ms where kind = 'video' and not track_muted")
def clips_at(spark, sf):
    c = fx.clips(spark, sf)
    return op.clips_at(c, _mid(c)).select("project_id", "time_id", "clip_id", "track_index")


@query("top_clip_at", f"""with {C}, {MID} select t.project_id, time_id, max({{'a': c.track_index, 'b': c.clip_id}}).a as track_index, max({{'a': c.track_index, 'b': c.clip_id}}).b as clip_id
 from t join c on c.project_id = t.project_id and t >= start_ms and t < start_ms + dur_ms where kind = 'video' and not track_muted group by 1, 2""")
def top_clip_at(spark, sf):
    c = fx.clips(spark, sf)
    return op.top_clip_at(c, _mid(c)).drop("t")


@query("active_effects", f"with {C}, {MID} select t.project_id, time_id, c.clip_id, c.track_index, t - start_ms as local_ms from t join c on c.project_id = t.project_id and t >= start_ms and t < start_ms + dur_ms where kind = 'fx' and not track_muted")
def active_effects(spark, sf):
    c = fx.clips(spark, sf)
    return op.active_effects(c, _mid(c)).select("project_id", "time_id", "clip_id", "track_index", "local_ms")


SNAPS = "s as (select project_id, clip_id, start_ms, dur_ms from w where effect = 'cameraSnap' and not track_muted)"


def _snaps(w):
    return w.filter((F.col("effect") == "cameraSnap") & ~F.col("track_muted")).select("project_id", "start_ms", "dur_ms")


@query("video_times", f"with {Wd}, {SNAPS}, t as (select distinct project_id, start_ms + 55 as t from w) select t.project_id, t, coalesce(min(start_ms), t) as video_ms from t left join s on s.project_id = t.project_id and t >= start_ms and t < start_ms + dur_ms group by 1, 2")
def video_times(spark, sf):
    w = fx.wide_clips(spark, sf)
    return op.video_times(w.select("project_id", (F.col("start_ms") + 55).alias("t")).distinct(), _snaps(w))


@query("span_is_free", f"""with {C}, sp as (select project_id, track_index, clip_id as span_id, start_ms + dur_ms as start_ms, start_ms + dur_ms + 200 as end_ms from c)
 select span_id from sp where not exists (select 1 from c where c.project_id = sp.project_id and c.track_index = sp.track_index and c.start_ms < sp.end_ms - 0.001 and c.start_ms + c.dur_ms > sp.start_ms + 0.001)""")
def span_is_free(spark, sf):
    c = fx.clips(spark, sf)
    end = op.end_ms()
    spans = c.select("project_id", "track_index", F.col("clip_id").alias("span_id"), end.alias("start_ms"), (end + 200).alias("end_ms"))
    return op.span_is_free(spans, c).select("span_id")


@query("project_duration", f"with {C} select project_id, max(start_ms + dur_ms) as duration_ms from c group by 1")
def project_duration(spark, sf):
    return op.project_duration(fx.clips(spark, sf))


@query("cut_points", f"with {C} select distinct project_id, unnest([0, start_ms, start_ms + dur_ms]) as t from c")
def cut_points(spark, sf):
    return op.cut_point_times(fx.clips(spark, sf))


@query("compact_track", f"with {C} select project_id, clip_id, (sum(dur_ms) over (partition by project_id, track_index order by start_ms, clip_id) - dur_ms)::bigint as new_start from c")
def compact_track(spark, sf):
    return op.compact_track(fx.clips(spark, sf)).select("project_id", "clip_id", "new_start")


PUSH = """o as (select *, sum(dur_ms) over (partition by project_id, track_index order by start_ms, clip_id) - dur_ms as b from c),
 r as (select *, (b + greatest(0, max(start_ms - b) over (partition by project_id, track_index order by start_ms, clip_id)))::bigint as new_start from o)"""


@query("resolve_overlaps", f"with {C}, {PUSH} select project_id, clip_id, new_start from r")
def resolve_overlaps(spark, sf):
    return op.resolve_overlaps(fx.clips(spark, sf)).select("project_id", "clip_id", "new_start")


PINNED = """n as (select *, row_number() over (partition by project_id, track_index order by start_ms, clip_id) as k from p),
 g as (select project_id, track_index, clip_id, k, start_ms as new_start, start_ms + dur_ms as cur from n where k = 1
  union all select n.project_id, n.track_index, n.clip_id, n.k, case when n.pinned then n.start_ms else greatest(n.start_ms, g.cur) end,
   case when n.pinned then greatest(g.cur, n.start_ms + n.dur_ms) else greatest(n.start_ms, g.cur) + n.dur_ms end from g join n on n.project_id = g.project_id and n.track_index = g.track_index and n.k = g.k + 1)"""


@query("resolve_overlaps_pinned", f"with recursive {C}, p as (select *, clip_id % 4 = 0 as pinned from c), {PINNED} select project_id, clip_id, new_start from g")
def resolve_overlaps_pinned(spark, sf):
    return op.resolve_overlaps_pinned(fx.clips(spark, sf).withColumn("pinned", F.col("clip_id") % 4 == 0)).select("project_id", "clip_id", "new_start")


SYNC = """l as (select project_id, link_id, min({'t': track_index, 'c': clip_id, 's': start_ms, 'i': in_ms, 'o': out_ms, 'd': dur_ms}) as m from {src} where kind = 'video' and link_id is not null group by 1, 2),
 y as (select {src}.* replace (case when kind <> 'video' and m is not null then m.s else start_ms end as start_ms, case when kind <> 'video' and m is not null then m.i else in_ms end as in_ms,
   case when kind <> 'video' and m is not null then m.o else out_ms end as out_ms, case when kind <> 'video' and m is not null then m.d else dur_ms end as dur_ms) from {src} left join l using (project_id, link_id))"""


@query("sync_links", f"with {C}, {SYNC.replace('{src}', 'c')} select project_id, clip_id, start_ms, in_ms, out_ms, dur_ms from y")
def sync_links(spark, sf):
    return op.sync_links(fx.clips(spark, sf)).select("project_id", "clip_id", "start_ms", "in_ms", "out_ms", "dur_ms")


def _settle_sql(magnet):
    packed = "b" if magnet else "b + greatest(0, max(start_ms - b) over (partition by project_id, track_index order by start_ms, clip_id))"
    return f"""with recursive {C}, o as (select *, sum(dur_ms) over (partition by project_id, track_index order by start_ms, clip_id) - dur_ms as b from c),
 k0 as (select o.* exclude (b) replace ((case when track_index = 0 and not locked then {packed} else start_ms end)::bigint as start_ms) from o),
 {SYNC.replace('{src}', 'k0')},
 ld as (select distinct project_id, link_id from y where kind = 'video' and link_id is not null),
 p as (select y.*, ld.link_id is not null and kind <> 'video' as pinned from y left join ld on ld.project_id = y.project_id and ld.link_id = y.link_id where track_index <> 0 and not locked), {PINNED}
 select project_id, clip_id, start_ms from y where track_index = 0 or locked union all select project_id, clip_id, new_start from g"""


@query("settle_magnet", _settle_sql(True))
def settle_magnet(spark, sf):
    return op.settle(fx.clips(spark, sf), magnet=True).select("project_id", "clip_id", "start_ms")


@query("settle_free", _settle_sql(False))
def settle_free(spark, sf):
    return op.settle(fx.clips(spark, sf), magnet=False).select("project_id", "clip_id", "start_ms")


RIPPLE = "e as (select project_id, track_index, min(start_ms) + 20000 as from_ms, -350 as delta_ms, max(clip_id) as except_id from c group by 1, 2)"


@query("ripple", f"""with {C}, {RIPPLE} select project_id, clip_id, case when start_ms >= from_ms - 0.001 and clip_id <> except_id then greatest(0, start_ms + delta_ms) else start_ms end as new_start from c join e using (project_id, track_index)""")
def ripple(spark, sf):
    c = fx.clips(spark, sf)
    edits = c.groupBy("project_id", "track_index").agg((F.min("start_ms") + 20000).alias("from_ms"), F.lit(-350).alias("delta_ms"), F.max("clip_id").alias("except_id"))
    return op.ripple(c, edits).select("project_id", "clip_id", "new_start")


AUD = f"""{C}, u as (select * from c where asset_id <> 4 and not track_muted and not muted and dur_ms > 0 and kind in ('video', 'audio')),
 a as (select * from u where kind = 'audio' or not exists (select 1 from c m where m.kind = 'audio' and m.project_id = u.project_id and m.asset_id = u.asset_id and abs(m.start_ms - u.start_ms) < 1))"""


def _sound(spark):
    return spark.createDataFrame([(i, i != 4) for i in range(7)], "asset_id bigint, has_sound boolean")


@query("audible_clips", f"with {AUD} select project_id, clip_id, kind from a")
def audible_clips(spark, sf):
    return op.audible_clips(fx.clips(spark, sf), _sound(spark)).select("project_id", "clip_id", "kind")


@query("audio_schedule", f"""with {AUD}, s as (select *, greatest(0, ceil((greatest(start_ms, 380000) - 380000) * 48))::bigint as i0, least(ceil((least(start_ms + dur_ms, 420000) - 380000) * 48)::bigint, 40000 * 48) as i1 from a
   where least(start_ms + dur_ms, 420000) > greatest(start_ms, 380000))
 select project_id, clip_id, i0, i1, greatest(in_ms + least(greatest(380000 + i0 / 48.0 - start_ms, 0), dur_ms) - 20, in_ms)::double as w0, least(in_ms + least(greatest(380000 + i1 / 48.0 - start_ms, 0), dur_ms) + 20, out_ms)::double as w1 from s""")
def audio_schedule(spark, sf):
    a = op.audible_clips(fx.clips(spark, sf), _sound(spark))
    return op.audio_schedule(a, 380000.0, 420000.0).select("project_id", "clip_id", "i0", "i1", "w0", "w1")


@query("sound_events", f"with {Wd} select project_id, clip_id, (start_ms - 380000) * 48 as at, round(power(10, -0.3) * least(1, greatest(0, intensity)), 7) as gain from w where effect = 'cameraSnap' and not track_muted and start_ms + 120 > 380000 and start_ms < 420000")
def sound_events(spark, sf):
    return op.sound_events(fx.wide_clips(spark, sf), 380000.0, 420000.0).withColumn("gain", F.round("gain", 7))


@query("mirror_of", f"""with {C}, v as (select * from c where kind in ('video', 'audio')),
 m as (select a.project_id, a.clip_id, min({{'t': b.track_index, 'c': b.clip_id}}).c as mirror_id from v a join v b on a.project_id = b.project_id and a.kind <> b.kind and a.asset_id = b.asset_id
   and ((a.link_id is not null and a.link_id = b.link_id) or (a.link_id is null and b.link_id is null and abs(a.start_ms - b.start_ms) < 1)) group by 1, 2)
 select v.project_id, v.clip_id, mirror_id from v left join m using (project_id, clip_id)""")
def mirror_of(spark, sf):
    return op.mirror_of(fx.clips(spark, sf)).select("project_id", "clip_id", "mirror_id")


LOOSE = "q as (select project_id, clip_id, kind, track_index, asset_id, start_ms // 4000 * 4000 as start_ms, clip_id % 3 * 100 as in_ms, clip_id % 3 * 100 + 900 as out_ms from c)"


@query("infer_links", f"""with {C}, {LOOSE}, v as (select *, row_number() over (partition by project_id, asset_id, start_ms, in_ms order by track_index, clip_id) as k from q where kind = 'video'),
 a as (select *, row_number() over (partition by project_id, asset_id, start_ms, in_ms order by track_index, clip_id) as k from q where kind = 'audio')
 select v.project_id, v.clip_id as video_id, a.clip_id as audio_id from v join a using (project_id, asset_id, start_ms, in_ms, k)""")
def infer_links(spark, sf):
    c = fx.clips(spark, sf)
    t = F.col("clip_id") % 3 * 100
    loose = c.withColumn("link_id", F.lit(None).cast("bigint")).withColumn("start_ms", F.floor(F.col("start_ms") / 4000) * 4000).withColumn("in_ms", t).withColumn("out_ms", t + 900)
    return op.infer_links(loose)


CHOSEN = "h as (select project_id, clip_id from c where clip_id % 13 = 0)"


@query("with_partners", f"""with {C}, {CHOSEN}, o as (select c.* from c join h using (project_id, clip_id) where not locked)
 select project_id, clip_id from o union select c.project_id, c.clip_id from c join (select distinct project_id, link_id from o where link_id is not null) l using (project_id, link_id) where not locked""")
def with_partners(spark, sf):
    c = fx.clips(spark, sf)
    return op.with_partners(c, c.filter(F.col("clip_id") % 13 == 0).select("project_id", "clip_id"), unlocked_only=True)


@query("link_groups", f"with {C} select project_id, link_id, count(*) as members, min({{'t': track_index, 'c': clip_id}}).c as first_id, max({{'t': track_index, 'c': clip_id}}).c as last_id from c where link_id is not null group by 1, 2")
def link_groups(spark, sf):
    return op.link_groups(fx.clips(spark, sf))


A = f"a as (select *, lower(replace(path, chr(92), '/')) as path_key, kind <> 'image' as has_sound, asset_id % 5 = 0 as has_stems from ({fx.ASSETS_SQL}))"


def _assets(spark, sf):
    return fx.assets(spark, sf).withColumn("path_key", F.lower("path")).withColumn("has_sound", F.col("kind") != "image").withColumn("has_stems", F.col("asset_id") % 5 == 0)


@query("assets_needing_stems", f"with {A}, u as (select distinct o_orderkey % 3000 as asset_id from orders) select regexp_replace(path_key, '_[0-9]+', '') as path_key, min(asset_id) as asset_id from a join u using (asset_id) where has_sound and not has_stems group by 1")
def assets_needing_stems(spark, sf):
    uses = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 3000).alias("asset_id"))
    shared = _assets(spark, sf).withColumn("path_key", F.regexp_replace("path_key", "_[0-9]+", ""))
    return op.assets_needing_stems(uses, shared)


@query("with_stems", f"with {A} select asset_id, case when asset_id % 3 = 0 then 'v/' || asset_id else 'old' end as vocals, case when asset_id % 3 = 0 then 'b/' || asset_id end as background from a")
def with_stems(spark, sf):
    a = _assets(spark, sf).withColumn("vocals", F.lit("old")).withColumn("background", F.lit(None).cast("string"))
    sid = F.col("asset_id").cast("string")
    stems = _assets(spark, sf).filter(F.col("asset_id") % 3 == 0).select("path_key", F.concat(F.lit("v/"), sid).alias("vocals"), F.concat(F.lit("b/"), sid).alias("background"))
    return op.with_stems(a, stems).select("asset_id", "vocals", "background")


@query("merge_assets", f"""with {A}, c as (select path_key, asset_id, duration_ms, asset_id % 10 as ord, 'old' as tags from a where asset_id % 3 <> 0), i as (select path_key, asset_id + 100000 as asset_id, duration_ms + 1 as duration_ms,
   case when asset_id % 4 = 0 then asset_id % 7 end as ord, case when asset_id % 5 = 0 then 'new' end as tags from a where asset_id % 2 = 0)
 select coalesce(i.path_key, c.path_key) as path_key, coalesce(i.asset_id, c.asset_id) as asset_id, coalesce(i.duration_ms, c.duration_ms) as duration_ms, coalesce(i.ord, c.ord) as "order", coalesce(i.tags, c.tags) as tags from c full join i on c.path_key = i.path_key""")
def merge_assets(spark, sf):
    a = _assets(spark, sf)
    i = F.col("asset_id")
    cur = a.filter(i % 3 != 0).select("path_key", "asset_id", "duration_ms", (i % 10).alias("order"), F.lit("old").alias("tags"))
    inc = a.filter(i % 2 == 0).select("path_key", (i + 100000).alias("asset_id"), (F.col("duration_ms") + 1).alias("duration_ms"), F.when(i % 4 == 0, i % 7).alias("order"), F.when(i % 5 == 0, "new").alias("tags"))
    return op.merge_assets(cur, inc)


@query("asset_usage", f"with {A} select a.asset_id, coalesce(n, 0) as uses from a left join (select o_orderkey % 3000 as asset_id, count(*) as n from orders group by 1) u using (asset_id)")
def asset_usage(spark, sf):
    return op.asset_usage(fx.assets(spark, sf), fx.table(spark, sf, "orders").select((F.col("o_orderkey") % 3000).alias("asset_id")))


@query("resolve_assets", f"with {A} select o_orderkey as clip_id, name, a.asset_id is null as unknown from orders left join a on a.asset_id = o_orderkey % 3000")
def resolve_assets(spark, sf):
    c = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_orderkey") % 3000).alias("asset_id"))
    known, unknown = op.resolve_assets(c, fx.assets(spark, sf).select("asset_id", "name"))
    return known.select("clip_id", "name", F.lit(False).alias("unknown")).unionByName(unknown.select("clip_id", F.lit(None).cast("string").alias("name"), F.lit(True).alias("unknown")))


@query("media_paths", f"with {A} select path from a union select 'stems/' || brand || '.wav' from a where has_stems")
def media_paths(spark, sf):
    a = _assets(spark, sf).withColumn("vocals", F.when(F.col("has_stems"), F.concat(F.lit("stems/"), "brand", F.lit(".wav")))).withColumn("background", F.lit(""))
    return op.media_paths(a)


@query("guard_output", f"with {A} select o.path, 'source' as what from (select distinct 'C:/Clips/red_widget_' || o_orderkey || '.MP4' as path from orders) o where lower(o.path) in (select path_key from a)")
def guard_output(spark, sf):
    from mediaframe.operators.projects import guard_output as guard

    outs = fx.table(spark, sf, "orders").select(F.concat(F.lit("C:\\Clips\\red_widget_"), F.col("o_orderkey").cast("string"), F.lit(".MP4")).alias("path")).distinct()
    return guard(outs, fx.assets(spark, sf).select("path", F.lit("source").alias("what"))).select(F.regexp_replace("path", r"\\", "/").alias("path"), "what")


@query("changed_rows", f"""with {C}, b as (select clip_id, start_ms, link_id from c where clip_id % 10 <> 1), a as (select clip_id, case when clip_id % 7 = 0 then start_ms + 5 else start_ms end as start_ms, case when clip_id % 9 = 0 then null else link_id end as link_id from c where clip_id % 10 <> 2)
 select clip_id, change from (select coalesce(a.clip_id, b.clip_id) as clip_id, case when b.clip_id is null then 'added' when a.clip_id is null then 'removed' when a.start_ms is distinct from b.start_ms or a.link_id is distinct from b.link_id then 'changed' end as change
  from a full join b on a.clip_id = b.clip_id) where change is not null""")
def changed_rows(spark, sf):
    c = fx.clips(spark, sf).select("clip_id", "start_ms", "link_id")
    i = F.col("clip_id")
    after = c.filter(i % 10 != 2).withColumn("start_ms", F.when(i % 7 == 0, F.col("start_ms") + 5).otherwise(F.col("start_ms"))).withColumn("link_id", F.when(i % 9 != 0, F.col("link_id")))
    return op.changed_rows(c.filter(i % 10 != 1), after, ["clip_id"])


@query("locate_findings", f"""with {C}, fi as (select clip_id as finding_id, project_id, asset_id, in_ms + 700 as source_ms from c where kind = 'fx'),
 m as (select finding_id, min({{'k': track_index, 's': start_ms, 'c': c.clip_id, 't': start_ms + source_ms - in_ms}}) as m from fi join c on c.project_id = fi.project_id and c.asset_id = fi.asset_id and source_ms between in_ms and out_ms where kind = 'video' group by 1)
 select finding_id, m.c as clip_id, m.t as timeline_ms from m""")
def locate_findings(spark, sf):
    c = fx.clips(spark, sf)
    f = c.filter(F.col("kind") == "fx").select(F.col("clip_id").alias("finding_id"), "project_id", "asset_id", (F.col("in_ms") + 700).alias("source_ms"))
    return op.locate_findings(f, c)


TOTAL = "((out_ms - in_ms) * factor + coalesce(freeze_hold, 0))"


def map_sql(local):
    t = f"least(greatest({local}, 0.0), {TOTAL})"
    play = f"(case when freeze_at is null or {t} <= freeze_at then {t} when {t} < freeze_at + freeze_hold then freeze_at else {t} - freeze_hold end)"
    off = f"(case when reversed then out_ms - in_ms - {play} / factor else {play} / factor end)"
    frozen = f"coalesce({t} >= freeze_at and {t} < freeze_at + freeze_hold, false)"
    return t, f"in_ms + least(greatest({off}, 0.0), out_ms - in_ms)", f"case when {frozen} then 0.0 else 1.0 / factor end", frozen


FADE = "(case when fade_in_ms is not null then greatest(0, least(1, {t} / least({d} / 2, fade_in_ms))) else 1.0 end * case when fade_out_ms is not null then greatest(0, least(1, ({d} - {t}) / least({d} / 2, fade_out_ms))) else 1.0 end)"


def _plan_sql():
    t, src, rate, frozen = map_sql("video_ms - start_ms")
    return f"""with w0 as ({fx.WIDE_SQL}), v as (select * replace ({TOTAL} as dur_ms) from w0 where kind = 'video' and not track_muted), s as (select project_id, start_ms, dur_ms from w0 where effect = 'cameraSnap' and not track_muted),
 fr as (select distinct project_id, unnest(range(ceil(start_ms * 2 / 1000.0 - 1e-6)::bigint, ceil((start_ms + dur_ms) * 2 / 1000.0 - 1e-6)::bigint)) as frame from (select project_id, start_ms, dur_ms from v union all select * from s)),
 vt as (select fr.project_id, frame, coalesce(min(s.start_ms), frame * 500.0)::double as video_ms from fr left join s on s.project_id = fr.project_id and frame * 500.0 >= start_ms and frame * 500.0 < start_ms + dur_ms group by 1, 2),
 pl as (select vt.project_id, frame, track_index, clip_id, asset_id, video_ms, {t} as local_ms, {src} as source_ms, {rate} as rate, {frozen} as frozen, dur_ms, fade_in_ms, fade_out_ms
   from vt join v on v.project_id = vt.project_id and video_ms >= start_ms and video_ms < start_ms + dur_ms)
"""


def _plan_clips(spark, sf):
    w = fx.wide_clips(spark, sf)
    total = pb.clip_duration(F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_hold"))
    return w.withColumn("dur_ms", F.when(F.col("kind") == "video", total).otherwise(F.col("dur_ms")))


def _plan(spark, sf):
    return op.frame_plan(_plan_clips(spark, sf), 2.0, _snaps(fx.wide_clips(spark, sf)))


@query("frame_plan", _plan_sql() + f"select project_id, frame, track_index, clip_id, video_ms, round(local_ms, 4) as local_ms, round(source_ms, 4) as source_ms, round(rate, 4)::double as rate, frozen, round({FADE.format(t='local_ms', d='dur_ms')}, 6)::double as fade from pl")
def frame_plan(spark, sf):
    r = lambda c, n: F.round(c, n).alias(c)
    return _plan(spark, sf).select("project_id", "frame", "track_index", "clip_id", "video_ms", r("local_ms", 4), r("source_ms", 4), r("rate", 4), "frozen", r("fade", 6))


@query("min_rate", _plan_sql() + "select project_id, clip_id, coalesce(min(case when not frozen and rate > 0 then rate end), 1.0)::double as min_rate from pl group by 1, 2")
def min_rate(spark, sf):
    return op.min_rate(_plan(spark, sf))


def _time_map_sql():
    t, src, rate, frozen = map_sql("local")
    te, se, re_, fe = map_sql("edge")
    return f"""with w as ({fx.WIDE_SQL}), q as (select *, unnest([-300.0, 250.0, dur_ms * 0.7, {TOTAL} + 200.0]) as local from w where kind = 'video'),
 x as (select *, case when local < 0 then 0.0 else {TOTAL} end as edge, coalesce(freeze_at + freeze_hold >= {TOTAL} and local > 0, false) and {TOTAL} - 1e-6 >= freeze_at as held from q)
 select clip_id, round(local, 3)::double as local, round(case when local between 0 and {TOTAL} then {src} else least(greatest({se} + case when reversed then -1 else 1 end * (local - edge) * case when held then 0 else 1 / factor end, 0), 9000) end, 4)::double as source_ms,
  round(case when local between 0 and {TOTAL} then {rate} else case when held then 0 else 1 / factor end end, 4)::double as rate from x"""


@query("time_map_extended", _time_map_sql())
def time_map_extended(spark, sf):
    w = fx.wide_clips(spark, sf).filter(F.col("kind") == "video")
    total = pb.clip_duration(F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_hold"))
    q = w.withColumn("local", F.explode(F.array(F.lit(-300.0), F.lit(250.0), F.col("dur_ms") * 0.7, total + 200.0)))
    m = pb.source_extended(F.col("local"), F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_at"), F.col("freeze_hold"), F.col("reversed"), F.lit(9000.0))
    return q.select("clip_id", F.round("local", 3).alias("local"), F.round(m["source_ms"], 4).alias("source_ms"), F.round(m["rate"], 4).alias("rate"))


@query("audio_fades", f"""with w as ({fx.WIDE_SQL}), q as (select *, dur_ms * 0.04 as t from w)
 select clip_id, round(power(10.0, (clip_id % 20 - 10) / 20.0), 7) as lin, round(20 * log10(intensity + 0.1), 7) + 0.0 as db, round(case when muted then 0 else power(10.0, (clip_id % 20 - 10) / 20.0) *
  case when fade_in_ms is not null then sin(pi() / 2 * least(1, t / least(dur_ms / 2, fade_in_ms))) else 1 end * case when fade_out_ms is not null then sin(pi() / 2 * least(1, (dur_ms - t) / least(dur_ms / 2, fade_out_ms))) else 1 end end, 7)::double as gain,
  round({FADE.format(t='t', d='dur_ms')}, 7)::double as fade from q""")
def audio_fades(spark, sf):
    w = fx.wide_clips(spark, sf)
    t, d = F.col("dur_ms") * 0.04, F.col("dur_ms")
    gain_db = (F.col("clip_id") % 20 - 10).cast("double")
    g = pb.clip_gain(F.col("muted"), gain_db, F.lit(None).cast("double"), t, d, F.col("fade_in_ms"), F.col("fade_out_ms"))
    return w.select("clip_id", F.round(pb.db_to_lin(gain_db), 7).alias("lin"), F.round(pb.lin_to_db(F.col("intensity") + 0.1), 7).alias("db"), F.round(g, 7).alias("gain"),
                    F.round(pb.video_fade(t, d, F.col("fade_in_ms"), F.col("fade_out_ms")), 7).alias("fade"))


NOISE = """m as (select *, (x * 747796405 + 2891336453) % 4294967296 as s from b), w1 as (select *, ((xor(s >> ((s >> 28) + 4), s)) * 277803737::hugeint % 4294967296)::bigint as wd from m)"""


@query("pcg_noise", f"with b as (select event_id, event_id::hugeint as x from events), s0 as (select event_id, ((x * 747796405 + 2891336453) % 4294967296)::bigint as s from b), s1 as (select event_id, ((xor(s >> ((s >> 28) + 4), s))::hugeint * 277803737 % 4294967296)::bigint as w from s0) select event_id, xor(w >> 22, w) as hash, round(xor(w >> 22, w) / 4294967295.0, 9) as unit from s1")
def pcg_noise(spark, sf):
    from mediaframe.functions.noise import pcg

    e = fx.table(spark, sf, "events").select("event_id")
    return e.select("event_id", pcg(F.col("event_id")).alias("hash"), F.round(pcg(F.col("event_id")) / 4294967295.0, 9).alias("unit"))


U = "(case when dur_ms > 0 then least(1, greatest(0, t / dur_ms)) else 1.0 end)"


@query("effect_frames", f"""with w as ({fx.WIDE_SQL}), q as (select *, dur_ms * 0.3 as t from w where kind = 'fx'),
 s as (select *, least(1.0, greatest(0.0, intensity)) * case when effect = 'shake' then greatest(0, least(1, t / 120, (dur_ms - t) / 120)) else 1 end as s, {U} as u from q)
 select clip_id, effect, round(s, 7)::double as strength, round(case effect when 'fadeToBlack' then s * u when 'zoomPunch' then 1 + 0.15 * s * (case when u < 0.35 then 1 + 2.70158 * power(u / 0.35 - 1, 3) + 1.70158 * power(u / 0.35 - 1, 2)
   else 1 - (case when (u - 0.35) / 0.65 < 0.5 then 4 * power((u - 0.35) / 0.65, 3) else 1 - power(-2 * (u - 0.35) / 0.65 + 2, 3) / 2 end) end)
   when 'shake' then 1 + 2 * 0.01 * s when 'cameraSnap' then s * greatest(0, 1 - t / 250) end, 7)::double as amount, round(s * (1 - power(1 - least(1, t / 350), 3)), 7)::double as settled from s""")
def effect_frames(spark, sf):
    w = fx.wide_clips(spark, sf).filter(F.col("kind") == "fx")
    t, d = F.col("dur_ms") * 0.3, F.col("dur_ms").cast("double")
    s = pb.effect_strength(F.col("effect"), F.col("intensity"), t, d)
    return w.select("clip_id", "effect", F.round(s, 7).alias("strength"), F.round(pb.effect_amount(F.col("effect"), s, t, d), 7).alias("amount"), F.round(pb.snap_progress(s, t), 7).alias("settled"))


@query("analysis_summary", f"""with s as (select user_id as project_id, count(*) as shots from events where event_type = 'signup' group by 1), d as (select user_id as project_id, count(*) as duplicates from events where event_type = 'error' group by 1),
 t as (select user_id as project_id, count(*) filter (value < 20) as dissolves from events where event_type = 'click' group by 1), u as (select user_id as project_id, avg(-value) as mean_lufs from events where event_type = 'view' group by 1),
 a as (select user_id as project_id, sum(cast(floor(value) as bigint))::bigint as media_ms from events group by 1)
 select project_id, media_ms, coalesce(shots, 0) as shots, coalesce(duplicates, 0) as duplicates, coalesce(dissolves, 0) as dissolves, round(mean_lufs, 6) as mean_lufs from a left join s using (project_id) left join d using (project_id) left join t using (project_id) left join u using (project_id)""")
def analysis_summary(spark, sf):
    e = fx.events(spark, sf).withColumnRenamed("asset_id", "project_id")
    pick = lambda n: e.filter(F.col("label") == n)
    tr = pick("click").select("project_id", F.when(F.col("value") < 20, "dissolve").otherwise("cut").alias("suggestion"))
    out = op.analysis_summary(pick("signup"), pick("error"), tr, pick("view").select("project_id", (-F.col("value")).alias("lufs")), e.select("project_id", F.floor("value").alias("duration_ms")))
    return out.withColumn("mean_lufs", F.round("mean_lufs", 6))
