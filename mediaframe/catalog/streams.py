"""Streams over the shared tables (read as files, processed to the end), model hooks and the result cache."""

import numpy as np
from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe import udf
from mediaframe.catalog import query
from mediaframe.catalog.identity import SIMS
from mediaframe.operators import tracking
from mediaframe.operators.shots import sliding_windows
from mediaframe.sources import documents as docs
from mediaframe.streaming import streams as st


def _stream(spark, sf, name):
    # a table is one file or a folder of part files: a stream takes both by a pattern, which fits this name alone
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _events(spark, sf):
    return _stream(spark, sf, "events").select("event_id", F.col("user_id").alias("asset_id"), F.col("ts").cast("timestamp").alias("ts"), fx.micros("ts").alias("pts_us"), "event_type", "value")


@query("progress_stream", "select conv_id as job_id, max(least(1.0, length(text) / 2000.0))::double as pct, arg_max(role, turn) as stage, max(turn) as seq from conversations group by 1")
def progress_stream(spark, sf):
    c = _stream(spark, sf, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), F.concat(
        F.lit('{"event":"progress","stage":"'), "role", F.lit('","pct":'), (F.length("text") / 2000.0).cast("string"), F.lit("}")).alias("value"))
    return st.drain(st.progress_stream(st.parse_event_lines(c)), "complete")


@query("asset_status_stream", "select user_id as asset_id, arg_max(event_type, event_id) as status, max(event_id) as seq from events group by 1")
def asset_status_stream(spark, sf):
    e = _events(spark, sf).select("asset_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return st.drain(st.asset_status_stream(e), "complete")


@query("waveform_stream", "select user_id as asset_id, epoch_us(ts) // 21600000000 * 21600000000 as bucket_us, round(max(abs(value - 50)), 6) as peak from events group by 1, 2")
def waveform_stream(spark, sf):
    s = st.drain(st.waveform_stream(_events(spark, sf).withColumn("value", F.col("value") - 50), "6 hours"), "complete")
    return s.select("asset_id", F.unix_micros("bucket_start").alias("bucket_us"), F.round("peak", 6).alias("peak"))


@query("score_windows_stream", """with w as (select user_id as asset_id, value, unnest([epoch_us(ts) // 21600000000 * 21600000000, epoch_us(ts) // 21600000000 * 21600000000 - 21600000000]) as start_us from events)
 select asset_id, start_us, count(*) as frames, max(least(1.0, value / 100.0)) as score from w group by 1, 2""")
def score_windows_stream(spark, sf):
    e = _events(spark, sf).withColumn("score", F.least(F.lit(1.0), F.col("value") / 100.0))
    return st.drain(st.score_windows_stream(e, "12 hours", "6 hours"), "complete").select("asset_id", F.unix_micros("window_start").alias("start_us"), "frames", "score")


@query("visibility_sessions_stream", """with l as (select user_id as asset_id, epoch_us(ts) as t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) >= 14400000000, true) as opens from events),
 r as (select *, count(*) filter (opens) over (partition by asset_id order by t) as s from l) select asset_id, min(t) as start_us, max(t) + 14400000000 as end_us, count(*) as frames from r group by asset_id, s""")
def visibility_sessions_stream(spark, sf):
    s = st.drain(st.visibility_sessions_stream(_events(spark, sf), "4 hours"), "complete")
    return s.select("asset_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "frames")


@query("ordered_frames_stream", "select user_id as asset_id, epoch_us(ts) as pts_us, value from events")
def ordered_frames_stream(spark, sf):
    return st.drain(st.ordered_frames_stream(_events(spark, sf), ts="ts"))


@query("byte_track_stream")
def byte_track_stream(spark, sf):
    li = _stream(spark, sf, "lineitem")
    x, y = (F.col("l_partkey") * 37 % 1000).cast("double"), (F.col("l_suppkey") * 91 % 500).cast("double")
    d = li.select(F.floor(F.col("l_orderkey") / 1000).alias("asset_id"), F.floor(F.col("l_orderkey") / 100).alias("shot"), F.col("l_orderkey").alias("frame"), F.xxhash64("l_partkey", "l_suppkey", "l_linenumber").alias("det"), F.col("l_returnflag").alias("label"),
                  F.round(F.col("l_discount") * 8 + 0.2, 2).alias("score"), x.alias("x1"), y.alias("y1"), F.least(F.lit(1280.0), x + 40 + F.col("l_quantity") * 8).alias("x2"), F.least(F.lit(720.0), y + 60 + F.col("l_quantity") * 6).alias("y2"))
    # the orders tell which shots there are; the last order of each ends it
    last = fx.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("_shot")).agg(F.max("o_orderkey").alias("o_orderkey"))
    o, none = _stream(spark, sf, "orders").join(last, "o_orderkey", "left_semi"), F.lit(None).cast("double")
    ends = o.select(F.floor(F.col("o_orderkey") / 1000).alias("asset_id"), F.floor(F.col("o_orderkey") / 100).alias("shot"), F.col("o_orderkey").alias("frame"), F.lit(None).cast("bigint").alias("det"),
                    F.lit(None).cast("string").alias("label"), *[none.alias(c) for c in ("score", "x1", "y1", "x2", "y2")])
    d = d.withColumn("score", F.col("score").cast("double")).unionByName(ends)
    return st.drain(st.byte_track_stream(d, tracking.TrackerOptions(high=0.4, low=0.2, birth=0.4, same_label=False)))


@query("resample_stream", """with b as (select user_id as asset_id, min(epoch_us(ts)) as s, max(epoch_us(ts)) as m from events group by 1), g as (select *, unnest(range(0, (m - 500 - s) // 3600000000 + 1)) as k from b), t as (select *, s + k * 3600000000 as t, s + k * 3600000000 + 500 as p from g where m > s),
 e as (select user_id as asset_id, epoch_us(ts) as u from events), j as (select t.asset_id, k, t, a.u as a_us, z.u as z from t asof join e a on a.asset_id = t.asset_id and t.p > a.u asof join e z on z.asset_id = t.asset_id and t.p <= z.u)
 select asset_id, k, case when abs(t - a_us) <= 500 then 'copy' else 'interp' end as kind, a_us, case when abs(t - a_us) > 500 then z end as b_us, round(case when abs(t - a_us) <= 500 then 0 else (t - a_us) / (z - a_us) end, 7)::double as alpha from j""")
def resample_stream(spark, sf):
    return st.drain(st.resample_stream(_events(spark, sf), 3_600_000_000, ts="ts")).withColumn("alpha", F.round("alpha", 7))


@query("enrich_stream", "select event_id, c_name as name from events left join customer on c_custkey = user_id")
def enrich_stream(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"))
    return st.drain(st.enrich_stream(_events(spark, sf), c, "asset_id").select("event_id", "name"))


@query("identify_stream", SIMS + """select vec_id, best, round(score, 7) + 0.0 as score, round(margin, 7) + 0.0 as margin,
  case when score >= 0.4 and margin >= 0.05 then best end as owner from idd""")
def identify_stream(spark, sf):
    probes = _stream(spark, sf, "embeddings").filter(F.col("vec_id") % 5 != 0).select("vec_id", "embedding")
    out = st.identify_stream(probes, lambda: fx.bank(spark, sf), 0.4, 0.05)
    return out.select("vec_id", "best", F.round("score", 7).alias("score"), F.round("margin", 7).alias("margin"), "owner")


@query("with_detector", f"with f as ({fx.FRAMES_SQL}), d as (select asset_id, frame, value, unnest(range(1, 1 + floor(value / 40)::bigint)) as det from f) select asset_id, frame, det, round(0.2 + 0.15 * det, 4)::double as score, 0.2 + 0.15 * det >= 0.45 as used from d where 0.2 + 0.15 * det >= 0.3")
def with_detector(spark, sf):
    stub = lambda b: [[("box", 0.2 + 0.15 * (i + 1), 0.0, 0.0, 10.0 * i, 10.0) for i in range(int(v // 40))] for v in b["value"]]
    out = udf.with_detector(fx.frames(spark, sf).select("asset_id", "frame", "value"), stub, 0.45, 0.3)
    return out.select("asset_id", "frame", "det", F.round("score", 4).alias("score"), "used")


@query("with_embedder", "select event_id, round(value / sqrt(value * value + 1), 3) as first from events")
def with_embedder(spark, sf):
    fn = udf.embedder(lambda s: np.stack([s.to_numpy(dtype=float), np.ones(len(s))], axis=1))
    return fx.table(spark, sf, "events").select("event_id", F.round(F.get(fn(F.col("value")), 0).cast("double"), 3).alias("first"))


@query("with_frame_scores", f"select asset_id, frame, score from ({fx.FRAMES_SQL})")
def with_frame_scores(spark, sf):
    f = fx.frames(spark, sf).select("asset_id", "frame", F.col("score").alias("v"))
    windows = sliding_windows(f).join(f, ["asset_id", "frame"])
    return udf.with_frame_scores(windows, lambda v: v, "v")


@query("cascade", f"""with d as ({fx.DETECTIONS_SQL}), c as (select shot_id, frame_id, det, case when score > 0.9 then label end as character from d where score > 0.7), e as (select shot_id from d group by 1 having count(*) filter (score > 0.9) > 100),
 s as (select shot_id, frame_id, det, case when score > 0.95 then label end as character from d where shot_id in (select shot_id from e) and score > 0.8)
 select *, 'cheap' as stage from c where shot_id not in (select shot_id from s) union all select *, 'strong' from s union all select c.*, 'strong' from c where shot_id in (select shot_id from s) and character is not null and not exists (select 1 from s where s.shot_id = c.shot_id and s.character = c.character)""")
def cascade(spark, sf):
    d = fx.detections(spark, sf)
    pick = lambda low, named: lambda s: s.filter(F.col("score") > low).select("shot_id", "frame_id", "det", F.when(F.col("score") > named, F.col("label")).alias("character"))
    stats = lambda s, found: s.groupBy("shot_id").agg(F.when(F.count_if(F.col("score") > 0.9) > 100, "crowded").alias("reason"))
    return udf.cascade(d, pick(0.7, 0.9), pick(0.8, 0.95), stats)


@query("incremental", "select p_partkey as id, p_partkey % 3 = 0 and p_partkey % 7 <> 0 as hit from part")
def incremental(spark, sf):
    i = F.col("p_partkey")
    now = fx.table(spark, sf, "part").select(i.alias("id"), F.col("p_name").alias("path"), i.alias("size"), F.col("p_size").alias("mtime"))
    old = now.filter(F.col("id") % 3 == 0).withColumn("mtime", F.when(F.col("id") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    key = lambda df: docs.fingerprints(df, "default", "1")
    hits, misses = docs.incremental(key(now), key(old))
    return hits.select("id", F.lit(True).alias("hit")).unionByName(misses.select("id", F.lit(False).alias("hit")))


@query("normalize_probe", """select p_partkey as id, case when p_size % 5 = 0 then 'image' when p_size % 5 = 1 then 'audio' else 'video' end as kind, case when p_size % 5 = 1 then 0 when p_size % 5 = 3 then 720 else 1280 end as width,
 case when p_size % 5 in (0, 1) then 0.0 else 29.97 end::double as fps, round(p_retailprice * 10, 3) as ms from part""")
def normalize_probe(spark, sf):
    k = F.col("p_size") % 5
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"'), F.when(k == 0, "png").otherwise("h264"), F.lit('","width":1280,"height":720,"avg_frame_rate":"'), F.when(k == 4, "0/0").otherwise("30000/1001"),
                     F.lit('","r_frame_rate":"30000/1001","disposition":{"attached_pic":'), F.when(k == 1, "1").otherwise("0"), F.lit('}'), F.when(k == 3, ',"side_data_list":[{"rotation":-90}]').otherwise(""), F.lit("}"))
    doc = F.concat(F.lit('{"streams":['), video, F.lit(',{"codec_type":"audio","codec_name":"aac"}],"format":{"duration":"'), (F.col("p_retailprice") / 100).cast("string"), F.lit('"}}'))
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), doc.alias("probe"))
    return docs.normalize_probe(p).select(F.col("path").cast("bigint").alias("id"), "kind", "width", F.round("fps", 3).cast("decimal(5,2)").cast("double").alias("fps"), F.round("durationMs", 3).alias("ms"))
