"""Audio queries over ``events`` (one sample per event) and ``documents`` (meter logs)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import playback as pb
from mediaframe.operators import audio as op
from mediaframe.operators import timeline as tl

PCM = f"p as (select asset_id, frame as i, value - 50.0 as value from ({fx.FRAMES_SQL}))"


def _pcm(spark, sf):
    return fx.frames(spark, sf).select("asset_id", F.col("frame").alias("i"), (F.col("value") - 50.0).alias("value"))


@query("waveform", f"with {PCM}, b as (select asset_id, i // 8 as bucket, max(abs(value)) as peak from p group by 1, 2) select asset_id, bucket, round(least(1.0, peak / max(peak) over (partition by asset_id)), 7) as peak from b")
def waveform(spark, sf):
    return op.waveform(_pcm(spark, sf), 8).withColumn("peak", F.round("peak", 7))


@query("classify_beats", f"with b as ({fx.BEATS_SQL}), q as (select asset_id, quantile_cont(strength, 0.6) as thr from b group by 1) select b.asset_id, event_id, case when strength >= thr - 1e-12 and strength > 0 then 'beat1' else 'beat2' end as kind from b join q using (asset_id)")
def classify_beats(spark, sf):
    return op.classify_beats(fx.beats(spark, sf)).select("asset_id", "event_id", "kind")


@query("recommended_gain", "select event_id, round(case when -value > -70 then least(greatest(case when props like '%7%' then least(-14.0 + value, -1.0 - (value / 50.0 - 2.0)) else -14.0 + value end, -12), 12) end, 6)::double as gain from events")
def recommended_gain(spark, sf):
    e = fx.table(spark, sf, "events")
    peak = F.when(F.col("props").contains("7"), F.col("value") / 50.0 - 2.0)
    return e.select("event_id", F.round(op.recommended_gain(-F.col("value"), peak), 6).alias("gain"))


@query("parse_loudness_log", """with l as (select event_id, case event_id % 4 when 3 then null else -value end as i, event_id % 4 as k from events)
 select event_id, case when k = 3 then null when i > -70 then round(i, 2) end as lufs, case when k <> 3 and i > -70 then case when k = 1 then -99.0 else -1.5 end end::double as true_peak, case when k <> 3 and i > -70 then case when k = 2 then 4.25 else 6.5 end end::double as range from (select event_id, k, round(i, 2) as i from l)""")
def parse_loudness_log(spark, sf):
    i = F.format_string("%.2f", -F.col("value"))
    meter = F.concat(F.lit("frame I: -99.0 LUFS\nSummary:\n  Integrated loudness:\n    I:  "), i, F.lit(" LUFS\n  Loudness range:\n    LRA:  6.5 LU\n  True peak:\n    Peak:  "), F.when(F.col("event_id") % 4 == 1, "-inf").otherwise("-1.5"), F.lit(" dBFS\n"))
    norm = F.concat(F.lit('[norm] {"input_i" : "'), i, F.lit('", "input_tp" : "-1.5", "input_lra" : "4.25"}\n'))
    text = F.when(F.col("event_id") % 4 == 2, norm).when(F.col("event_id") % 4 == 3, "no audio stream").otherwise(meter)
    p = op.parse_loudness_log(text)
    return fx.table(spark, sf, "events").select("event_id", p["lufs"].alias("lufs"), p["true_peak"].alias("true_peak"), p["range"].alias("range"))


@query("autocorrelation", f"with {PCM}, l as (select unnest(range(0, 13)) as lag) select a.asset_id, lag, round(sum(a.value * b.value), 4) + 0.0 as ac from p a cross join l join p b on b.asset_id = a.asset_id and b.i = a.i + lag group by 1, 2")
def autocorrelation(spark, sf):
    s = _pcm(spark, sf).select("asset_id", F.col("i").alias("frame"), "value")
    return op.autocorrelation(s, "value", 12).select("asset_id", "lag", F.round("ac", 4).alias("ac"))


TEMPO = f"""with f as ({fx.FRAMES_SQL}), st as (select asset_id, avg(score) as m, count(*) as n from f group by 1 having count(*) >= 4 and max(score) > 0),
 c as (select asset_id, frame, n, score - m as x from f join st using (asset_id)),
 s as (select asset_id, frame, n, coalesce(lag(x) over w, 0) * 0.25::double + x * 0.5::double + coalesce(lead(x) over w, 0) * 0.25::double as x from c window w as (partition by asset_id order by frame)),
 nx as (select *, lead(x) over (partition by asset_id order by frame) as y from s),
 u as (select asset_id, n, frame * 4 + r as j, x * (1 - r / 4::double) + y * (r / 4::double) as v from nx cross join (select unnest(range(0, 4)) as r) where y is not null),
 a as (select a.asset_id, any_value(a.n) as n, lag, sum(a.v * b.v) as ac from u a cross join (select unnest(range(0, 9)) as lag) join u b on b.asset_id = a.asset_id and b.j = a.j + lag group by a.asset_id, lag),
 z as (select a.asset_id, a.lag, a.ac / (z.ac + 1e-9) as r, (a.ac / (z.ac + 1e-9)) * exp(-0.5 * power(log2(480.0 / a.lag) - log2(120.0), 2)) as sc from a join a z on z.asset_id = a.asset_id and z.lag = 0
    where a.lag >= 2 and a.lag <= least(8, (a.n - 1) * 4 - 1) and least(8, (a.n - 1) * 4 - 1) > 3),
 w as (select *, lag(sc) over q as y0, lead(sc) over q as y2, row_number() over (partition by asset_id order by sc desc, lag) as rk from z window q as (partition by asset_id order by lag))
"""


@query("tempo", TEMPO + "select e.asset_id, bpm, coalesce(periodicity, 0)::double as periodicity from (select distinct asset_id from (" + fx.FRAMES_SQL + ")) e left join (select asset_id, round(480.0 / (lag + case when y0 is not null and y2 is not null and abs(y0 - 2 * sc + y2) > 1e-12 then 0.5 * (y0 - y2) / (y0 - 2 * sc + y2) else 0 end), 5)::double as bpm, round(greatest(0, r), 6)::double as periodicity from w where rk = 1) t on t.asset_id = e.asset_id")
def tempo(spark, sf):
    env = fx.frames(spark, sf).select("asset_id", "frame", F.col("score").alias("env"))
    return op.tempo(env, 2.0).select("asset_id", F.round("bpm", 5).alias("bpm"), F.round("periodicity", 6).alias("periodicity"))


@query("onset_envelope")
def onset_envelope(spark, sf):
    # 32-sample windows: checked against a direct computation in the tests
    return op.onset_envelope(_pcm(spark, sf), 160, n_fft=32, hop=8)


@query("track_beats")
def track_beats(spark, sf):
    env = fx.frames(spark, sf).select("asset_id", "frame", F.col("score").alias("env"))
    return op.track_beats(env, op.tempo(env, 8.0).select("asset_id", "bpm"), 8.0)


@query("beat_confidence", """select event_id, round(least(1.0, greatest(0, value / 333.0::double) / 0.5::double) * case event_id % 3 when 0 then 0.8 when 1 then 1.0 else 0.0 end, 3)::double as confidence,
  (abs((value + 60) / 120 - 1) <= 0.06 or abs((value + 60) / 240 - 1) <= 0.06 or abs((value + 60) / 60 - 1) <= 0.06) as agree, value / 333.0::double >= 0.25 as pulse from events""")
def beat_confidence(spark, sf):
    agree = F.when(F.col("event_id") % 3 == 1, True).when(F.col("event_id") % 3 == 2, False)
    return fx.table(spark, sf, "events").select("event_id", op.beat_confidence(F.col("value") / 333.0, agree).alias("confidence"), op.tempos_agree(F.col("value") + 60, F.lit(120.0)).alias("agree"),
                                                     op.has_pulse(F.lit(120.0), F.col("value") / 333.0).alias("pulse"))


@query("suggest_transitions", """with c as (select event_id, user_id as asset_id, round(least(1.0, greatest(0.0, 0.6 * exp(-value / 4) + 0.4 * least(1.0, value / 300))), 4) as s from events), m as (select asset_id, quantile_cont(s, 0.5) as med, count(*) as n from c group by 1)
 select event_id, asset_id, s as smoothness, case when s < 0.12 or (n >= 3 and s < 0.2 and s < 0.5 * med) then 'dissolve' else 'cut' end as suggestion from c join m using (asset_id)""")
def suggest_transitions(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("user_id").alias("asset_id"), op.smoothness(F.col("value"), F.least(F.lit(1.0), F.col("value") / 300)).alias("smoothness"))
    return op.suggest_transitions(e)


@query("mix_samples", f"""with c as ({fx.CLIPS_SQL}), {PCM}, s as (select project_id, clip_id, o_custkey_asset as asset_id, start_ms % 1000 as i0, start_ms % 1000 + 40 as i1, clip_id % 20 as src0 from (select *, clip_id % 150 as o_custkey_asset from c where kind = 'audio'))
 select project_id, i0 + p.i - src0 as sample, round(sum(value * power(10.0, (clip_id % 12 - 6) / 20.0)), 5) + 0.0 as mix from p join s on s.asset_id = p.asset_id and p.i >= src0 and p.i < src0 + i1 - i0 group by 1, 2""")
def mix_samples(spark, sf):
    c = fx.clips(spark, sf).filter(F.col("kind") == "audio")
    i0 = F.col("start_ms") % 1000
    s = c.select("project_id", "clip_id", (F.col("clip_id") % 150).alias("asset_id"), i0.alias("i0"), (i0 + 40).alias("i1"), (F.col("clip_id") % 20).alias("src0"))
    gain = pb.db_to_lin((F.col("clip_id") % 12 - 6).cast("double"))
    return tl.mix_samples(s, _pcm(spark, sf), gain).withColumn("mix", F.round("mix", 5))
