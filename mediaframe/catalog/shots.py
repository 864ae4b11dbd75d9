"""Shot queries over ``events`` (one asset per user, one frame per event)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.operators import shots as op
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of

SCENES = f"""
with f as ({fx.FRAMES_SQL}),
e as (select asset_id, frame, score > 0.5 as hot,
  lag(score > 0.5) over (partition by asset_id order by frame) as before,
  lead(score > 0.5) over (partition by asset_id order by frame) as after from f),
r as (select *, sum(case when coalesce(before, true) then 1 else 0 end) over (partition by asset_id order by frame) - 1 as scene
  from e where not hot),
scenes as (select asset_id, cast(scene as bigint) as scene, min(frame) as start_frame,
  max(case when after then frame + 1 else frame end) as end_frame from r group by 1, 2
  union all select asset_id, 0, 0, max(frame) from e group by asset_id having bool_and(hot))
"""

SHOTS = SCENES + """,
n as (select asset_id, max(frame) + 1 as n_frames from f group by 1),
c as (select s.asset_id, s.start_frame as frame, (select max(score) from f where f.asset_id = s.asset_id
    and f.frame between s.start_frame - 3 and s.start_frame - 1) as confidence from scenes s where scene > 0),
st as (select c.asset_id, c.frame, coalesce(confidence, 0.75) as confidence from c join n using (asset_id) where frame > 0 and frame < n_frames
  union all select asset_id, 0, 1.0 from n),
sp as (select asset_id, row_number() over w - 1 as shot, frame as start_frame,
  coalesce(lead(frame) over w - 1, n_frames - 1) as end_frame, confidence
  from st join n using (asset_id) window w as (partition by asset_id order by frame)),
shots as (select sp.asset_id, shot, start_frame, end_frame, round(least(1.0, greatest(0.0, confidence)), 4) as confidence,
  a.pts_us as start_us, b.pts_us as end_us, 'scores' as method
  from sp join f a on a.asset_id = sp.asset_id and a.frame = start_frame join f b on b.asset_id = sp.asset_id and b.frame = end_frame)
"""


@query("scenes_from_scores", SCENES + "select asset_id, scene, start_frame, end_frame from scenes")
def scenes_from_scores(spark, sf):
    return op.scenes_from_scores(fx.frames(spark, sf)).select("asset_id", "scene", "start_frame", "end_frame")


@query("detect_shots", SHOTS + "select * from shots")
def detect_shots(spark, sf):
    return op.detect_shots(fx.frames(spark, sf))


@query("shots_from_cuts", f"""with f as ({fx.FRAMES_SQL}), n as (select asset_id, max(frame) + 1 as n from f group by 1),
  c as (select asset_id, frame, score as confidence from f join n using (asset_id) where label = 'signup' and frame > 0
    union all select asset_id, 0, 1.0 from n),
  s as (select asset_id, row_number() over w - 1 as shot, frame as start_frame, coalesce(lead(frame) over w, n) - 1 as end_frame, confidence
    from c join n using (asset_id) window w as (partition by asset_id order by frame))
  select s.asset_id, shot, start_frame, end_frame, round(least(1.0, greatest(0.0, confidence)), 4) as confidence, a.pts_us as start_us,
    b.pts_us as end_us, 'markers' as method from s join f a on a.asset_id = s.asset_id and a.frame = start_frame
    join f b on b.asset_id = s.asset_id and b.frame = end_frame""")
def shots_from_cuts(spark, sf):
    f = fx.frames(spark, sf)
    cuts = f.filter(F.col("label") == "signup").select("asset_id", "frame", F.col("score").alias("confidence"))
    sizes = f.groupBy("asset_id").agg((F.max("frame") + 1).alias("n_frames"))
    return op.shots_from_cuts(cuts, sizes, f.select("asset_id", "frame", "pts_us"), method="markers")


@query("cut_confidence", f"""with f as ({fx.FRAMES_SQL}) select asset_id, frame, confidence from (select asset_id, frame, label,
  max(score) over (partition by asset_id order by frame rows between 3 preceding and 1 preceding) as confidence from f)
  where label = 'error'""")
def cut_confidence(spark, sf):
    f = fx.frames(spark, sf)
    return op.cut_confidence(f.filter(F.col("label") == "error").select("asset_id", "frame"), f.select("asset_id", "frame", "score"))


@query("sliding_windows", f"""with n as (select asset_id, max(frame) + 1 as n from ({fx.FRAMES_SQL}) group by 1),
  w as (select asset_id, n, unnest(range(0, (n - 1) // 50 + 1)) as window_id from n),
  p as (select asset_id, n, window_id, unnest(range(0, 100)) as pos from w)
  select asset_id, window_id, pos, least(greatest(window_id * 50 + pos - 25, 0), n - 1) as frame,
    pos >= 25 and pos < 75 and window_id * 50 + pos - 25 < n as keep from p""")
def sliding_windows(spark, sf):
    return op.sliding_windows(fx.frames(spark, sf).select("asset_id", "frame"))


DELTAS = f"""with f as ({fx.FRAMES_SQL}),
d as (select asset_id, frame, abs(score - coalesce(lag(score) over (partition by asset_id order by frame), score)) as delta from f),
m as (select asset_id, frame, delta, (sum(delta) over w - delta) / nullif(count(*) over w - 1, 0) as mean from d
  window w as (partition by asset_id order by frame range between 2 preceding and 2 following)),
s as (select asset_id, frame, delta, case when mean > 0 then delta / mean else 0.0 end as ratio from m)
"""


def _deltas(spark, sf):
    f = fx.frames(spark, sf)
    d = scan.ordered_scan(f, ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), op.BLOCK), prev=scan.lag(F.col("score")))
    return d.select("asset_id", "frame", F.abs(F.col("score") - F.coalesce("prev", "score")).alias("delta"))


@query("adaptive_scores", DELTAS + "select asset_id, frame, round(delta, 6) + 0.0 as delta, round(ratio, 5) + 0.0 as ratio from s")
def adaptive_scores(spark, sf):
    return op.adaptive_scores(_deltas(spark, sf)).select(
        "asset_id", "frame", F.round("delta", 6).alias("delta"), F.round("ratio", 5).alias("ratio"))


@query("adaptive_cuts", DELTAS.replace("with f", "with recursive f") + """,
h as (select asset_id, frame from s where ratio >= 1.5),
k as (select asset_id, min(frame) as frame from h where frame >= 12 group by 1
  union all select k.asset_id, (select min(h.frame) from h where h.asset_id = k.asset_id and h.frame >= k.frame + 12)
  from k where k.frame is not null)
select asset_id, frame from k where frame is not null""")
def adaptive_cuts(spark, sf):
    return op.adaptive_cuts(_deltas(spark, sf), ratio=1.5)
