"""Views that project the shared parquet tables onto the media schemas, and the same views as SQL text.

``US(ts)`` is microseconds since 1970. Times are whole microseconds or milliseconds wherever they are
summed, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of

SIX_HOURS_US = 21_600_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


# --------------------------------------------------------------------------- frames, samples, beats

EVENTS_SQL = """select user_id as asset_id, event_id, epoch_us(ts) as pts_us, value, event_type as label from events"""

FRAMES_SQL = """select user_id as asset_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
  epoch_us(ts) as pts_us, least(1.0, value / 100.0) as score, value, event_type as label, event_id from events"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("asset_id"), "event_id", micros("ts").alias("pts_us"), "value",
        F.col("event_type").alias("label"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, frame (0-based, by time), pts_us, score, value, label, event_id."""
    ev = events(spark, sf)
    numbered = scan.numbered(ev, ["asset_id"], [F.col("pts_us"), F.col("event_id")], bucket_of(F.col("pts_us"), SIX_HOURS_US), "pos")
    return numbered.select("asset_id", (F.col("pos") - 1).alias("frame"), "pts_us",
                           F.least(F.lit(1.0), F.col("value") / 100.0).alias("score"), "value", "label", "event_id")


BEATS_SQL = """select user_id as asset_id, epoch_us(ts) as time_us, least(1.0, value / 200.0) as strength, event_id
  from events where event_type = 'click'"""


def beats(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter(F.col("label") == "click").select(
        "asset_id", F.col("pts_us").alias("time_us"), F.least(F.lit(1.0), F.col("value") / 200.0).alias("strength"),
        "event_id")


KEYFRAMES_SQL = """select user_id as clip_id, epoch_us(ts) as time_us, value, event_id,
  case event_type when 'view' then 'linear' when 'click' then 'easeIn' when 'purchase' then 'easeOut'
    when 'signup' then 'easeInOut' else 'bounce' end as easing from events"""


def keyframes(spark: SparkSession, sf: str) -> DataFrame:
    names = {"view": "linear", "click": "easeIn", "purchase": "easeOut", "signup": "easeInOut"}
    easing = F.lit("bounce")
    for k, v in names.items():
        easing = F.when(F.col("label") == k, v).otherwise(easing)
    return events(spark, sf).select(F.col("asset_id").alias("clip_id"), F.col("pts_us").alias("time_us"), "value",
                                    "event_id", easing.alias("easing"))


# --------------------------------------------------------------------------- detections

DET_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

DETECTIONS_SQL = """select *, (x2 - x1) * (y2 - y1) as area from (
  select l_orderkey as frame_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
      l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) as det,
    l_returnflag as label, round(0.2 + 8 * l_discount, 2) as score,
    cast((37 * l_partkey) % 1000 as double) as x1, cast((91 * l_suppkey) % 500 as double) as y1,
    least(1280.0, (37 * l_partkey) % 1000 + 40 + 8 * l_quantity) as x2,
    least(720.0, (91 * l_suppkey) % 500 + 60 + 6 * l_quantity) as y2,
    l_partkey as part, l_orderkey // 100 as shot_id from lineitem)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """frame_id, det (unique in a frame), label, score, x1..y2, area, part, shot_id (100 frames each)."""
    li = table(spark, sf, "lineitem")
    chunk = (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.floor(F.col("l_partkey") / 65536)).cast("bigint")
    n = scan.numbered(li.select("l_orderkey", "l_returnflag", *DET_ORDER), ["l_orderkey"], [F.col(c) for c in DET_ORDER], chunk, "det")
    x = ((F.col("l_partkey") * 37) % 1000).cast("double")
    y = ((F.col("l_suppkey") * 91) % 500).cast("double")
    out = n.select(
        F.col("l_orderkey").alias("frame_id"), "det", F.col("l_returnflag").alias("label"),
        F.round(F.lit(0.2) + F.col("l_discount") * 8, 2).alias("score"), x.alias("x1"), y.alias("y1"),
        F.least(F.lit(1280.0), x + 40 + F.col("l_quantity") * 8).alias("x2"),
        F.least(F.lit(720.0), y + 60 + F.col("l_quantity") * 6).alias("y2"),
        F.col("l_partkey").alias("part"), F.floor(F.col("l_orderkey") / 100).alias("shot_id"))
    return out.withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


# --------------------------------------------------------------------------- timeline

CLIPS_SQL = """select *, (project_id + track_index) % 5 = 0 as track_muted, (project_id + track_index) % 7 = 0 as locked from (
  select o_custkey // 20 as project_id, o_orderkey as clip_id, o_custkey % 7 as asset_id,
    case o_orderstatus when 'O' then 'video' when 'F' then 'audio' else 'fx' end as kind,
    (case o_orderstatus when 'O' then 0 when 'F' then 2 else 4 end) + (case when o_orderpriority >= '3' then 1 else 0 end)::bigint as track_index,
    40 * (epoch_us(o_orderdate) // 86400000000) as start_ms, cast(floor(o_totalprice / 50) as bigint) + 100 as dur_ms,
    (o_orderkey % 50) * 100 as in_ms, (o_orderkey % 50) * 100 + cast(floor(o_totalprice / 50) as bigint) + 100 as out_ms,
    case when o_orderkey % 3 <> 0 then o_custkey * 10 + (epoch_us(o_orderdate) // 86400000000) % 3 end as link_id, o_orderkey % 11 = 0 as muted
  from orders)"""


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty customers share a project; the order status picks the track kind, the priority the track."""
    o = table(spark, sf, "orders")
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("bigint")
    base = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 2).otherwise(4)
    dur = F.floor(F.col("o_totalprice") / 50).cast("bigint") + 100
    start_in = (F.col("o_orderkey") % 50) * 100
    c = o.select(
        F.floor(F.col("o_custkey") / 20).alias("project_id"), F.col("o_orderkey").alias("clip_id"),
        (F.col("o_custkey") % 7).alias("asset_id"),
        F.when(F.col("o_orderstatus") == "O", "video").when(F.col("o_orderstatus") == "F", "audio").otherwise("fx").alias("kind"),
        (base + F.when(F.col("o_orderpriority") >= "3", 1).otherwise(0)).cast("bigint").alias("track_index"),
        (day * 40).alias("start_ms"), dur.alias("dur_ms"), start_in.alias("in_ms"), (start_in + dur).alias("out_ms"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") * 10 + day % 3).alias("link_id"),
        (F.col("o_orderkey") % 11 == 0).alias("muted"))
    place = F.col("project_id") + F.col("track_index")
    return c.withColumn("track_muted", place % 5 == 0).withColumn("locked", place % 7 == 0)


WIDE_SQL = f"""select *, case clip_id % 4 when 1 then 0.5 when 2 then 2.0 else 1.0 end::double as factor, case when clip_id % 5 = 0 then dur_ms // 3 end as freeze_at,
  case when clip_id % 5 = 0 then 400 end::bigint as freeze_hold, clip_id % 6 = 0 as reversed, case when clip_id % 7 = 0 then 300 end as fade_in_ms, case when clip_id % 8 = 0 then 500 end as fade_out_ms,
  case when kind = 'fx' then case clip_id % 4 when 0 then 'cameraSnap' when 1 then 'shake' when 2 then 'zoomPunch' else 'fadeToBlack' end end as effect, (clip_id % 10) / 8.0::double as intensity,
  case when clip_id % 2 = 0 then case clip_id % 3 when 0 then 'dissolve' when 1 then 'wipeLeft' else 'sparkle' end end as transition_type, clip_id % 4000 as transition_ms from ({CLIPS_SQL})"""


def wide_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Clips with speed, freeze, fades, effect and transition columns."""
    i = F.col("clip_id")
    fx_kind = F.when(i % 4 == 0, "cameraSnap").when(i % 4 == 1, "shake").when(i % 4 == 2, "zoomPunch").otherwise("fadeToBlack")
    return clips(spark, sf).withColumns({
        "factor": F.when(i % 4 == 1, 0.5).when(i % 4 == 2, 2.0).otherwise(1.0),
        "freeze_at": F.when(i % 5 == 0, F.floor(F.col("dur_ms") / 3)), "freeze_hold": F.when(i % 5 == 0, F.lit(400).cast("bigint")),
        "reversed": i % 6 == 0, "fade_in_ms": F.when(i % 7 == 0, 300), "fade_out_ms": F.when(i % 8 == 0, 500),
        "effect": F.when(F.col("kind") == "fx", fx_kind), "intensity": (i % 10) / 8.0,
        "transition_type": F.when(i % 2 == 0, F.when(i % 3 == 0, "dissolve").when(i % 3 == 1, "wipeLeft").otherwise("sparkle")),
        "transition_ms": i % 4000})


SHOTS_SQL = """select o_custkey as asset_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as shot,
    cast(floor(o_totalprice / 50) as bigint) + 100 as dur_ms, length(o_orderpriority) as value,
    o_orderkey from orders"""


def shots(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, shot (0-based), dur_ms, value, o_orderkey."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    n = scan.numbered(o, ["o_custkey"], [F.col("o_orderkey")], bucket_of(F.col("o_orderkey"), 1_000_000), "pos")
    return n.select(
        F.col("o_custkey").alias("asset_id"), (F.col("pos") - 1).alias("shot"),
        (F.floor(F.col("o_totalprice") / 50).cast("bigint") + 100).alias("dur_ms"),
        F.length("o_orderpriority").cast("bigint").alias("value"), "o_orderkey")


ASSETS_SQL = """select p_partkey as asset_id, 'C:/clips/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.mp4' as path,
    'scene' || p_size || '_shot' || (p_partkey % 13) || '_' || replace(p_name, ' ', '_') || '.mp4' as name,
    cast(round(p_retailprice * 10) as bigint) as duration_ms,
    case p_size % 5 when 0 then 24.0 when 1 then 25.0 when 2 then 29.97 when 3 then 30.0 else 60.0 end as fps,
    case when p_partkey % 10 < 7 then 'video' when p_partkey % 10 < 9 then 'audio' else 'image' end as kind,
    cast(p_size as bigint) as size, p_brand as brand from part"""


def assets(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    under = F.regexp_replace("p_name", " ", "_")
    pick = F.col("p_size") % 5
    return p.select(
        F.col("p_partkey").alias("asset_id"),
        F.concat(F.lit("C:/clips/"), under, F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("path"),
        F.concat(F.lit("scene"), F.col("p_size").cast("string"), F.lit("_shot"), (F.col("p_partkey") % 13).cast("string"),
                 F.lit("_"), under, F.lit(".mp4")).alias("name"),
        F.round(F.col("p_retailprice") * 10).cast("bigint").alias("duration_ms"),
        F.when(pick == 0, 24.0).when(pick == 1, 25.0).when(pick == 2, 29.97).when(pick == 3, 30.0).otherwise(60.0).alias("fps"),
        F.when(F.col("p_partkey") % 10 < 7, "video").when(F.col("p_partkey") % 10 < 9, "audio").otherwise("image").alias("kind"),
        F.col("p_size").cast("bigint").alias("size"), F.col("p_brand").alias("brand"))


# --------------------------------------------------------------------------- identity bank, pixels

BANK_SQL = "select vec_id, label as owner, embedding::double[] as emb from embeddings where vec_id % 5 = 0"
QUERIES_SQL = "select vec_id, label as truth, embedding::double[] as emb from embeddings where vec_id % 5 <> 0"


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """Reference vectors: every fifth embedding, owned by its label, each its own crop group."""
    e = table(spark, sf, "embeddings").filter(F.col("vec_id") % 5 == 0)
    return e.select(F.col("vec_id").alias("ref_id"), F.col("label").alias("owner"), F.col("vec_id").alias("crop_group"),
                    "embedding")


def probes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").filter(F.col("vec_id") % 5 != 0)
    return e.select("vec_id", F.col("label").alias("truth"), "embedding")


PIXELS_SQL = """select l_orderkey as frame_id, cast(l_linenumber as bigint) as x,
    cast(l_suppkey % 8 as bigint) as y, l_discount * 10 as r, l_tax * 10 as g, l_quantity / 50 as b, l_orderkey % 2 as side,
    l_partkey, l_suppkey from lineitem"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("bigint").alias("x"),
        (F.col("l_suppkey") % 8).alias("y"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 10).alias("g"),
        (F.col("l_quantity") / 50).alias("b"), (F.col("l_orderkey") % 2).alias("side"), "l_partkey", "l_suppkey")
