"""Detection queries over ``lineitem`` (one frame per order, one shot per 100 orders)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import geometry as g
from mediaframe.functions import vectors
from mediaframe.operators import detections as op

W, H = 1280.0, 720.0

# geometry as SQL macros written out: alias pairs a, b
IOU = """(case when greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) > 0
 then greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)
 / (a.area + b.area - greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)) else 0.0 end)"""
INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"
CONT = f"greatest({INTER} / a.area, {INTER} / b.area)"
NESTED = f"(least(a.area, b.area) <= 0.5 * greatest(a.area, b.area) and (case when a.area <= b.area then {INTER} / a.area else {INTER} / b.area end) >= 0.8)"
DIST = "sqrt(power(({0}.x1 + {0}.x2) / 2 - 640.0, 2) + power(({0}.y1 + {0}.y2) / 2 - 360.0, 2))"

PAIRS = f"""with d as ({fx.DETECTIONS_SQL}),
pairs as (select a.frame_id, a.shot_id, a.det as det_a, b.det as det_b, {IOU} as iou, {CONT} as containment, a.area / b.area as area_ratio,
  {NESTED} as nested, a.label = b.label as compatible, {DIST.format('a')} as dist_a, {DIST.format('b')} as dist_b,
  least(a.y2 - a.y1, b.y2 - b.y1) as min_height
  from d a join d b on a.frame_id = b.frame_id and a.det < b.det and {INTER} > 0)
"""


def r(expr, n=4, name=None):
    return F.round(expr, n).alias(name or expr)


@query("pair_detections", PAIRS + """select frame_id, det_a, det_b, round(iou, 8) as iou, round(containment, 8) as containment,
  round(area_ratio, 8) as area_ratio, nested, compatible, round(dist_a, 7) as dist_a, round(dist_b, 7) as dist_b from pairs""")
def pair_detections(spark, sf):
    p = op.pair_detections(fx.detections(spark, sf), W, H)
    return p.select("frame_id", "det_a", "det_b", r("iou", 8), r("containment", 8), r("area_ratio", 8), "nested", "compatible", r("dist_a", 7), r("dist_b", 7))


@query("is_group_box", f"""select frame_id, det, area > 0.3 * 1280 * 720 or (y2 - y1 >= 0.9 * 720 and x2 - x1 > 0.7 * 1280) as wide,
  area > 0.55 * 400 * 300 or (y2 - y1 >= 0.9 * 300 and x2 - x1 > 0.7 * 400) as grouped from ({fx.DETECTIONS_SQL})""")
def is_group_box(spark, sf):
    b = g.box()
    wide = (g.raw_area(b) > 0.3 * W * H) | ((g.height(b) >= 0.9 * H) & (g.width(b) > 0.7 * W))
    return fx.detections(spark, sf).select("frame_id", "det", wide.alias("wide"), g.is_group_box(b, 400.0, 300.0).alias("grouped"))


@query("head_box", f"""select frame_id, det, round(case when y2 - y1 >= 1.3 * greatest(x2 - x1, 1e-6) then y1 + 0.45 * (y2 - y1) else y2 end, 4) as head_y2,
  round(x1 + 0.2 * (x2 - x1), 4) as region_x1, round(x2 - 0.2 * (x2 - x1), 4) as region_x2, round(y1 + 0.3 * (y2 - y1), 4) as region_y2
  from ({fx.DETECTIONS_SQL})""")
def head_box(spark, sf):
    b = g.box()
    head, region = g.head_box(b), g.head_region(b)
    return fx.detections(spark, sf).select("frame_id", "det", F.round(head.y2, 4).alias("head_y2"), F.round(region.x1, 4).alias("region_x1"),
                                           F.round(region.x2, 4).alias("region_x2"), F.round(region.y2, 4).alias("region_y2"))


@query("box_functions", f"""select frame_id, det, round((x1 + (x2 - x1) / 2), 4) as cx, round(y1 + (y2 - y1) / 2, 4) as cy,
  round((x2 - x1) / (y2 - y1), 8) as aspect, greatest(0.0, floor(x1 - 0.05 * (x2 - x1))) as ex1, greatest(0.0, floor(y1 - 0.05 * (y2 - y1))) as ey1,
  least(1280.0, ceil(x2 + 0.05 * (x2 - x1))) as ex2, least(720.0, ceil(y2 + 0.05 * (y2 - y1))) as ey2,
  x1 <= 0.02 * 1280 or y1 <= 0.02 * 720 or x2 >= 1280 - 0.02 * 1280 or y2 >= 720 - 0.02 * 720 as at_edge,
  case when greatest(x1 - 400, 300 - x2, y1 - 300, 200 - y2) >= -1 then
    case when 300 - x2 = greatest(x1 - 400, 300 - x2, y1 - 300, 200 - y2) then 'left' when x1 - 400 = greatest(x1 - 400, 300 - x2, y1 - 300, 200 - y2) then 'right'
    when 200 - y2 = greatest(x1 - 400, 300 - x2, y1 - 300, 200 - y2) then 'above' else 'below' end end as side,
  x1 < 400 and x2 > 300 and y1 < 300 and y2 > 200 as hits from ({fx.DETECTIONS_SQL})""")
def box_functions(spark, sf):
    b = g.box()
    cx, cy, aspect, _ = g.to_centre_form(b)
    e = g.expand(b, 0.05, W, H)
    other = g.Box(*[F.lit(float(v)) for v in (300, 200, 400, 300)])
    return fx.detections(spark, sf).select(
        "frame_id", "det", F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"), F.round(aspect, 8).alias("aspect"), e.x1.alias("ex1"),
        e.y1.alias("ey1"), e.x2.alias("ex2"), e.y2.alias("ey2"), g.touches_edge(b, W, H).alias("at_edge"),
        g.box_side(b, other).alias("side"), g.intersects(b, other).alias("hits"))


@query("score_class", f"""select frame_id, det, case when score >= 0.7 then 'high' when score >= 0.4 then 'low' else 'none' end as score_class
  from ({fx.DETECTIONS_SQL}) where area >= 20000""")
def score_class(spark, sf):
    return op.score_class(fx.detections(spark, sf), 0.7, 0.4, 20000.0).select("frame_id", "det", "score_class")


@query("filter_candidates", f"""select frame_id, det from ({fx.DETECTIONS_SQL}) where area >= 0.012 * 1280 * 720
  and (x2 - x1) / greatest(y2 - y1, 1) <= 2.5 and (y2 - y1) / greatest(x2 - x1, 1) <= 5 and (score >= 0.5 or y2 - y1 >= 0.25 * 720)""")
def filter_candidates(spark, sf):
    d = fx.detections(spark, sf).withColumn("char_prob", F.col("score"))
    return op.filter_candidates(d, W, H).select("frame_id", "det")


@query("labels_compatible", """select p_partkey as id, p_type = 'STANDARD' or p_name like '%figure%' or regexp_matches(lower(p_brand || ' ' || p_name),
  'character|creature|animal|person|people|figure|gear') as ok from part""")
def labels_compatible(spark, sf):
    # "gear" stands in for a generic word so that both outcomes occur in the data
    words = F.regexp_replace(F.concat_ws(" ", F.lower("p_brand"), "p_name"), "gear", "creature")
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), op.labels_compatible(F.when(F.col("p_type") == "STANDARD", words).otherwise(F.lit("x")), words).alias("ok"))


PROMPTS = ["red widget", "small animal ring", "gear box", "Blue Bolt"]


def _snap_sql(col):
    words = f"list_distinct(list_filter(string_split({col}, ' '), lambda w: w <> ''))"
    exact = " ".join(f"when {col} = '{p.lower()}' then '{p}'" for p in PROMPTS)
    inside = " ".join(f"when contains({col}, '{p.lower()}') or contains('{p.lower()}', {col}) then '{p}'" for p in PROMPTS)
    counts = [f"len(list_intersect({words}, {sorted(set(p.lower().split()))}))" for p in PROMPTS]
    top = f"greatest({', '.join(counts)})"
    most = " ".join(f"when {c} = {top} and {c} > 0 then '{p}'" for p, c in zip(PROMPTS, counts))
    return f"coalesce(case {exact} end, case {inside} end, case {most} end)"


@query("snap_label", f"select p_partkey as id, {_snap_sql('lower(p_name)')} as prompt from part")
def snap_label(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), op.snap_label(F.col("p_name"), PROMPTS).alias("prompt"))


def _fold_nms(order, test, extra=""):
    return f"""with d as ({fx.DETECTIONS_SQL}),
 l as (select frame_id, list({{'det': det, 'label': label, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'area': area}} order by {order}, det) as boxes from d group by 1),
 k as (select frame_id, list_reduce(list_prepend([], list_transform(boxes, lambda b: [b])),
   lambda acc, x: case when len(list_filter(acc, lambda a: {test})) > 0 then acc else list_append(acc, x[1]) end) as kept from l)
 select frame_id, unnest(kept).det as det from k"""


X_IOU = IOU.replace("b.", "x[1].")
X_CONT = f"({INTER.replace('b.', 'x[1].')} / greatest(1e-6, x[1].area))"


@query("nms", _fold_nms("score desc", f"a.label = x[1].label and {X_IOU} > 0.5"))
def nms(spark, sf):
    return op.nms(fx.detections(spark, sf), 0.5)


@query("nms_class_agnostic", _fold_nms("score desc", f"{X_IOU} > 0.6"))
def nms_class_agnostic(spark, sf):
    return op.nms(fx.detections(spark, sf), 0.6, class_agnostic=True)


@query("nested_filter", _fold_nms("area desc", f"{X_CONT} > 0.8"))
def nested_filter(spark, sf):
    return op.nested_filter(fx.detections(spark, sf))


def _tracks(spark, sf):
    d = fx.detections(spark, sf).filter(F.col("label") == "A")
    return d.select("frame_id", F.col("det").alias("track_id"), (F.col("x1") + 6).alias("x1"), (F.col("y1") + 4).alias("y1"), (F.col("x2") + 6).alias("x2"), (F.col("y2") + 4).alias("y2"))


@query("iou_match", f"""with recursive d as ({fx.DETECTIONS_SQL}),
 t as (select frame_id, det as track_id, x1 + 6 as x1, y1 + 4 as y1, x2 + 6 as x2, y2 + 4 as y2, area from d where label = 'A'),
 c as (select a.frame_id, a.det, b.track_id, {IOU} as iou from d a join t b on a.frame_id = b.frame_id and {IOU} >= 0.5),
 n as (select *, row_number() over (partition by frame_id order by iou desc, det, track_id) as k from c),
 g as (select frame_id, k, [det] as ds, [track_id] as ts, det, track_id, true as won from n where k = 1
   union all select n.frame_id, n.k,
     case when list_contains(g.ds, n.det) or list_contains(g.ts, n.track_id) then g.ds else list_append(g.ds, n.det) end,
     case when list_contains(g.ds, n.det) or list_contains(g.ts, n.track_id) then g.ts else list_append(g.ts, n.track_id) end,
     n.det, n.track_id, not (list_contains(g.ds, n.det) or list_contains(g.ts, n.track_id))
   from g join n on n.frame_id = g.frame_id and n.k = g.k + 1)
 select d.frame_id, d.det, coalesce(g.track_id, 100000 + cast(least(7, greatest(0, floor((y1 + y2) / 2 / 720 * 8))) * 8 + least(7, greatest(0, floor((x1 + x2) / 2 / 1280 * 8))) as bigint)) as track_id
 from d left join g on g.frame_id = d.frame_id and g.det = d.det and g.won""")
def iou_match(spark, sf):
    return op.iou_match(fx.detections(spark, sf), _tracks(spark, sf), W, H).select("frame_id", "det", "track_id")


# --- duplicates: the label is the best guess, the score the identity score, the size the appearance

IDENT = f"""ident as (select *, case when label = 'A' and score >= 0.5 then 'A' end as character, case when label <> 'N' then label end as best, score as id_score,
  case when det % 5 = 0 then 'text' end as rejected, det % 3 as track_id from ({fx.DETECTIONS_SQL}))"""
SIM = "(1.0 - abs(a.score - b.score))"
FINDINGS = f"""with {IDENT},
 p as (select a.frame_id, a.shot_id, {SIM} as sim, a.det as a_det, b.det as b_det, a.track_id as a_t, b.track_id as b_t, a.character as ac, b.character as bc, a.best as ab, b.best as bb,
   a.id_score as asc_, b.id_score as bsc, a.rejected is null and b.rejected is null and a.best is not null and b.best is not null as known,
   least(a.y2 - a.y1, b.y2 - b.y1) >= 108 as tall, a.area / b.area between 0.5 and 2.0 as ratio, a.label = b.label as compatible,
   {DIST.format('a')} as da, {DIST.format('b')} as db, a.area as aa, b.area as ba, (a.x1 + a.x2) / 2 as acx, (b.x1 + b.x2) / 2 as bcx
  from ident a join ident b on a.frame_id = b.frame_id and a.det < b.det and {IOU} <= 0.3 and {CONT} <= 0.6),
 q as (select *, case when ac is not null or bc is not null then case when ac = bc and sim >= 0.85 then 'named' end
    when known and least(asc_, bsc) >= 0.4 and ab <> bb then null
    when known and least(asc_, bsc) >= 0.4 and ab = bb and sim >= 0.85 and tall then 'near'
    when compatible and tall and least(asc_, bsc) >= 0.4 and ratio and sim >= 0.85 then 'generic'
    when compatible and tall and least(asc_, bsc) >= 0.4 and ratio and sim >= 0.75 then 'borderline' end as rule from p),
 o as (select *, case when rule in ('named', 'near') then case when abs(asc_ - bsc) > 1e-6 then asc_ > bsc else da <= db end
    else da < db or (abs(da - db) < 1e-6 and aa >= ba) end as first from q where rule is not null),
 findings as (select frame_id, shot_id, rule, round(sim, 4) as similarity, case when rule = 'named' then ac when rule = 'near' then ab end as character,
   case when first then a_det else b_det end as p_det, case when first then b_det else a_det end as d_det,
   case when first then a_t else b_t end as p_t, case when first then b_t else a_t end as d_t, case when first then aa else ba end as p_area,
   case when first then ba else aa end as d_area, case when first then acx else bcx end as p_cx, case when first then bcx else acx end as d_cx from o),
 keyed as (select *, case when character is not null then 'char:' || character else 'pair:' || least(p_t, d_t) || ':' || greatest(p_t, d_t) end as group_key from findings where rule <> 'borderline')
"""


def _idents(spark, sf):
    d = fx.detections(spark, sf)
    return d.select("frame_id", "det", "label", "x1", "y1", "x2", "y2", (F.col("det") % 3).alias("track_id"),
                    F.when((F.col("label") == "A") & (F.col("score") >= 0.5), "A").alias("character"), F.when(F.col("label") != "N", F.col("label")).alias("best"),
                    F.col("score").alias("id_score"), F.when(F.col("det") % 5 == 0, "text").alias("rejected"))


def _findings(spark, sf):
    sim = lambda a, b: F.lit(1.0) - F.abs(F.col(f"{a}id_score") - F.col(f"{b}id_score"))
    return op.duplicate_candidates(_idents(spark, sf), sim, W, H, like_floor=0.4).withColumn("shot_id", F.floor(F.col("frame_id") / 100))


def _confirmable(spark, sf):
    return _findings(spark, sf).filter(F.col("rule") != "borderline")


ALIKE = FINDINGS + f""", alike as (select shot_id, sim, rule from q where ac is null and bc is null and compatible and tall and least(asc_, bsc) >= 0.4 and ratio
   and not (known and least(asc_, bsc) >= 0.4 and ab <> bb) and coalesce(rule, '') <> 'near'),
 looks as (select shot_id, count(*) as generic_pairs, count(*) filter (rule = 'borderline') as borderline, max(sim) as max_sim from alike group by 1),
 over_ as (select a.shot_id, count(*) as pairs, max(case when a.label = b.label then {IOU} end) as x,
   max(case when a.label = b.label and not {NESTED} and not coalesce(a.character <> b.character, false) and least(a.y2 - a.y1, b.y2 - b.y1) >= 108 then {IOU} end) as m
   from ident a join ident b on a.frame_id = b.frame_id and a.det < b.det and {IOU} > 0 group by 1),
 base as (select shot_id, count(distinct frame_id) as frames, count(*) as detections from ident group by 1)
"""


@query("shot_stats", ALIKE + """select shot_id, frames, detections, coalesce(pairs, 0) as pairs, round(coalesce(x, 0), 8) as max_label_iou, round(coalesce(m, 0), 8) as max_ambiguous_iou,
  coalesce(generic_pairs, 0) as generic_pairs, coalesce(borderline, 0) as borderline, round(coalesce(max_sim, 0), 8)::double as max_sim,
  case when frames > 0 and detections = 0 then 'nothing found' when coalesce(m, 0) > 0.3 then 'ambiguous overlap' when coalesce(borderline, 0) > 0 then 'borderline similarity' end as reason
 from base left join over_ using (shot_id) left join looks using (shot_id)""")
def shot_stats(spark, sf):
    d = _idents(spark, sf)
    shot = F.floor(F.col("frame_id") / 100)
    sim = lambda a, b: F.lit(1.0) - F.abs(F.col(f"{a}id_score") - F.col(f"{b}id_score"))
    alike = op.duplicate_pairs(d, sim, W, H, like_floor=0.4).withColumn("shot_id", shot)
    pairs = op.pair_detections(d.withColumn("score", F.col("id_score")), W, H).withColumn("shot_id", shot)
    s = op.shot_stats(d.withColumn("shot_id", shot), pairs, H, alike)
    reason = op.escalation_reason(F.col("frames"), F.col("detections"), F.col("max_ambiguous_iou"), F.col("borderline"))
    return s.select("shot_id", "frames", "detections", "pairs", r("max_label_iou", 8), r("max_ambiguous_iou", 8), "generic_pairs", "borderline", r("max_sim", 8), reason.alias("reason"))


@query("find_duplicates", FINDINGS + "select frame_id, shot_id, rule, similarity, character, p_det, d_det from findings")
def find_duplicates(spark, sf):
    return _findings(spark, sf).select("frame_id", "shot_id", "rule", "similarity", "character", "p_det", "d_det")


@query("confirm_findings", FINDINGS + """select frame_id, shot_id, group_key, p_det, d_det from keyed where (shot_id, group_key) in
  (select (shot_id, group_key) from (select shot_id, group_key from keyed group by 1, 2 having count(distinct frame_id) >= 2))""")
def confirm_findings(spark, sf):
    return op.confirm_findings(_confirmable(spark, sf)).select("frame_id", "shot_id", "group_key", "p_det", "d_det")


@query("dedupe_findings", FINDINGS + """select shot_id, group_key, frame_id, p_det, d_det from (select *, row_number() over (partition by shot_id, group_key order by frame_id, p_det, d_det) as rn,
  count(*) over (partition by shot_id, group_key) as n from keyed) where rn = n // 2 + 1""")
def dedupe_findings(spark, sf):
    return op.dedupe_findings(_confirmable(spark, sf)).select("shot_id", "group_key", "frame_id", "p_det", "d_det")


@query("harmonize_roles", FINDINGS + """, v as (select *, count(*) filter (p_cx < d_cx) over w as nl, count(*) filter (p_cx >= d_cx) over w as nr,
   avg(p_area) filter (p_cx < d_cx) over w as al, avg(p_area) filter (p_cx >= d_cx) over w as ar from keyed window w as (partition by shot_id, group_key)),
 s as (select *, nl > 0 and nr > 0 and (p_cx < d_cx) <> (case when nl <> nr then nl > nr else al >= ar end) as swap from v)
 select shot_id, group_key, frame_id, case when swap then d_det else p_det end as p_det, case when swap then p_det else d_det end as d_det from s""")
def harmonize_roles(spark, sf):
    return op.harmonize_roles(_confirmable(spark, sf)).select("shot_id", "group_key", "frame_id", "p_det", "d_det")


@query("merge_passes", FINDINGS + """, f1 as (select * from findings where frame_id % 2 = 0 and rule <> 'borderline'), f2 as (select * from findings where frame_id % 2 = 1 and rule <> 'borderline')
 select shot_id, frame_id, p_det, d_det, character from f2 union all
 select shot_id, frame_id, p_det, d_det, character from f1 where character is not null and not exists (select 1 from f2 where f2.shot_id = f1.shot_id and f2.character = f1.character)""")
def merge_passes(spark, sf):
    f = _confirmable(spark, sf).select("shot_id", "frame_id", "p_det", "d_det", "character")
    return op.merge_passes(f.filter(F.col("frame_id") % 2 == 0), f.filter(F.col("frame_id") % 2 == 1))


SIGHT = f"""with s as (select frame_id, shot_id, det % 3 as track_id, case when score >= 0.9 then label end as character, case when score >= 0.6 then label end as loose from ({fx.DETECTIONS_SQL}))"""
CAST = SIGHT + """, h as (select shot_id, track_id, loose as character, count(*) as n from s where loose is not null group by 1, 2, 3),
 cast_rows as (select shot_id, character from s where character is not null group by 1, 2 having count(distinct frame_id) >= 20
   union select shot_id, character from (select *, sum(n) over (partition by shot_id, track_id) as t from h) where n >= 3 and n * 2 > t)
"""


def _sightings(spark, sf):
    d = fx.detections(spark, sf)
    return d.select("frame_id", "shot_id", (F.col("det") % 3).alias("track_id"), F.when(F.col("score") >= 0.9, F.col("label")).alias("character"),
                    F.when(F.col("score") >= 0.6, F.col("label")).alias("loose"))


@query("shot_cast", CAST + "select shot_id, character from cast_rows")
def shot_cast(spark, sf):
    return op.shot_cast(_sightings(spark, sf), min_frames=20)


@query("scene_tags", CAST + """select shot_id // 10 as asset_id, string_agg(name, ',' order by position) as tags from (select distinct shot_id // 10, shot_id, position, name from
  (select distinct shot_id // 10 * 10 as shot_id, character from cast_rows) join (values ('N', 'Nora', 0), ('R', 'Rex', 1), ('A', 'Ann', 2)) m(character, name, position) using (character)) group by 1""")
def scene_tags(spark, sf):
    cast = op.shot_cast(_sightings(spark, sf), min_frames=20)
    manifest = spark.createDataFrame([("N", "Nora", 0), ("R", "Rex", 1), ("A", "Ann", 2)], "character string, name string, position int")
    shots = fx.detections(spark, sf).select("shot_id", F.floor(F.col("shot_id") / 10).alias("asset_id")).distinct()
    return op.scene_tags(shots, cast, F.broadcast(manifest))


@query("cast_intersection", SIGHT + """select shot_id, character from (select distinct shot_id, character from s where character is not null and frame_id % 2 = 0)
  intersect select shot_id, character from s where character is not null and frame_id % 2 = 1""")
def cast_intersection(spark, sf):
    s = _sightings(spark, sf).filter(F.col("character").isNotNull())
    return op.cast_intersection(s.filter(F.col("frame_id") % 2 == 0), s.filter(F.col("frame_id") % 2 == 1))


@query("reuse_detections", f"""with d as ({fx.DETECTIONS_SQL}), w as (select distinct frame_id, frame_id % 4 as checksum from d),
  c as (select frame_id, frame_id % 4 - frame_id % 3 // 2 as checksum, 0.1 * (frame_id % 5) as floor, det, score from d)
  select w.frame_id, det, score, c.frame_id is not null as hit from w left join c on c.frame_id = w.frame_id and c.checksum = w.checksum and c.floor <= 0.3 + 1e-9 where c.frame_id is null or score >= 0.3""")
def reuse_detections(spark, sf):
    d = fx.detections(spark, sf)
    wanted = d.select("frame_id", (F.col("frame_id") % 4).alias("checksum"), F.lit("cheap").alias("detector")).distinct()
    cache = d.select("frame_id", (F.col("frame_id") % 4 - F.floor(F.col("frame_id") % 3 / 2)).alias("checksum"), F.lit("cheap").alias("detector"),
                     (F.lit(0.1) * (F.col("frame_id") % 5)).alias("floor"), "det", "score")
    return op.reuse_detections(wanted, cache, 0.3).select("frame_id", "det", "score", "hit")


@query("visible_union", f"select shot_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from ({fx.DETECTIONS_SQL}) group by 1")
def visible_union(spark, sf):
    return op.visible_union(fx.detections(spark, sf), ["shot_id"])


@query("mask_to_bbox", f"""with d as ({fx.DETECTIONS_SQL}), m as (select frame_id, det, unnest(range(cast(x1 as bigint), cast(x1 as bigint) + 40, 4)) as x, cast(y1 as bigint) + part % 50 as y from d),
  i as (select d.frame_id, d.det, count(*) as n, min(x) as a, min(y) as b, max(x) + 1 as c, max(y) + 1 as e from d join m using (frame_id, det)
    where x >= greatest(0, floor(x1 - 0.05 * (x2 - x1))) and x < least(1280, ceil(x2 + 0.05 * (x2 - x1))) and y >= greatest(0, floor(y1 - 0.05 * (y2 - y1))) and y < least(720, ceil(y2 + 0.05 * (y2 - y1))) group by 1, 2)
  select frame_id, det, case when ok then a else x1 end as x1, case when ok then b else y1 end as y1, case when ok then c else x2 end as x2, case when ok then e else y2 end as y2, ok as tightened
  from (select d.*, a, b, c, e, coalesce(n >= 0.002 * greatest(area, 1), false) as ok from d left join i using (frame_id, det))""")
def mask_to_bbox(spark, sf):
    d = fx.detections(spark, sf)
    x0 = F.col("x1").cast("bigint")
    masks = d.select("frame_id", "det", F.explode(F.sequence(x0, x0 + 36, F.lit(4).cast("bigint"))).alias("x"), (F.col("y1").cast("bigint") + F.col("part") % 50).alias("y"))
    return op.mask_to_bbox(masks, d.select("frame_id", "det", "x1", "y1", "x2", "y2"), 1280, 720, min_fill=0.002)


@query("lineup_by_rank", f"""with d as ({fx.DETECTIONS_SQL}), o as (select distinct frame_id, unnest([0, 1, 2]) as position from d),
  top as (select * from (select *, row_number() over (partition by frame_id order by score desc, det) as k from d) where k <= 3),
  z as (select *, row_number() over (partition by frame_id order by (x1 + x2) / 2, det) - 1 as position from top)
  select frame_id as image_id, cast(position as int) as position, 'c' || position as character, det from z""")
def lineup_by_rank(spark, sf):
    d = fx.detections(spark, sf).withColumnRenamed("frame_id", "image_id")
    lineup = d.select("image_id").distinct().select("image_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position")).withColumn(
        "character", F.concat(F.lit("c"), F.col("position").cast("string")))
    return op.lineup_by_rank(d, lineup).select("image_id", "position", "character", "det")


@query("cast_loose", """select vec_id, case when (score >= 0.66 and (margin >= 0.05 or (agree and prob >= 0.8)) or agree and score >= 0.62 and prob >= 0.95) and not rejected then best end as loose
  from (select l_partkey * 100 + l_linenumber as vec_id, l_orderkey, 0.5 + l_quantity / 100 as score, l_discount as margin, l_tax * 12.5 as prob, l_returnflag = l_linestatus or l_suppkey % 2 = 0 as agree, l_returnflag as best,
    l_suppkey % 7 = 0 as rejected from lineitem)""")
def cast_loose(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    agree = (F.col("l_returnflag") == F.col("l_linestatus")) | (F.col("l_suppkey") % 2 == 0)
    loose = op.loose_cast(F.col("l_returnflag"), F.lit(0.5) + F.col("l_quantity") / 100, F.col("l_discount"), F.when(F.col("l_suppkey") % 7 == 0, "text"),
                          F.when(agree, F.col("l_returnflag")).otherwise("?"), F.col("l_tax") * 12.5)
    return li.select((F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("vec_id"), loose.alias("loose"))


@query("embedding_norms", """select vec_id, round(list_cosine_similarity(e, f), 5) as cos, round(sqrt(list_inner_product(e, e)), 5) as norm, round(e[1] / (sqrt(list_inner_product(e, e)) + 1e-9), 5) + 0.0 as first
  from (select vec_id, embedding::double[] as e, list_reverse(embedding::double[]) as f from embeddings)""")
def embedding_norms(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    v = F.col("embedding")
    return e.select("vec_id", F.round(vectors.cosine(v, F.reverse(v)), 5).alias("cos"), F.round(vectors.norm(v), 5).alias("norm"),
                    F.round(F.element_at(vectors.l2_normalise(v), 1), 5).alias("first"))
