"""Colour queries over ``lineitem`` pixels (r from discount, g from tax, b from quantity)."""

from pyspark.sql import functions as F

from mediaframe import fixtures as fx
from mediaframe.catalog import query
from mediaframe.functions import color as c
from mediaframe.operators import color as op

PX = f"p as (select *, row_number() over () as rn from ({fx.PIXELS_SQL}))"


def px(spark, sf):
    return fx.pixels(spark, sf)


def grade(**kw):
    return F.struct(*[(F.lit(float(v)) if not hasattr(v, "alias") else v).alias(k) for k, v in kw.items()])


KEY = ["frame_id", "x", "y", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)
LUMA = "(0.2126::double * {0}r + 0.7152::double * {0}g + 0.0722::double * {0}b)"


def ss(lo, hi, x):
    t = f"least(greatest((({x}) - {lo}) / ({hi} - {lo})::double, 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def three(f):
    return ", ".join(f"{f(ch)} as {ch}" for ch in "rgb")


def step(name, src, f, extra=""):
    return f"{name} as (select * exclude (r, g, b, l), {three(f)} from (select *, {LUMA.format('')} as l{extra} from {src}))"


ROLL = "(case when {0} <= 0.8 then {0} else 0.8 + 0.2 * tanh(({0} - 0.8) / 0.2) end)"
E10 = "power(2, 0.6::double)"
GRADE = f"""with {PX}, {step('g1', 'p', lambda q: f"(({ROLL.format(f'({q} * {E10})')} + 0.1 * 0.5 - 0.5) * 1.2::double + 0.5)")},
 {step('g2', 'g1', lambda q: f"({q} + 0.3 * 0.5 * {ss(0.5, 1.0, 'l')} - 0.1 * 0.5 * (1 - {ss(0.0, 0.5, 'l')}))")},
 g3 as (select * exclude (l), least(greatest(l, 0), 1) as cl from (select *, {LUMA.format('')} as l from g2)),
 g4 as (select * exclude (r, g, b, cl), {three(lambda q: f"case when cl > 1e-4 then {q} * (cl + 0.2 * (0.6 * cl * (1 - cl) * (1 - cl) - 0.4 * cl * cl * (1 - cl))) / cl else {q} + cl + 0.2 * (0.6 * cl * (1 - cl) * (1 - cl) - 0.4 * cl * cl * (1 - cl)) end")} from g3),
 {step('g5', 'g4', lambda q: f"(l + ({q} - l) * (1 + 0.15 * 0.2::double))")},
 g6 as (select * exclude (r, g, b), greatest(0, r + 0.4 * 0.12 + 0.2 * 0.05) as r, greatest(0, g - 0.2 * 0.1) as g, greatest(0, b - 0.4 * 0.12 + 0.2 * 0.05) as b from g5),
 g7 as (select *, {LUMA.format('')} as l from g6), g8 as (select *, 1.3 - 0.24 * least(greatest(1.5 * sqrt(power(r - l, 2) + power(g - l, 2) + power(b - l, 2)), 0), 1) + 0.24 - 0.0 as k from g7),
 g9 as (select * exclude (r, g, b), {three(lambda q: f"least(greatest(l + ({q} - l) * k, 0), 1)")} from g8)
"""


@query("grade", GRADE + f"select {KEYS}, " + ", ".join(f"round({q}, 6)::double + 0.0 as {q}" for q in "rgb") + " from g9")
def grade_query(spark, sf):
    g = grade(exposure=10, brightness=5, contrast=10, highlights=15, shadows=-5, brilliance=10, temperature=20, tint=10, saturation=15, vibrance=12)
    out = c.grade_pixels(px(spark, sf).withColumn("grade", g))
    return out.select(*KEY, *[F.round(q, 6).alias(q) for q in "rgb"])


HSV = """h as (select *, greatest(r, g, b) as v, greatest(r, g, b) - least(r, g, b) as d from p), hs as (select *, case when v > 0 then d / v else 0 end as s,
 case when d = 0 then 0 else (case when v = r then (g - b) / d when v = g then (b - r) / d + 2 else (r - g) / d + 4 end) / 6 end as h0 from h), hh as (select *, h0 - floor(h0) as h from hs)"""


@query("rgb_hsv", f"with {PX}, {HSV} select {KEYS}, round(h, 7)::double as h, round(s, 7)::double as s, round(v, 7)::double as v, round(r, 7) + 0.0 as back_r, round(b, 7) + 0.0 as back_b from hh")
def rgb_hsv(spark, sf):
    h, s, v = c.rgb_to_hsv(c.rgb())
    d = px(spark, sf).withColumns({"h": h, "s": s, "v": v})
    back = c.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return d.select(*KEY, *[F.round(n, 7).alias(n) for n in "hsv"], F.round(back.r, 7).alias("back_r"), F.round(back.b, 7).alias("back_b"))


@query("effective_grade", f"""with w as ({fx.CLIPS_SQL}) select clip_id, case when project_id % 2 = 0 then least(greatest(clip_id % 80 - 40 + 20.0, -50), 50) else clip_id % 80 - 40 end::double as exposure, (clip_id % 7)::double as contrast,
 case when project_id % 2 = 0 then least(greatest(clip_id % 60 + 15.0, 0), 50) else clip_id % 60 end::double as sharpness from w""")
def effective_grade(spark, sf):
    i = F.col("clip_id")
    w = fx.clips(spark, sf).select("project_id", "clip_id", (i % 80 - 40).cast("double").alias("exposure"), (i % 7).cast("double").alias("contrast"), (i % 60).cast("double").alias("sharpness"))
    adj = w.select("project_id").distinct().select("project_id", (F.col("project_id") % 2 == 0).alias("enabled"), F.lit(20.0).alias("exposure"), F.lit(None).cast("double").alias("contrast"), F.lit(15.0).alias("sharpness"))
    return op.effective_grade(w, adj).drop("project_id")


def _lattice(spark):
    axis = spark.range(4)
    l = axis.select(F.col("id").alias("ir"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ig")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return l.select(F.lit(1).alias("lut_id"), F.lit(4).alias("size"), "ir", "ig", "ib", (F.col("ir") / 3 * F.col("ir") / 3).alias("r"), (F.col("ig") / 3).alias("g"), (F.lit(1.0) - F.col("ib") / 3).alias("b"))


def _knot(q):
    f = f"least(greatest({q} * 3, 0), 3)"
    return f"(floor({f}) * floor({f}) / 9 + ({f} - floor({f})) * (power(least(floor({f}) + 1, 3), 2) - power(floor({f}), 2)) / 9)"


@query("sample_lut", f"with {PX}, u as (select distinct frame_id, x, y, r, g, b from p) select frame_id, x, y, round(r, 6) + 0.0 as r0, round(b, 6) + 0.0 as b0, round(g, 6) + 0.0 as g0, round(r + ({_knot('r')} - r) * 0.7, 6)::double as r, round(g, 6)::double + 0.0 as g, round(b + (1 - b - b) * 0.7, 6)::double + 0.0 as b from u")
def sample_lut(spark, sf):
    u = px(spark, sf).select("frame_id", "x", "y", "r", "g", "b").distinct().withColumns({"lut_id": F.lit(1), "intensity": F.lit(0.7), "r0": F.col("r"), "g0": F.col("g"), "b0": F.col("b")})
    out = op.apply_lut(u, _lattice(spark), ["frame_id", "x", "y", "r0", "g0", "b0"])
    return out.select("frame_id", "x", "y", *[F.round(q, 6).alias(q) for q in ("r0", "b0", "g0", "r", "g", "b")])


MODES = ["normal", "multiply", "screen", "overlay", "softLight", "darken", "lighten", "colorDodge"]


def blend_sql(m, b, s):
    soft = f"(case when {b} <= 0.25 then ((16 * {b} - 12) * {b} + 4) * {b} else sqrt({b}) end)"
    return f"""(case {m} when 1 then {b} * {s} when 2 then {b} + {s} - {b} * {s} when 3 then case when {b} <= 0.5 then 2 * {b} * {s} else (2 * {b} - 1) + {s} - (2 * {b} - 1) * {s} end
 when 4 then case when {s} <= 0.5 then {b} - (1 - 2 * {s}) * {b} * (1 - {b}) else {b} + (2 * {s} - 1) * ({soft} - {b}) end when 5 then least({b}, {s}) when 6 then greatest({b}, {s})
 when 7 then case when {b} <= 0 then 0 when {s} >= 1 then 1 else least(1, {b} / nullif(1 - {s}, 0)) end else {s} end)"""


@query("blend_modes", f"with {PX} select {KEYS}, " + ", ".join(f"round({blend_sql(i, 'r', 'b')}, 7)::double + 0.0 as {m}" for i, m in enumerate(MODES)) + " from (select * replace (least(1, r) as r, least(1, b) as b) from p)")
def blend_modes(spark, sf):
    return px(spark, sf).select(*KEY, *[F.round(c.blend_channel(F.lit(m), F.least(F.lit(1.0), "r"), F.least(F.lit(1.0), "b")), 7).alias(m) for m in MODES])


ALPHA = "((l_suppkey % 9) / 8.0::double)"


@query("composite_layers", f"""with recursive {PX.replace('row_number() over ()', "row_number() over (partition by frame_id, x order by l_partkey, l_suppkey, r, g, b)")}, q as (select *, l_partkey % 8 as m, {ALPHA} as al from p),
 f as (select frame_id, x, rn, al * {blend_sql('m', '0.0::double', 'r')} as r, al * {blend_sql('m', '0.0::double', 'b')} as b from q where rn = 1
  union all select q.frame_id, q.x, q.rn, f.r + ({blend_sql('q.m', 'f.r', 'q.r')} - f.r) * q.al, f.b + ({blend_sql('q.m', 'f.b', 'q.b')} - f.b) * q.al from f join q on q.frame_id = f.frame_id and q.x = f.x and q.rn = f.rn + 1)
 select frame_id, x, round(r + 1.23e-9, 7)::double + 0.0 as r, round(b + 1.23e-9, 7)::double + 0.0 as b from f qualify row_number() over (partition by frame_id, x order by rn desc) = 1""")
def composite_layers(spark, sf):
    d = px(spark, sf)
    names = F.array(*[F.lit(m) for m in MODES])
    layers = d.select("frame_id", "x", F.struct("l_partkey", "l_suppkey", "r", "g", "b").alias("layer"), F.get(names, (F.col("l_partkey") % 8).cast("int")).alias("mode"), ((F.col("l_suppkey") % 9) / 8.0).alias("alpha"), "r", "g", "b")
    # the tiny shift moves exact decimal ties apart, which engines round differently
    return op.composite_layers(layers, ["frame_id", "x"]).select("frame_id", "x", F.round(F.col("r") + 1.23e-9, 7).alias("r"), F.round(F.col("b") + 1.23e-9, 7).alias("b"))


@query("mask_weight", f"""with {PX}, q as (select *, least(1, r) as u, least(1, b) as v from p)
 select {KEYS}, round(1 - {ss(0, 0.1, 'greatest(abs(u - 0.5) - 0.25, abs(v - 0.5) - 0.25)')}, 6)::double as rect, round({ss(0, 0.2, 'sqrt(power((u - 0.5) / 0.25, 2) + power((v - 0.5) / 0.25, 2)) - 1')}, 6)::double as hole, round(1 - {ss(0, 0.1, 'u - 0.25')}, 6)::double as split_ from q""")
def mask_weight(spark, sf):
    u, v, l = F.least(F.lit(1.0), "r"), F.least(F.lit(1.0), "b"), F.lit
    m = lambda shape, inv: F.round(c.mask_weight(l(shape), l(0.25), l(0.25), l(0.5), l(0.5), l(0.1), l(inv), u, v), 6)
    return px(spark, sf).select(*KEY, m("rectangle", False).alias("rect"), m("circle", True).alias("hole"), m("split", False).alias("split_"))


@query("colour_histogram", f"with {PX}, {HSV}, c as (select frame_id // 100 as shot_id, least(floor(h * 32), 31)::bigint as h_bin, least(floor(s * 16), 15)::bigint as s_bin, count(*) as n from hh group by 1, 2, 3) select shot_id, h_bin, s_bin, round(n / sqrt(sum(n * n) over (partition by shot_id)), 7) as value from c")
def colour_histogram(spark, sf):
    d = px(spark, sf).withColumn("shot_id", F.floor(F.col("frame_id") / 100))
    return op.colour_histogram(d, ["shot_id"]).withColumn("value", F.round("value", 7))


@query("is_hard_cut", f"""with p0 as ({fx.PIXELS_SQL}), p as (select frame_id // 50 as pair, side, x, y, max(r) as r, max(g) as g, max(b) as b from p0 group by 1, 2, 3, 4), {HSV},
 n as (select pair, side, least(floor(h * 32), 31) * 16 + least(floor(s * 16), 15) as bin, count(*) as n from hh group by 1, 2, 3), v as (select *, n / sqrt(sum(n * n) over (partition by pair, side)) as v from n),
 j as (select coalesce(a.pair, b.pair) as pair, coalesce(a.v, 0) as x, coalesce(b.v, 0) as y from (select * from v where side = 0) a full join (select * from v where side = 1) b on a.pair = b.pair and a.bin = b.bin),
 s as (select pair, greatest(0, least(1, (sum(x * y) - sum(x) * sum(y) / 512) / sqrt((sum(x * x) - sum(x) * sum(x) / 512) * (sum(y * y) - sum(y) * sum(y) / 512)))) as sim from j group by 1),
 d as (select a.pair, avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3) * 255 as md from p a join p b on a.pair = b.pair and a.side = 0 and b.side = 1 and a.x = b.x and a.y = b.y group by 1)
 select pair, round(md, 5) as mean_diff, round(sim, 5) as similarity, md > 35 or sim < 0.8 as hard_cut from d join s using (pair)""")
def is_hard_cut(spark, sf):
    d = px(spark, sf).groupBy(F.floor(F.col("frame_id") / 50).alias("pair"), "side", "x", "y").agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"))
    out = op.is_hard_cut(d.filter("side = 0"), d.filter("side = 1"), ["pair"])
    return out.select("pair", F.round("mean_diff", 5).alias("mean_diff"), F.round("similarity", 5).alias("similarity"), "hard_cut")


@query("eval_curve", f"with {PX} select {KEYS}, round(least(1, r), 6)::double + 0.0 as line, round(least(1, b) * least(1, b) * (3 - 2 * least(1, b)), 6)::double as smooth from p")
def eval_curve(spark, sf):
    pts = lambda *p: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p])
    # a straight line stays straight; (0,0),(1,1) with flat tangents is the smooth step
    flat = F.array(*[F.struct(F.lit(v).alias("x"), F.lit(v).alias("y"), F.lit(0.0).alias("m")) for v in (0.0, 1.0)])
    u = F.least(F.lit(1.0), "b")
    return px(spark, sf).select(*KEY, F.round(c.eval_curve(pts((0, 0), (0.3, 0.3), (1, 1)), F.least(F.lit(1.0), "r")), 6).alias("line"), F.round(c.hermite_at(flat, u, 0.0, 1.0), 6).alias("smooth"))


@query("grade_hsl")
def grade_hsl(spark, sf):
    one = lambda h, s, l: F.struct(F.lit(h).alias("h"), F.lit(s).alias("s"), F.lit(l).alias("l"))
    hsl = F.create_map(F.lit("red"), one(-24.0, 17.0, 0.0), F.lit("blue"), one(0.0, 17.0, -6.0), F.lit("green"), one(-33.0, 50.0, 0.0))
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    g = grade(exposure=0, brightness=0, contrast=0, highlights=0, shadows=0, brilliance=0, temperature=0, tint=0, saturation=0, vibrance=0, lift=vec(-0.03, 0.01, 0.06), gain=vec(0.06, 0.02, -0.05), offset=vec(0, 0, 0), gamma=vec(0.1, 0, -0.1), hsl=hsl)
    return c.grade_pixels(px(spark, sf).withColumn("grade", g), hsl=True, wheels=True).select(*KEY, "r", "g", "b")


@query("patch_descriptor")
def patch_descriptor(spark, sf):
    d = px(spark, sf).groupBy(F.floor(F.col("frame_id") / 64).alias("patch"), (F.col("frame_id") % 8).alias("x"), "y").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"))
    return op.patch_descriptor(d, ["patch"], 8)
