"""Plan helpers against plain windows and brute force, including one hot key."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from mediaframe.functions import geometry as g
from mediaframe.plans import scan
from mediaframe.plans.blocks import ema
from mediaframe.plans.joins import bracket_join, range_join
from mediaframe.plans.quantile import exact_quantile, top_k
from mediaframe.plans.tiles import tiled_self_join


def hot(spark, n=3000):
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else rng.randrange(40), i, rng.randrange(10_000), rng.choice([None, rng.randrange(50)])) for i in range(n)]
    return spark.createDataFrame(rows, "k bigint, id bigint, t bigint, v bigint")


def test_ordered_scan_equals_windows(spark):
    df = hot(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.row_number().over(w).alias("a"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("b"), F.max("v").over(upto).alias("c"), F.last("v", True).over(upto).alias("d"),
                     F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("e"), F.lag("v").over(w).alias("f"), F.lead("v").over(w).alias("g"), F.count("*").over(Window.partitionBy("k")).alias("h"))
    v = F.col("v")
    got = scan.ordered_scan(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 97), a=scan.number(), b=scan.running_sum(v), c=scan.running_max(v), d=scan.last(v), e=scan.following(v), f=scan.lag(v), g=scan.lead(v), h=scan.total(F.lit(1)))
    assert sorted(map(tuple, got.select("id", *"abcdefgh").collect())) == sorted(map(tuple, want.collect()))


def test_halo_window(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("i"))
    w = Window.partitionBy("k", "_block").orderBy("i").rowsBetween(-3, 2)
    got = scan.halo(df, "i", 64, 3, 2).withColumn("s", F.sum("i").over(w)).filter("_own").orderBy("i").collect()
    assert len(got) == 1000
    assert all(r.s == sum(range(max(0, r.i - 3), min(1000, r.i + 3))) for r in got)


def test_range_and_bracket_joins(spark):
    rng = random.Random(2)
    pts = [(rng.randrange(3), i, rng.randrange(2000)) for i in range(400)]
    spans = [(rng.randrange(3), j, s := rng.randrange(2000), s + rng.randrange(300)) for j in range(60)]
    p = spark.createDataFrame(pts, "k bigint, id bigint, t bigint")
    s = spark.createDataFrame(spans, "k bigint, j bigint, a bigint, b bigint")
    want = sorted((i, j) for k, i, t in pts for q, j, a, b in spans if k == q and a <= t < b)
    assert sorted(map(tuple, range_join(p, s, ["k"], "t", "a", "b", 100).select("id", "j").collect())) == want
    got = {r.id: (r.lo and r.lo.j, r.hi and r.hi.j) for r in bracket_join(p, s.groupBy("k", "a").agg(F.min("j").alias("j")), ["k"], "t", "a", ["j"], 50).collect()}
    for k, i, t in pts:
        mine = {}
        for q, j, a, _ in spans:
            if q == k:
                mine[a] = min(j, mine.get(a, j))
        lo, hi = [a for a in mine if a <= t], [a for a in mine if a > t]
        assert got[i] == (mine[max(lo)] if lo else None, mine[min(hi)] if hi else None)


def test_tiled_self_join_splits_hot_groups(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 100, (300, 2))
    df = spark.createDataFrame([(0 if i < 200 else i % 7, i, float(x), float(y), float(x) + 12, float(y) + 12) for i, (x, y) in enumerate(xy)], "k bigint, id bigint, x1 double, y1 double, x2 double, y2 double")
    cond = g.intersects(g.box("a_"), g.box("b_"))
    pairs = lambda rows: sorted(map(tuple, tiled_self_join(df, ["k"], "id", cond, rows).select("a_id", "b_id").collect()))
    rows = df.collect()
    want = sorted((a.id, b.id) for a in rows for b in rows if a.k == b.k and a.id < b.id and a.x1 < b.x2 and a.x2 > b.x1 and a.y1 < b.y2 and a.y2 > b.y1)
    assert pairs(16) == want and pairs(10_000) == want


def test_exact_quantile_and_top_k(spark):
    df = hot(spark).filter("v is not null")
    got = {r.k: r.q for r in exact_quantile(df, ["k"], "v", {"q": 0.6}, 7).collect()}
    rows = df.collect()
    for k in got:
        assert abs(got[k] - np.quantile([r.v for r in rows if r.k == k], 0.6)) < 1e-9
    best = top_k(df.select("k", "id", "t", F.lit(3).alias("n")), ["k"], [F.col("t").desc(), F.col("id")], F.col("n")).collect()
    assert sorted((r.k, r.id) for r in best) == sorted((k, r.id) for k in got for r in sorted((x for x in rows if x.k == k), key=lambda x: (-x.t, x.id))[:3])


def test_ema_over_block_borders(spark):
    x = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k bigint, i bigint, v double")
    want, acc = [], x[0]
    for v in x:
        acc = 0.3 * v + 0.7 * acc
        want.append(acc)
    for size in (64, 8192):
        got = [r.v for r in ema(df, ["k"], "i", ["v"], 0.3, size).orderBy("i").collect()]
        assert np.allclose(got, want)
