"""Ramped clips against a numeric integral of their speed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import edits, ramps, speed

CLIP = "project_id long, track_index long, clip_id long, asset_id long, kind string, locked boolean, link_id long, start_ms double, dur_ms double, in_ms double, out_ms double, factor double, freeze_at double, freeze_hold double, reversed boolean, fade_in_ms double, fade_out_ms double, transition_type string, speed array<struct<x:double,y:double>>"
HERO = [(0.0, 2.0), (0.35, 2.0), (0.5, 0.4), (0.65, 2.0), (1.0, 1.0)]
BULLET = [(0.0, 5.0), (0.4, 0.5), (0.6, 0.5), (1.0, 5.0)]


def clip(i, start, points, track=0, at=None, hold=None, rev=False, length=6000.0):
    return (1, track, i, 7, "video", False, None, start, 0.0 if points else length + (hold or 0), 1000.0, 1000.0 + length, 1.0, at, hold, rev, 100.0, 200.0, "dissolve", points)


@pytest.fixture(scope="module")
def clips(spark):
    rows = [clip(1, 0.0, HERO), clip(2, 0.0, BULLET, track=1, rev=True), clip(3, 0.0, HERO, track=2, at=900.0, hold=500.0), clip(4, 0.0, None, track=3), clip(5, 20000.0, None)]
    return ramps.with_factor(spark.createDataFrame(rows, CLIP)).cache()


@pytest.fixture(scope="module")
def curves(spark):
    """Finely integrated output time and source position of each curve."""
    u = np.linspace(0, 1, 40_001)
    found = {}
    for name, points in (("hero", HERO), ("bullet", BULLET)):
        df = spark.createDataFrame([(points, float(x)) for x in u], "points array<struct<x:double,y:double>>, u double")
        y = np.array([r.y for r in df.select(speed.speed_at(speed.monotone_tangents(speed.normalise(F.col("points"))), F.col("u")).alias("y")).collect()])
        found[name] = (u, np.concatenate(([0], np.cumsum((1 / y[1:] + 1 / y[:-1]) / 2 * np.diff(u)))))
    return found


def by_id(df, key="clip_id"):
    return {r[key]: r for r in df.collect()}


def test_lengths_and_time_map(clips, curves):
    rows = by_id(clips)
    assert abs(rows[1].dur_ms - 6000 * curves["hero"][1][-1]) < 1 and abs(rows[2].dur_ms - 6000 * curves["bullet"][1][-1]) < 1
    assert rows[4].dur_ms == 6000
    times = clips.withColumn("local", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: k / 40 * F.col("dur_ms"))))
    for r in ramps.source_at(times).collect():
        play = r.local if r.freeze_at is None or r.local <= r.freeze_at else max(r.freeze_at, r.local - r.freeze_hold)
        if r.speed is None:
            off = play
        else:
            u, cum = curves["bullet" if r.clip_id == 2 else "hero"]
            off = 6000 * np.interp(play / 6000, cum, u)
        assert abs(r.source_ms - (7000 - off if r.reversed else 1000 + off)) < 1


def test_split_meets_on_one_source_time(spark, clips, curves):
    rows = by_id(clips)
    at = {i: rows[i].dur_ms * 0.4 for i in (1, 2, 3, 4)}
    halves = ramps.split(clips, spark.createDataFrame([(1, i, t) for i, t in at.items()], "project_id long, clip_id long, at_ms double")).cache()
    left, right = by_id(halves.filter("half = 'left'")), by_id(halves.filter("half = 'right'"))
    shown = by_id(ramps.source_at(clips.filter("clip_id < 5").withColumn("local", F.col("dur_ms") * 0.4)))
    assert set(left) == set(right) == set(at) and halves.count() == 9
    for i, t in at.items():
        meet = shown[i].source_ms
        ends = (left[i].in_ms, right[i].out_ms) if rows[i].reversed else (left[i].out_ms, right[i].in_ms)
        assert all(abs(e - meet) < 1 for e in ends)
        assert abs(left[i].dur_ms - t) < 1 and abs(left[i].dur_ms + right[i].dur_ms - rows[i].dur_ms) < 1
        assert right[i].start_ms == t and right[i].transition_type is None
    first = by_id(ramps.source_at(halves.filter("half = 'right'").withColumn("local", F.lit(0.0))))
    assert all(abs(first[i].source_ms - shown[i].source_ms) < 1 for i in at)


def test_split_without_ramps_is_the_plain_one(spark, clips):
    cut = spark.createDataFrame([(1, 4, 2500.0)], "project_id long, clip_id long, at_ms double")
    plain = clips.filter("clip_id >= 4")
    a, b = ({(r.clip_id, r.half): r for r in f(plain, cut).collect()} for f in (edits.split, ramps.split))
    assert a == b


def test_set_speed_keeps_freeze_and_ripples(spark, clips, curves):
    change = spark.createDataFrame([(1, 1, BULLET), (1, 3, BULLET)], "project_id long, clip_id long, points array<struct<x:double,y:double>>")
    sped = ramps.set_speed(clips, change).cache()
    before, after = by_id(clips), by_id(sped)
    u, cum = curves["hero"]
    bu, bcum = curves["bullet"]
    source = np.interp(900 / 6000, cum, u)
    assert abs(after[3].freeze_at - 6000 * np.interp(source, bu, bcum)) < 1 and after[3].freeze_hold == 500
    assert abs(after[1].dur_ms - 6000 * bcum[-1]) < 1
    assert abs(after[5].start_ms - (20000 + after[1].dur_ms - before[1].dur_ms)) < 1e-6
    assert {i: after[i] for i in (2, 4)} == {i: before[i] for i in (2, 4)}
    keys = spark.createDataFrame([(1, 1, 1000.0), (1, 3, 500.0), (1, 3, 1100.0), (1, 3, 2000.0), (1, 4, 10.0)], "project_id long, clip_id long, time_ms double")
    moved = sorted((r.clip_id, r.time_ms) for r in ramps.retime_keyframes(keys, clips, sped).collect())
    to = lambda t: 6000 * np.interp(np.interp(t / 6000, cum, u), bu, bcum)
    want = [(1, to(1000)), (3, to(500)), (3, after[3].freeze_at + 200), (3, to(1500) + 500), (4, 10.0)]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1 for a, b in zip(moved, want))


def test_audio_windows_follow_the_ramp(clips, curves):
    got = by_id(ramps.audio_schedule(clips.filter("clip_id <= 4"), 500.0, 2500.0, 48_000))
    for i, r in got.items():
        t0, t1 = (r.i0 / 48 + 500, r.i1 / 48 + 500)
        play = [t if r.freeze_at is None or t <= r.freeze_at else max(r.freeze_at, t - r.freeze_hold) for t in (t0, min(t1, r.dur_ms))]
        if r.speed is not None:
            u, cum = curves["bullet" if i == 2 else "hero"]
            play = [6000 * np.interp(p / 6000, cum, u) for p in play]
        a, b = sorted(7000 - p if r.reversed else 1000 + p for p in play)
        assert abs(r.w0 - max(a - 20, 1000)) < 1 and abs(r.w1 - min(b + 20, 7000)) < 1
    assert set(got) == {1, 2, 3, 4}


def test_batch_lookups_equal_the_joined_tables(spark):
    """Many clips, each with a curve of its own: the columns give what the tables per curve give, and no row moves."""
    rng = np.random.default_rng(3)
    own = lambda n: [(float(x), float(y)) for x, y in zip(rng.uniform(-0.1, 1.1, n), rng.uniform(0.05, 11, n))]
    rows = [(i, own(int(rng.integers(2, 80))), 5000.0, float(rng.uniform(-100, 9000)), float(rng.uniform(-100, 6000))) for i in range(60)] + [(60, [(0.0, 2.0), (0.0, 1.0), (1.0, 3.0)], 5000.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "curve_id long, points array<struct<x:double,y:double>>, source_ms double, play_ms double, offset_ms double")
    lut = speed.speed_lut(df.select("curve_id", "points"), 64).cache()
    p = F.col("points")
    got = df.select("curve_id", speed.curve_factor(p, 64).alias("f"), (speed.curve_source(p, F.col("play_ms") / 5000, 64) * 5000).alias("s"), (speed.curve_output(p, F.col("offset_ms") / 5000, 64) * 5000).alias("o"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    factor, source, output = (by_id(x, "curve_id") for x in (speed.speed_factor(lut), speed.output_to_source(df.drop("offset_ms"), lut), speed.source_to_output(df.drop("play_ms"), lut)))
    for r in got.collect():
        i = r.curve_id
        assert abs(r.f - factor[i].factor) < 1e-9 and abs(r.s - source[i].offset_ms) < 1e-6 and abs(r.o - output[i].output_ms) < 1e-6
