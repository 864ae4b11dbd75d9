"""Hand values and brute-force checks of the operators that have no SQL twin."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions import color as c
from mediaframe.functions import geometry as g
from mediaframe.functions import playback as pb
from mediaframe.functions import presets, rates
from mediaframe.functions.noise import pcg
from mediaframe.operators import assembly, audio, camera, crops, ordering, shots, speed, tracking

L = F.lit


def one(spark, *cols):
    return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first())


def box(*v):
    return g.Box(*[L(float(x)) for x in v])


def test_iou_and_noise(spark):
    a, p0, p1 = one(spark, g.iou(box(0, 0, 10, 10), box(5, 5, 15, 15)), pcg(L(0)), pcg(L(1)))
    assert abs(a - 25 / 175) < 1e-12 and (p0, p1) == (129708002, 2831084092)


def test_blend_and_mask(spark):
    v = one(spark, c.blend_channel(L("overlay"), L(.25), L(.5)), c.blend_channel(L("overlay"), L(.75), L(.5)), c.blend_channel(L("softLight"), L(.5), L(0.0)), c.blend_channel(L("colorDodge"), L(.6), L(.5)),
            c.mask_weight(L("rectangle"), L(.25), L(.25), L(.5), L(.5), L(.1), L(False), L(.8), L(.5)))
    assert np.allclose(v, (.25, .75, .25, 1, .5))


def test_time_map(spark):
    at = lambda t, rev=False: pb.source_at(L(float(t)), L(0.0), L(2000.0), L(1.0), L(None if rev else 500.0).cast("double"), L(None if rev else 1000.0).cast("double"), L(rev))
    a, b, r = one(spark, at(700), at(1600), at(0, True))
    assert (a.source_ms, a.frozen, b.source_ms, r.source_ms) == (500, True, 600, 2000)
    ext = lambda t: pb.source_extended(L(float(t)), L(1000.0), L(3000.0), L(1.0), L(None).cast("double"), L(None).cast("double"), L(False), L(10000.0))["source_ms"]
    assert one(spark, ext(2200), ext(-300)) == (3200, 700)


def test_transition_progress(spark):
    assert np.allclose(one(spark, *[pb.transition_progress((L(float(t)) - 750) / 500) for t in (750, 1000, 1250)]), (0, .5, 1), atol=1e-6)


@pytest.mark.parametrize("durations,target,want", [([2000, 5000, 9000], 12000, [2000, 5000, 5000]), ([2000, 5000, 9000], 8000, [2000, 3000, 3000]), ([3000] * 4, 4000, [2000, 2000, 0, 0]), ([800, 800], 1000, [800, 0])])
def test_fit_durations(spark, durations, target, want):
    s = spark.createDataFrame([(1, i, d, 0.0) for i, d in enumerate(durations)], "group_id bigint, pos bigint, dur_ms bigint, value double")
    t = spark.createDataFrame([(1, target)], "group_id bigint, target_ms bigint")
    assert [r.fitted_ms for r in assembly.fit_durations(s, t).orderBy("pos").collect()] == want


@pytest.mark.parametrize("scores,want", [([0, 0, 1, 1, 0, 0], [(0, 2), (4, 5)]), ([1, 0, 0], [(1, 2)]), ([1, 1, 1], [(0, 2)]), ([0, 0, 1], [(0, 2)])])
def test_scene_edges(spark, scores, want):
    df = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "asset_id bigint, frame bigint, score double")
    assert [(r.start_frame, r.end_frame) for r in shots.scenes_from_scores(df).orderBy("scene").collect()] == want


NAMES = [
    ["clip1.mp4", "clip2.mp4", "clip10.mp4", "clip11.mp4"], ["Part I.mp4", "Part II.mp4", "Part IV.mp4", "Part V.mp4", "Part IX.mp4"], ["scene1_shot2.mp4", "scene1_shot10.mp4", "scene2_shot1.mp4"],
    ["01_intro.mp4", "02_kitchen.mp4", "10_end.mp4"], ["first take.mp4", "second take.mp4", "third take.mp4"], ["S01E02.mp4", "S01E10.mp4", "S02E01.mp4"], ["shot one.mp4", "shot two.mp4", "shot three.mp4"],
    ["clip04a.mp4", "clip04b.mp4", "clip05.mp4"], ["cam 2024-01-02.mp4", "cam 2024-01-10.mp4", "cam 2024-02-01.mp4"], ["intro.mp4", "clip1.mp4", "clip2.mp4", "outro.mp4"]]


def test_name_orders(spark):
    rows = [(str(k), n, n) for k, names in enumerate(NAMES) for n in reversed(names)]
    files, _ = ordering.order_names(spark.createDataFrame(rows, "folder string, path string, name string"))
    got = {}
    for r in files.orderBy("order").collect():
        got.setdefault(int(r.folder), []).append(r.name)
    assert [got[k] for k in range(len(NAMES))] == NAMES


def test_gap_warning(spark):
    df = spark.createDataFrame([("a", f"clip{i}.mp4", f"clip{i}.mp4") for i in (1, 2, 4)], "folder string, path string, name string")
    assert "numbering skips 3" in {r.warning for r in ordering.order_names(df)[1].collect()}


def test_rates(spark):
    r = one(spark, *[rates.parse_fps(L(t)) for t in ("29.97", "30000/1001", "23.976", "12.5", "60", "abc")])
    assert [x and (x.num, x.den) for x in r] == [(30000, 1001), (30000, 1001), (24000, 1001), (25, 2), (60, 1), None]


def test_speed_ramps(spark):
    flat = spark.createDataFrame([("c", [(0.0, 2.0), (1.0, 2.0)])], "curve_id string, points array<struct<x:double,y:double>>")
    assert abs(speed.speed_factor(speed.speed_lut(flat, 64)).first().factor - 0.5) < 1e-12
    lut = speed.speed_lut(presets.speed_presets(spark).withColumnRenamed("preset", "curve_id"), 256)
    f = {r.curve_id: r.factor for r in speed.speed_factor(lut).collect()}
    times = spark.createDataFrame([(k, 1000.0, 1000.0 * v * u) for k, v in f.items() for u in (0.0, 0.37, 1.0)], "curve_id string, source_ms double, play_ms double")
    back = speed.source_to_output(speed.output_to_source(times, lut), lut).collect()
    assert all(abs(r.output_ms - r.play_ms) < 1e-6 for r in back)
    pts = spark.range(1).select(F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in presets.SPEED["bullet"]]).alias("p"))
    part = pts.select(speed.slice_curve(F.col("p"), L(0.25), L(0.75)).alias("s")).first().s
    assert part[0].x == 0 and abs(part[-1].x - 1) < 1e-9 and min(q.y for q in part) == pytest.approx(0.15)


def test_optimal_pairs_match_brute_force():
    rng = np.random.default_rng(5)
    for n, m in [(3, 3), (2, 5), (5, 2), (4, 4)]:
        for _ in range(30):
            cost = rng.uniform(0, 1, (n, m))
            k = min(n, m)
            small = cost if n <= m else cost.T
            best = min(sum(small[i, p[i]] for i in range(k)) for p in itertools.permutations(range(max(n, m)), k))
            assert sum(cost[a, b] for a, b in tracking.optimal_pairs(cost, 2.0)) == pytest.approx(best)


def test_tracker_keeps_one_id():
    t = tracking.Tracker()
    ids = set()
    for f in range(40):
        dets = [] if f in (20, 21) else [(np.array([100 + 4 * f, 100, 200 + 4 * f, 300.0]), "a", 0.9 if f % 7 else 0.3)]
        ids |= {x.id for x in t.step(dets)}
    assert ids == {1}


def test_crops_avoid_duplicates():
    rng = np.random.default_rng(7)
    hit = lambda a, b: a[0] < b[2] - .01 and a[2] > b[0] + .01 and a[1] < b[3] - .01 and a[3] > b[1] + .01
    assert crops.solve_crop(1280, 720, (400, 100, 600, 600), []) == (0, 0, 1280, 720)
    for _ in range(40):
        px, dx = rng.uniform(50, 400), rng.uniform(700, 1000)
        d = (dx, rng.uniform(0, 300), dx + 150, rng.uniform(400, 720))
        crop = crops.solve_crop(1280, 720, (px, 100, px + 200, 600), [d])
        assert not hit(crop, d) and abs((crop[2] - crop[0]) / (crop[3] - crop[1]) - 16 / 9) < 1e-3
        assert crop[0] <= px + 100 <= crop[2]
        moved = crops.clamp_crop((0, 0, 1280, 720), [d], (px + 40, 100, px + 160, 250), 1280, 720)
        assert not hit(moved, d)


def test_onsets_and_tempo(spark):
    sr, n_fft, hop = 2000, 128, 32
    rng = np.random.default_rng(4)
    y = rng.normal(0, 0.01, sr * 6)
    for b in range(0, len(y), sr // 2):  # 120 bpm
        y[b:b + 40] += np.hanning(40)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(y)], "asset_id bigint, i bigint, value double")
    bands = audio.spectrum_bands(df, n_fft, hop, frames_per_block=50).orderBy("frame").collect()
    pad = np.pad(y, n_fft // 2, mode="reflect")
    edges = audio.band_edges(n_fft // 2 + 1)
    assert [r.frame for r in bands] == list(range(1 + len(y) // hop))
    for r in bands[::7]:
        mag = np.abs(np.fft.rfft(pad[r.frame * hop:r.frame * hop + n_fft] * np.hanning(n_fft)))
        assert np.allclose(r.bands, [mag[a:b].mean() for a, b in zip(edges[:-1], edges[1:])])
    env = audio.onset_envelope(df, sr, n_fft, hop).cache()
    t = audio.tempo(env, sr / hop).first()
    assert abs(t.bpm - 120) < 2 and t.periodicity > 0.25
    beats = audio.track_beats(env, spark.createDataFrame([(1, float(t.bpm))], "asset_id bigint, bpm double"), sr / hop).collect()
    gaps = np.diff(sorted(b.position for b in beats))
    assert len(beats) >= 10 and abs(np.median(gaps) - sr / hop / 2) < 1


def test_split_by_side_needs_persistence(spark):
    s = "llllrlllrrrrll"
    df = spark.createDataFrame([(1, i, {"l": "left", "r": "right"}[x]) for i, x in enumerate(s)], "asset_id bigint, frame bigint, side string")
    held = "".join(r.held[0] for r in camera.split_by_side(df, 3).orderBy("frame").collect())
    assert held == "llllllllrrrrrr"


def test_follow_pair_holds_and_recovers(spark):
    row = lambda f, det, x, e: (1, f, det, float(x), 100.0, float(x) + 100, 400.0, e, False)
    rows = [row(f, 1, 200 + f, [1.0, 0.0]) for f in range(10)] + [row(f, 2, 800, [0.0, 1.0]) for f in range(10) if f not in (6, 7)]
    s = spark.createDataFrame(rows, "pair_id bigint, frame bigint, det bigint, x1 double, y1 double, x2 double, y2 double, emb array<double>, veto boolean")
    names = [f"{p}_{n}" for p in "pd" for n in ("x1", "y1", "x2", "y2")]
    a = spark.createDataFrame([(1, 3, 203.0, 100.0, 303.0, 400.0, 800.0, 100.0, 900.0, 400.0, [1.0, 0.0], [0.0, 1.0])], "pair_id bigint, frame bigint, " + ", ".join(f"{n} double" for n in names) + ", p_emb array<double>, d_emb array<double>")
    out = tracking.follow_pairs(s, a, 1280, 720, hold=2).orderBy("frame").collect()
    assert [r.frame for r in out] == list(range(10)) and all(r.duplicate is not None for r in out)
    assert [r.frame for r in out if r.held] == [6, 7] and out[9].primary[0] == 209.0


def test_follow_pair_states(spark):
    """Edge, hold, loss and the way back to the start, on one pair that is confirmed late."""
    row = lambda pair, f, det, x: (pair, f, det, float(x), 100.0, float(x) + 100, 400.0, [float(det == 1), float(det == 2)], False)
    empty = lambda pair, f: (pair, f, None, None, None, None, None, None, None)
    # pair 1: the duplicate is seen from frame 6 to 9; pair 2: the same at the frame's edge
    rows = [row(p, f, 1, 300) for p in (1, 2) for f in range(14)] + [row(p, f, 2, x) for p, x in ((1, 800), (2, 0)) for f in range(6, 10)] + [empty(3, 0), row(3, 1, 1, 300), row(3, 1, 2, 800), empty(3, 2)]
    s = spark.createDataFrame(rows, "pair_id bigint, frame bigint, det bigint, x1 double, y1 double, x2 double, y2 double, emb array<double>, veto boolean")
    names = [f"{p}_{n}" for p in "pd" for n in ("x1", "y1", "x2", "y2")]
    anchors = [(p, f, 300.0, 100.0, 400.0, 400.0, float(x), 100.0, x + 100.0, 400.0, [1.0, 0.0], [0.0, 1.0]) for p, f, x in ((1, 8, 800), (2, 8, 0), (3, 1, 800))]
    a = spark.createDataFrame(anchors, "pair_id bigint, frame bigint, " + ", ".join(f"{n} double" for n in names) + ", p_emb array<double>, d_emb array<double>")
    got = {(r.pair_id, r.frame): (r.duplicate is not None, r.held) for r in tracking.follow_pairs(s, a, 1280, 720, hold=2).collect()}
    seen, held, gone = (True, False), (True, True), (False, False)
    assert [got[1, f] for f in range(14)] == [held] * 6 + [seen] * 4 + [held] * 2 + [gone] * 2
    assert [got[2, f] for f in range(14)] == [gone] * 4 + [held] * 2 + [seen] * 4 + [held] * 2 + [gone] * 2
    assert [got[3, f] for f in range(3)] == [held, seen, held]
