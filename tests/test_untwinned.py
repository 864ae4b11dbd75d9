"""Brute force for queries whose rules SQL twins don't cover, and a list of where each of them is tested."""

import math

import numpy as np

from mediaframe import catalog
from mediaframe.functions import presets
from mediaframe.operators import camera, color, speed, tracking

#: Queries without SQL and the test that compares their rows.
TESTED = {
    "onset_envelope": "test_golden", "track_beats": "test_golden", "byte_track": "test_golden", "byte_track_stream": "test_sources", "assign": "test_untwinned", "follow_pairs": "test_golden",
    "choose_scheme": "test_untwinned", "solve_crops": "test_crops", "clamp_crops": "test_crops", "reframe_from_tracks": "test_crops", "reframe_from_findings": "test_crops", "assign_lineup": "test_crops",
    "split_by_side": "test_untwinned", "appearance_ema": "test_untwinned", "patch_descriptor": "test_untwinned", "speed_ramp_times": "test_untwinned", "grade_hsl": "test_grade", "split_ramped": "test_ramps", "audio_schedule_ramped": "test_ramps",
}


def test_every_query_has_a_twin_or_a_test():
    catalog.load()
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(TESTED)


def test_split_by_side(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for asset in range(6):
        sides = [("left", "right")[int(v)] for v in np.repeat(rng.integers(0, 2, 40), rng.integers(1, 6, 40))]
        hold = 3
        held = max(sides[:hold], key=lambda s: (sides[:hold].count(s), s))
        for f, side in enumerate(sides):
            if len(set(sides[f : f + hold])) == 1 and f + hold <= len(sides):
                held = side
            rows.append((asset, f, side))
            want[asset, f] = held
    got = camera.split_by_side(spark.createDataFrame(rows, "asset_id bigint, frame bigint, side string"), 3).collect()
    assert {(r.asset_id, r.frame): r.held for r in got} == want


def test_appearance_ema(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for track in range(3):
        prev = None
        for f in range(30):
            e = rng.normal(size=8)
            rows.append((1, track, f, e.tolist()))
            v = e if prev is None else 0.8 * prev + 0.2 * e
            prev = v if prev is None else v / (np.linalg.norm(v) + 1e-9)
            want[track, f] = prev
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(t), int(f), e) for a, t, f, e in rows], "asset_id bigint, track_id bigint, frame bigint, embedding array<double>")
    got = tracking.appearance_ema(df, 0.8).collect()
    assert len(got) == 90 and all(np.allclose(r.embedding, want[r.track_id, r.frame]) for r in got)


def test_patch_descriptor(spark):
    import colorsys

    rng, n = np.random.default_rng(5), 8
    px = rng.random((n, n, 3))
    rows = [(0, x, y, *map(float, px[y, x])) for y in range(n) for x in range(n)]
    got = np.zeros(256 + 36)
    for r in color.patch_descriptor(spark.createDataFrame(rows, "patch bigint, x bigint, y bigint, r double, g double, b double"), ["patch"], n).collect():
        got[r.slot] = r.value
    want = np.zeros(256 + 36)
    for y in range(n):
        for x in range(n):
            h, s, v = colorsys.rgb_to_hsv(*px[y, x])
            want[min(int(h * 8), 7) * 32 + min(int(s * 8), 7) * 4 + min(int(v * 4), 3)] += 1 / n**2
    grey = np.pad(px @ [0.299, 0.587, 0.114], 1, mode="reflect")
    dirs = np.zeros((4, 9))
    for y in range(n):
        for x in range(n):
            w = grey[y : y + 3, x : x + 3]
            gx = (w[:, 2] - w[:, 0]) @ [1, 2, 1]
            gy = (w[2] - w[0]) @ [1, 2, 1]
            dirs[(y >= n // 2) * 2 + (x >= n // 2), min(int((math.atan2(gy, gx) + math.pi) / (2 * math.pi) * 9), 8)] += math.hypot(gx, gy)
    want[256:] = (dirs / (dirs.sum(axis=1, keepdims=True) + 1e-9) * 0.5).ravel()
    assert np.allclose(got, want / np.linalg.norm(want), atol=1e-9)


def test_ramp_times_invert_each_other(spark):
    curves = presets.speed_presets(spark).withColumnRenamed("preset", "curve_id")
    lut = speed.speed_lut(curves, 256)
    rows = [(name, 4000.0, float(o)) for name in presets.SPEED for o in range(0, 4001, 250)]
    df = spark.createDataFrame(rows, "curve_id string, source_ms double, offset_ms double")
    out = speed.source_to_output(df, lut)
    back = speed.output_to_source(out.withColumnRenamed("offset_ms", "was").withColumnRenamed("output_ms", "play_ms"), lut)
    name = next(c for c in back.columns if c not in ("curve_id", "source_ms", "was", "play_ms"))
    got = back.collect()
    assert len(got) == len(rows) and all(abs(r[name] - r["was"]) < 0.5 for r in got)
    last = {}
    for r in out.orderBy("curve_id", "offset_ms").collect():
        assert r.output_ms >= last.get(r.curve_id, 0.0)
        last[r.curve_id] = r.output_ms


def test_choose_scheme(spark):
    from mediaframe.operators import ordering

    folders = {
        "marked": (["scene1.mp4", "scene2.mp4", "intro.mp4"], "markers", 0),
        "mostly": (["01 a.mp4", "02 b.mp4", "c.mp4"], "leading", 1),
        "dates": (["2024-01-02.mp4", "2024-02-03.mp4"], "timestamp", 0),
        "plain": (["a.mp4", "b.mp4", "c 1.mp4"], "natural", 0),
        "ordinals": (["first.mp4", "second.mp4"], "ordinal", 0),
    }
    df = spark.createDataFrame([(f, n, n) for f, (names, _, _) in folders.items() for n in names], "folder string, path string, name string")
    got = {r.folder: (r.scheme, r.missing) for r in ordering.choose_scheme(ordering.parse_names(df)).collect()}
    assert got == {f: (s, m) for f, (_, s, m) in folders.items()}


def test_assign_by_brute_force(spark):
    rng, rows, want = np.random.default_rng(9), [], {}
    for frame in range(40):
        pairs = {(int(r), int(c)): float(np.round(rng.random(), 3)) for r, c in rng.integers(0, 5, (int(rng.integers(1, 9)), 2))}
        rows += [(frame, r, c, cost) for (r, c), cost in pairs.items()]
        usable = [(p, cost) for p, cost in pairs.items() if cost <= 0.8]

        def best(i, used_r, used_c):
            if i == len(usable):
                return 0.0
            (r, c), cost = usable[i]
            skip = best(i + 1, used_r, used_c)
            return skip if r in used_r or c in used_c else min(skip, cost - 1.8 + best(i + 1, used_r | {r}, used_c | {c}))

        want[frame] = best(0, frozenset(), frozenset())
    got, cost = {}, {(f, r, c): x for f, r, c, x in rows}
    for r in tracking.assign(spark.createDataFrame(rows, "frame_id bigint, row_id bigint, col_id bigint, cost double"), 0.8).collect():
        got.setdefault(r.frame_id, []).append((r.row_id, r.col_id))
    for frame in range(40):
        pairs = got.get(frame, [])
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert abs(sum(cost[frame, r, c] - 1.8 for r, c in pairs) - want[frame]) < 1e-9
