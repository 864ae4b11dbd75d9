"""The render plan on small timelines whose frames can be listed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import render

CLIP = "project_id long, track_index long, clip_id long, kind string, track_muted boolean, start_ms long, dur_ms double, in_ms long, out_ms long, factor double, freeze_at long, freeze_hold long, reversed boolean, fade_in_ms int, fade_out_ms int, effect string, intensity double, source_len double"
CUT = "project_id long, track_index long, clip_id long, prev_id long, cut_ms long, type string, dur_ms long"
GRID = render.Grid(10.0)


def clip(i, start, dur, kind="video", track=0, effect=None, **kw):
    row = dict(project_id=1, track_index=track, clip_id=i, kind=kind, track_muted=False, start_ms=start, dur_ms=float(dur), in_ms=2000, out_ms=2000 + dur, factor=1.0, freeze_at=None, freeze_hold=None,
               reversed=False, fade_in_ms=None, fade_out_ms=None, effect=effect, intensity=1.0, source_len=9000.0) | kw
    return tuple(row[c.split()[0]] for c in CLIP.split(", "))


@pytest.fixture(scope="module")
def plan(spark):
    clips = spark.createDataFrame([clip(1, 0, 1000), clip(2, 1000, 1000, in_ms=100, out_ms=1100), clip(3, 500, 300, "fx", 4, "cameraSnap"), clip(4, 600, 400, "fx", 5, "cameraSnap"), clip(5, 0, 250, "fx", 4, "fadeToBlack"),
                                   clip(6, 0, 100, "fx", 4, "unheard")], CLIP)
    cuts = spark.createDataFrame([(1, 0, 2, 1, 1000, "dissolve", 400)], CUT)
    snaps = clips.filter("effect = 'cameraSnap'").select("project_id", "start_ms", F.col("dur_ms").cast("long").alias("dur_ms"))
    keys = spark.createDataFrame([(1, "scale", 200, 1.0, "linear"), (1, "scale", 400, 3.0, "linear"), (2, "scale", 500, 7.0, "linear")], "clip_id long, property string, time_ms long, value double, easing string")
    boxes = spark.createDataFrame([(1, 2000, 0.0, 0.0, 10.0, 10.0), (1, 3000, 10.0, 0.0, 20.0, 10.0), (2, -500, 1.0, 0.0, 2.0, 1.0), (2, 500, 3.0, 0.0, 4.0, 1.0)], "clip_id long, time_ms long, x1 double, y1 double, x2 double, y2 double")
    graded = spark.createDataFrame([(1, 1, 5.0), (1, 2, 0.0)], "project_id long, clip_id long, exposure double")
    found = render.render_plan(clips, cuts, snaps, GRID, ["cameraSnap", "fadeToBlack"], keys, boxes, graded)
    return {name: [r.asDict() for r in df.collect()] for name, df in found.items()}


def shown(frame):
    """Picture time: the first snap holds 500 from 500 to 800, the second 600 from 800 to 1000."""
    t = frame * 100.0
    return 500.0 if 500 <= t < 800 else 600.0 if 800 <= t < 1000 else t


def test_layers(plan):
    got = {(r["clip_id"], r["frame"]): r for r in plan["layers"]}
    want = {(i, f) for f in range(20) for i, a, b in ((1, 0, 1200), (2, 800, 2000)) if a <= shown(f) < b}
    assert set(got) == want and len(got) == len(plan["layers"])
    for (i, f), r in got.items():
        assert r["video_ms"] == shown(f)
        start, first = (0, 2000) if i == 1 else (1000, 100)
        assert math.isclose(r["source_ms"], max(0, first + shown(f) - start))


def test_transforms_hold_outside_their_keys(plan):
    got = {(r["clip_id"], r["frame"]): r["value"] for r in plan["transforms"]}
    assert set(got) == {(r["clip_id"], r["frame"]) for r in plan["layers"]}
    for (i, f), v in got.items():
        local = min(max(shown(f) - (0 if i == 1 else 1000), 0), 1000)
        assert math.isclose(v, 7.0 if i == 2 else 1 + 2 * min(max((local - 200) / 200, 0), 1))


def test_crops_follow_the_source(plan):
    got = {(r["clip_id"], r["frame"]): r["x1"] for r in plan["crops"]}
    source = {(r["clip_id"], r["frame"]): r["source_ms"] for r in plan["layers"]}
    assert set(got) == set(source)
    for key, x in got.items():
        s = source[key]
        assert math.isclose(x, 10 * min(max((s - 2000) / 1000, 0), 1) if key[0] == 1 else 1 + 2 * min(max((s + 500) / 1000, 0), 1), abs_tol=1e-9)


def test_grades_transitions_effects(plan):
    assert {(r["clip_id"], r["frame"], r["exposure"]) for r in plan["grades"]} == {(1, r["frame"], 5.0) for r in plan["layers"] if r["clip_id"] == 1}
    assert sorted((r["frame"], round(r["raw"], 6)) for r in plan["transitions"]) == [(10, 0.5), (11, 0.75)]
    assert sorted((r["clip_id"], r["frame"]) for r in plan["effects"]) == [(3, 5), (3, 6), (3, 7), (4, 6), (4, 7), (4, 8), (4, 9), (5, 0), (5, 1), (5, 2)]
    assert math.isclose(next(r["amount"] for r in plan["effects"] if r["clip_id"] == 5 and r["frame"] == 1), 0.4)


def test_empty_timeline(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    found = render.render_plan(none(CLIP), none(CUT), none("project_id long, start_ms long, dur_ms long"), GRID, ["shake"])
    assert all(df.count() == 0 for df in found.values())


def test_no_lookup_per_frame(spark, plan):
    """Frames come last: no join or exchange above the step that lists them."""
    spans = spark.createDataFrame([(1, 0, 1, 0, 5, None)], "project_id long, track_index long, clip_id long, f0 long, f1 long, hold_ms double")
    text = render.frames(spans, GRID)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_long_groups_of_keys_are_spread(spark, monkeypatch):
    from mediaframe.plans import scan

    rows = [(c, t * 10, float(t)) for c, n in ((1, 1), (2, 7), (3, 2)) for t in range(n)]
    keys = spark.createDataFrame(rows, "clip_id long, time_ms long, value double")
    read = lambda: sorted(((r.clip_id, tuple(r.lo) if r.lo else (), tuple(r.hi) if r.hi else ()) for r in render.key_spans(keys, ["clip_id"], ["time_ms", "value"]).collect()))
    at = {c: [(t, v) for k, t, v in rows if k == c] for c in (1, 2, 3)}
    want = sorted((c, lo, hi) for c, ts in at.items() for lo, hi in zip([(), *ts], [*ts, ()]))
    spread = scan.ordered_scan
    monkeypatch.setattr(scan, "ordered_scan", None)
    assert read() == want
    monkeypatch.setattr(scan, "ordered_scan", spread)
    monkeypatch.setattr(scan, "WINDOW_ROWS", 3)
    assert read() == want
