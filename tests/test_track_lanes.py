"""Shots that advance together are tracked as each would be alone."""

import numpy as np

from mediaframe.operators import tracking


def _shots(n=9):
    rng = np.random.default_rng(6)
    shots = {}
    for s in range(n):
        place, move = rng.uniform(0, 400, (6, 2)), rng.uniform(-8, 8, (6, 2))
        shots[s] = [[(np.r_[p + f * m, p + f * m + 90], "ab"[i % 2], float(rng.uniform(0.05, 1))) for i, (p, m) in enumerate(zip(place, move)) if rng.random() < 0.8] for f in range(5 + 7 * s)]
    return shots


def test_shots_together_equal_shots_alone():
    shots, options = _shots(), tracking.TrackerOptions(buffer=4)
    want = {}
    for s, frames in shots.items():
        one = tracking.Tracker(options)
        want[s] = [[(t.id, t.label, t.score, *t.box.tolist()) for t in one.step(dets)] for dets in frames]
    many, got = tracking.Trackers(options), {s: [] for s in shots}
    for f in range(max(map(len, shots.values()))):
        here = [s for s in shots if f < len(shots[s])]
        rows = [(s, *d) for s in here for d in shots[s][f]]
        label = np.array([r[2] for r in rows], object)
        found = many.step({"shot": np.array([r[0] for r in rows]), "box": np.array([r[1] for r in rows]), "label": label, "score": np.array([r[3] for r in rows])}, np.array(here))
        for s in here:
            at = found["shot"] == s
            got[s].append([(int(i), l, float(v), *b) for i, l, v, b in zip(found["id"][at], found["label"][at], found["score"][at], found["box"][at].tolist())])
    assert got == want and sum(map(len, (x for w in want.values() for x in w))) > 200


def test_a_lane_over_batches(spark):
    """Turns cut by batches, frames without detections and shots of different lengths."""
    rows = [(1, s, f, None, None, None, *[None] * 4) if not dets else (1, s, f, i, d[1], d[2], *d[0].tolist()) for s, frames in _shots(6).items() for f, dets in enumerate(frames) for i, d in enumerate(dets or [None])]
    df = spark.createDataFrame(rows, "asset_id long, shot long, frame long, det long, label string, score double, x1 double, y1 double, x2 double, y2 double")
    whole = sorted(map(tuple, tracking.byte_track(df).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, tracking.byte_track(df).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(1, s, f, t.id, t.label, t.score, *t.box.tolist()) for s, frames in _shots(6).items() for tracker in [tracking.Tracker()] for f, dets in enumerate(frames) for t in tracker.step(dets)]
    assert whole == sorted(want)
