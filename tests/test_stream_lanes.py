"""Streamed shots that share a lane advance together, and each as it would alone."""

import pandas as pd
from test_sources import _at, _in_turns, _left_in_state

from mediaframe.operators import tracking
from mediaframe.streaming import streams

SCHEMA = "asset_id bigint, shot bigint, frame bigint, det bigint, label string, score double, x1 double, y1 double, x2 double, y2 double"


def _det(asset, shot, frame, det=0):
    x = 10.0 * (shot or 0) + 5 * frame + 400 * det
    return (asset, shot, frame, det, "ab"[det], 0.9, x, 100.0, x + 100, 300.0)


def _end(asset, shot, frame):
    return (asset, shot, frame, *[None] * 7)


def _rows(found):
    return sorted(map(tuple, found), key=repr)


def test_a_turn_holds_the_next_frame_of_every_shot(monkeypatch):
    turns, step = [], tracking.Trackers.step
    monkeypatch.setattr(tracking.Trackers, "step", lambda self, d, shots: turns.append(len(shots)) or step(self, d, shots))
    rows = [_det(1, shot, frame, det) for shot in range(40) for frame in range(3 + shot % 4) for det in (0, 1)] + [_end(1, shot, 9) for shot in range(40)]
    new = pd.DataFrame(rows, columns=SCHEMA.replace(" bigint", "").replace(" double", "").replace(" string", "").split(", "))
    lane = streams._Lane(tracking.TrackerOptions(), None)
    found = lane.track([new.assign(_null=0, _ends=new["det"].isna())])
    assert turns == [40, 40, 40, 30, 20, 10] and len(lane.shots["last"]) == 0
    assert len(found["frame"]) == 2 * sum(3 + shot % 4 for shot in range(40))


def test_shots_of_a_lane_share_a_state(spark, tmp_path):
    """Frames cut by micro-batches, late rows, shots that end early or not at all, a shot that comes back, keys that are null."""
    keys = [(1, s) for s in range(9)] + [(None, 0), (0, None), (0, 0), (1, 2**62 + 1), (1, 2**62 + 2)]
    frames = {k: 4 + i % 5 for i, k in enumerate(keys)}
    rows = {k: [_det(*k, f, d) for f in range(frames[k]) for d in (0, 1)] for k in keys}
    first, gone = [r for k in keys for r in rows[k][:5]], (1, 0)
    late = [_det(1, 1, 0, 1)]
    second = [r for k in keys for r in rows[k][5:]] + late + [_end(*gone, 99)]
    again = [_det(*gone, f) for f in (50, 51)]
    stream = _in_turns(spark, tmp_path, (first, second, [*again, *(_end(*k, 99) for k in keys if k[0] != 1), _end(7, 7, 0)]), SCHEMA)
    got, held = _left_in_state(spark, streams.byte_track_stream(stream, lanes=2), tmp_path)
    open_ = {k for k in keys if k[0] == 1 and k != gone}
    want = []
    for k in keys:
        tracker, names = tracking.Tracker(), {f: [r for r in rows[k] if r[2] == f] for f in range(frames[k])}
        for f, dets in names.items():
            if k not in open_ or f < frames[k] - 1:
                want += [(*k, f, t.id, t.label, t.score, *t.box.tolist()) for t in tracker.step([(pd.Series(r[6:]).to_numpy(float), r[4], r[5]) for r in dets])]
    tracker = tracking.Tracker()  # the ended shot starts anew; its newest frame waits
    want += [(*gone, 50, t.id, t.label, t.score, *t.box.tolist()) for t in tracker.step([(pd.Series(again[0][6:]).to_numpy(float), "a", 0.9)])]
    assert _rows(got) == _rows(want) and held == 2


def test_each_shot_of_a_lane_ends_by_its_own_time(spark, tmp_path):
    schema = f"{SCHEMA}, ts timestamp"
    parts = [[(*_det(1, shot, f), _at(minute + f)) for shot, minute in ((1, 0), (2, 300)) for f in range(4)],
             [(*_det(1, 3, f), _at(200 + f)) for f in (0, 1)],  # the watermark is past shot 1 and not past 2
             [(*_det(1, 3, 2), _at(600))]]
    stream = _in_turns(spark, tmp_path, parts, schema)
    got, held = _left_in_state(spark, streams.byte_track_stream(stream, ts="ts", delay="250 minutes", idle_ms=1_800_000, lanes=1), tmp_path)
    seen = {shot: sorted(r.frame for r in got if r.shot == shot) for shot in (1, 2, 3)}
    assert seen == {1: [0, 1, 2, 3], 2: [0, 1, 2, 3], 3: [0, 1]} and held == 1
    want = tracking.byte_track(spark.createDataFrame([r[:-1] for p in parts for r in p], SCHEMA)).filter("not (shot = 3 and frame = 2)").collect()
    assert _rows(got) == _rows(want)
