"""Frames assigned together against each frame by itself, however batches cut them."""

import numpy as np
import pandas as pd

from mediaframe.operators import tracking


def test_frames_of_a_batch_are_solved_together(monkeypatch):
    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"frame_id": rng.integers(0, 60, 500) * 1000, "row_id": rng.integers(-3, 4, 500), "col_id": rng.integers(0, 6, 500)}).drop_duplicates().sort_values(["frame_id", "row_id", "col_id"], ignore_index=True)
    rows["cost"] = rng.random(len(rows)) * 0.8
    calls, solve = [], tracking.best_pairs
    monkeypatch.setattr(tracking, "best_pairs", lambda *a: calls.append(1) or solve(*a))
    want = {}
    for frame, part in rows.groupby("frame_id"):
        r, c = np.unique(part["row_id"]), np.unique(part["col_id"])
        table = np.full((len(r), len(c)), 2.0)
        table[np.searchsorted(r, part["row_id"]), np.searchsorted(c, part["col_id"])] = part["cost"]
        pairs = tracking.optimal_pairs(table, 0.8)
        want[frame] = (len(pairs), sum(table[p] for p in pairs))
    cost = rows.set_index(["frame_id", "row_id", "col_id"])["cost"]
    for size in (1, 7, 100, len(rows)):
        calls.clear()
        got = pd.concat(tracking._assigned((rows[s:s + size] for s in range(0, len(rows), size)), 0.8), ignore_index=True)
        assert not got.duplicated(["frame_id", "row_id"]).any() and not got.duplicated(["frame_id", "col_id"]).any()
        mine = got.assign(cost=cost.loc[list(got.itertuples(index=False, name=None))].to_numpy()).groupby("frame_id")["cost"].agg(["size", "sum"])
        assert set(mine.index) == set(want) and all(n == mine["size"][f] and abs(c - mine["sum"][f]) < 1e-9 for f, (n, c) in want.items())
    assert len(calls) <= 2  # one for all frames but the last


def test_areas_are_not_worked_out_for_each_pair(spark):
    from mediaframe import fixtures as fx
    from mediaframe.operators import detections

    pairs = detections.pair_detections(fx.detections(spark, "/root/testdata/sf0.001"), 1280.0, 720.0, min_iou=0.2).select("frame_id", "iou").filter("1 - iou <= 0.8")
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("_area" in line and "(a_x2" not in line.split("_area")[0] for line in joins)
