"""Moving averages of many short series in one batch, and of series that batches cut."""

import numpy as np
import pandas as pd
import pytest

from mediaframe.plans.blocks import averages, ema


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_averages_over_batches(size):
    rng = np.random.default_rng(2)
    lengths = [1, 40, 2, 7, 7, 1, 90, 3]
    rows = pd.DataFrame({"key": np.repeat(np.arange(8), lengths), "i": np.concatenate([np.arange(n) for n in lengths]), "_b": 0, "x": rng.normal(size=sum(lengths)), "y": rng.normal(size=sum(lengths))})
    got = pd.concat(averages((rows[s : s + size] for s in range(0, len(rows), size)), ["key", "_b"], ["x", "y"], 0.3))
    assert list(got.columns) == ["key", "i", "_b", "_k", "x", "y"]
    for key, part in rows.groupby("key"):
        acc, want = np.zeros(2), []
        for x in part[["x", "y"]].to_numpy():
            acc = 0.3 * x + (1 - 0.3) * acc
            want.append(acc)
        mine = got[got["key"] == key]
        assert (mine[["x", "y"]].to_numpy() == np.array(want)).all()
        assert np.allclose(mine["_k"], 0.7 ** np.arange(1, len(part) + 1))


def test_short_series_over_blocks(spark):
    """Three rows a series, cut into blocks of two."""
    df = spark.range(300).selectExpr("id div 3 as asset_id", "id % 3 as frame", "cast(id as double) as value")
    out = ema(df, ["asset_id"], "frame", ["value"], 0.5, size=2)
    got = {(r.asset_id, r.frame): r.value for r in out.collect()}
    assert got == {(a, f): [3 * a, 3 * a + 0.5, 3 * a + 1.25][f] for a in range(100) for f in range(3)}


def test_ema_makes_no_group_of_each_series(spark, monkeypatch):
    from mediaframe.plans import blocks

    monkeypatch.setattr(blocks, "blockwise", None)
    df = spark.range(6).selectExpr("id div 3 as asset_id", "id % 3 as frame", "1.0d as value")
    assert {r.value for r in ema(df, ["asset_id"], "frame", ["value"], 0.5).collect()} == {1.0}


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_runs_over_batches(size):
    from mediaframe.plans.blocks import runs

    keys = [3, 3, 3, 5, 6, 6, None, None, 8, 8, 8, 8]
    rows = pd.DataFrame({"key": pd.array(keys, "Int64").to_numpy(float, na_value=np.nan), "b": [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0], "i": range(12)})
    got = [part["i"].tolist() for part in runs((rows.iloc[s : s + size] for s in range(0, 12, size)), ["key", "b"])]
    assert got == [[0, 1], [2], [3], [4, 5], [6, 7], [8, 9, 10, 11]]


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_zero_phase_over_batches(spark, size):
    """Both passes over whole series, however batches cut them, give what the passes over blocks give."""
    from mediaframe.operators.camera import ema_zero_phase
    from mediaframe.plans.blocks import zero_phase

    rng = np.random.default_rng(4)
    lengths = [1, 40, 2, 7, 90, 3]
    rows = pd.DataFrame({"asset_id": np.repeat(np.arange(6), lengths), "frame": np.concatenate([np.arange(n) for n in lengths]), "x": rng.normal(size=sum(lengths)), "note": "n"})
    got = pd.concat(zero_phase((rows[s : s + size] for s in range(0, len(rows), size)), ["asset_id"], ["x"], 0.3), ignore_index=True)
    assert (got[["asset_id", "frame", "note"]] == rows[["asset_id", "frame", "note"]]).all().all()
    if size == 50:
        df = spark.createDataFrame(rows)
        want = ema_zero_phase(df, ["x"], 0.3).orderBy("asset_id", "frame").toPandas()
        assert np.allclose(got["x"], want["x"], rtol=0, atol=1e-12)
        short = ema_zero_phase(df, ["x"], 0.3, keep=["note"], short=True).orderBy("asset_id", "frame").toPandas()
        assert (short["x"] == got["x"]).all() and (short["note"] == "n").all()
