"""Pairs followed together, however batches cut them, and tables of two rows against the general assignment."""

import numpy as np
import pyarrow as pa

from mediaframe.operators import tracking


def test_tables_of_two_rows():
    rng = np.random.default_rng(8)
    cost, n = rng.integers(0, 5, (400, 2, 6)).astype(float), rng.integers(0, 7, 400)
    cost[rng.random(cost.shape) < 0.3] = 9.0  # beyond the gate
    paired, pick = tracking._best_two(cost, n, 4.0)
    for c, k, p, to in zip(cost, n, paired, pick):
        assert [(i, int(to[i])) for i in range(2) if p[i]] == tracking.optimal_pairs(c[:, :k], 4.0)


def test_batches_may_cut_pairs():
    rng = np.random.default_rng(5)
    box = lambda x: [x, 100.0, x + 100, 400.0]
    rows = []
    for pair, length in enumerate([1, 9, 30, 4, 2]):
        for f in range(length):
            dets = [{"det": i, "box": box(float(x)), "emb": [float(i % 2 == 0), float(i % 2)], "veto": bool(rng.random() < 0.1)} for i, x in enumerate(rng.integers(150, 900, rng.integers(0, 4)))]
            anchor = {"p_box": box(200.0), "d_box": box(800.0), "p_emb": [1.0, 0.0], "d_emb": [0.0, 1.0]} if f == 0 or rng.random() < 0.1 else None
            rows.append({"pair_id": pair, "frame": f, "dets": dets, "anchor": anchor})
    table = pa.Table.from_pylist(rows).combine_chunks()
    got = []
    for size in (1, 7, len(rows)):
        pairs = tracking._FollowPairs(0.7)
        got.append([r for b in table.to_batches(max_chunksize=size) for r in pairs.batch(b).to_pylist()])
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    assert len({tuple(r["lost"]) for r in got[0]}) > 4
