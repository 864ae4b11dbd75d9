"""Top values by chunk maxima, and products of tiles against a plain loop."""

import numpy as np
import pytest

from mediaframe.operators import identity
from mediaframe.plans import matrix


@pytest.mark.parametrize("levels", [3, 1000, None])
def test_top_by_chunks(levels):
    rng = np.random.default_rng(1)
    for wide in (1, 40, 192, 193, 500, 1111):
        v = rng.normal(size=(50, wide + 7)) if levels is None else rng.integers(0, levels, (50, wide + 7)).astype(float)
        v[rng.random(v.shape) < 0.1] = -np.inf
        v[:5] = -np.inf
        v[7, ::11] = np.nan
        view = v[:, 3:3 + wide]
        assert np.array_equal(identity._top(view, 3), np.argsort(-view, axis=1, kind="stable")[:, :3])


def _references(spark, n):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, i // 2, i // 7, bool(i % 2), rng.normal(size=5).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ref_id bigint, owner int, crop_group bigint, image bigint, lineup boolean, embedding array<double>")


@pytest.mark.parametrize("bank", [matrix.BANK_ROWS, 10])
def test_calibration_by_brute_force(spark, monkeypatch, bank):
    monkeypatch.setattr(matrix, "BANK_ROWS", bank)
    monkeypatch.setattr(matrix, "LEAST_ROWS", 16)
    rows, refs = _references(spark, 90)
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    want = {}
    for i, truth, _, image, lineup, e in rows:
        scores = {}
        for owner in range(3):
            groups: dict = {}
            for _, o, group, other, kind, f in rows:
                if o == owner and kind != lineup and other != image:
                    groups[group] = max(groups.get(group, -2.0), float(unit(e) @ unit(f)))
            scores[owner] = np.mean(sorted(groups.values())[-3:])
        want[i] = (scores[truth], max(s for o, s in scores.items() if o != truth))
    got = {r.vec_id: (r.pos, r.wrong) for r in identity.calibration_rows(refs).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_only_pairs_of_both_kinds_are_multiplied(spark, monkeypatch):
    asked = []

    def products(probes, refs, *args):
        asked.append((probes.count(), refs.count()))
        return spark.createDataFrame([], args[2])

    monkeypatch.setattr(identity, "tiled_products", products)
    identity.calibration_rows(_references(spark, 90)[1])
    assert asked == [(45, 45), (45, 45)]
