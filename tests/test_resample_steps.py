"""Outputs settled together are those of a loop, whatever the cut into micro-batches."""

import numpy as np

from mediaframe.streaming.streams import _resampled


def _loop(times, period, near):
    start = last = times[0]
    k, out = 0, []
    for t in times[1:]:
        while start + k * period <= t - near:
            at = start + k * period
            copy = abs(at - last) <= near
            out.append((k, "copy" if copy else "interp", last, None if copy else t, 0.0 if copy else (at - last) / (t - last)))
            k += 1
        last = t
    return out


def test_outputs_equal_a_loop():
    rng = np.random.default_rng(9)
    for _ in range(60):
        times = np.unique(rng.integers(0, 40_000, int(rng.integers(2, 50)))).tolist()
        period, near = int(rng.integers(200, 3000)), int(rng.integers(0, 150))
        got, last, k, rest = [], times[0], 0, np.array(times[1:])
        for part in np.array_split(rest, int(rng.integers(1, 4))):
            if len(part):
                found = _resampled(times[0], last, k, part, period, near)
                got += [(int(n), str(kind), int(a), None if copied else int(b), float(x)) for n, kind, a, b, copied, x in zip(found["k"], found["kind"], found["a_us"], found["b_us"].fillna(-1), found["b_us"].isna(), found["alpha"])]
                last, k = int(part[-1]), k + len(found["k"])
        assert got == _loop(times, period, near)
