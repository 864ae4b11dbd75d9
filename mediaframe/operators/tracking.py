"""Tracking by detection: optimal assignment, a two-stage tracker, following a confirmed pair.

Detections of one (asset, shot) are streamed in frame order; the state between frames is the live tracks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.plans.sequential import Processor, sequential


def optimal_pairs(cost: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """Cheapest one-to-one pairs (shortest augmenting paths), then those at or below ``gate``."""
    if 0 in cost.shape:
        return []
    capped = np.where(cost > gate, gate + 1e3, cost)
    flip = capped.shape[0] > capped.shape[1]
    c = capped.T if flip else capped
    n, m = c.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        r, base, col = i, 0.0, -1
        while True:
            slack = base + c[r] - u[r] - v
            better = ~done & (slack < dist)
            dist[better], prev[better] = slack[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base, done[col] = dist[col], True
            if row_of[col] < 0:
                break
            r = row_of[col]
        # potentials, then shift the pairs along the path
        seen = done & (np.arange(m) != col)
        u[i] += base
        u[row_of[seen]] += base - dist[seen]
        v[seen] -= base - dist[seen]
        while col >= 0:
            p = prev[col]
            row_of[col] = row_of[p] if p >= 0 else i
            col = p
    pairs = [(int(j), int(r)) if flip else (int(r), int(j)) for j, r in enumerate(row_of) if r >= 0]
    return sorted((a, b) for a, b in pairs if cost[a, b] <= gate)


def linked_groups(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Group number of each candidate pair: pairs that share a row or a column, directly or over others."""
    label = np.arange(len(rows))
    places = [np.unique(ids, return_inverse=True)[1] for ids in (rows, cols)]
    while True:
        least = label.copy()
        for at in places:
            low = np.full(at.max(initial=-1) + 1, len(rows))
            np.minimum.at(low, at, least)
            least = low[at]
        if (least == label).all():
            return label
        label = least


def assign(costs: DataFrame, gate: float) -> DataFrame:
    """Optimal pairs per frame from candidate costs (frame_id, row_id, col_id, cost); pairs that are not listed
    are forbidden. Candidates that share no row or column, directly or over others, don't influence each other: each
    linked group is solved by itself, so a table is only as large as its group. Every group left unpaired costs the same,
    so the groups' optima are the frame's."""
    near = costs.filter(F.col("cost") <= gate).select("frame_id", "row_id", "col_id", "cost")
    parts = int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = near.repartition(parts, "frame_id").sortWithinPartitions("frame_id", "row_id", "col_id")
    return rows.mapInPandas(lambda batches: _assigned(batches, gate), "frame_id bigint, row_id bigint, col_id bigint")


def _assigned(batches: Iterator[pd.DataFrame], gate: float) -> Iterator[pd.DataFrame]:
    """The pairs of frames sorted by frame, row and column. The frames of a batch are solved together, as tables side by side;
    holds one batch and one frame."""
    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        frame, keys = pdf["frame_id"].to_numpy(), []
        number = np.concatenate(([0], np.cumsum(frame[1:] != frame[:-1])))
        for c in ("row_id", "col_id"):
            # numbers of the ids, frame after frame
            ids = pdf[c].to_numpy()
            order = np.lexsort((ids, number))
            new = np.concatenate(([True], (np.diff(number[order]) != 0) | (np.diff(ids[order]) != 0)))
            at = np.empty(len(ids), np.int64)
            at[order] = np.cumsum(new) - 1
            keys.append((at, frame[order[new]], ids[order[new]]))
        (rows, frames, row_ids), (cols, _, col_ids) = keys
        a, b = best_pairs(rows, cols, pdf["cost"].to_numpy(), gate)
        return pd.DataFrame({"frame_id": frames[a], "row_id": row_ids[a], "col_id": col_ids[b]})

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        frame = pdf["frame_id"].to_numpy()
        cut = int(np.searchsorted(frame, frame[-1], "left"))
        if cut or (held and held[-1]["frame_id"].iloc[-1] != frame[0]):
            whole = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
            held = []
            if len(whole):
                yield solved(whole)
        held.append(pdf.iloc[cut:])
    if held:
        yield solved(pd.concat(held, ignore_index=True))


# --------------------------------------------------------------------------- motion model

# constant velocity on (centre x, centre y, aspect, height); noise scales with the height. The four move independently of each
# other, so a covariance is four times a place's, the two between place and speed, and a speed's
POSITION_NOISE, VELOCITY_NOISE = 1 / 20, 1 / 160


def _measures(boxes: np.ndarray) -> np.ndarray:
    w, h = np.maximum(boxes[:, 2] - boxes[:, 0], 1e-6), np.maximum(boxes[:, 3] - boxes[:, 1], 1e-6)
    return np.stack([boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w / h, h], axis=1)


def _noises(h: np.ndarray, scale: float, aspect: float) -> np.ndarray:
    p = scale * h
    return np.square(np.stack([p, p, np.full(len(h), aspect), p], axis=1))


def _boxes(place: np.ndarray) -> np.ndarray:
    h = np.maximum(place[:, 3], 1e-6)
    w = np.maximum(place[:, 2] * h, 1e-6)
    return np.stack([place[:, 0] - w / 2, place[:, 1] - h / 2, place[:, 0] + w / 2, place[:, 1] + h / 2], axis=1)


def _sized(boxes: np.ndarray) -> np.ndarray:
    """Boxes as columns: the four sides and the area."""
    side = np.maximum(boxes[:, 2:] - boxes[:, :2], 0)
    return np.concatenate((boxes.T, (side[:, 0] * side[:, 1])[None]))


def _overlaps(a: np.ndarray, rows: np.ndarray, b: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """IoU of the sized boxes ``rows`` of a and ``cols`` of b, pair by pair."""
    a, b = a.take(rows, axis=1), b.take(cols, axis=1)
    size = np.maximum(np.minimum(a[2:4], b[2:4]) - np.maximum(a[:2], b[:2]), 0)
    inter = size[0] * size[1]
    union = a[4] + b[4] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def _products(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with one shot, of shots ``left`` and ``right`` (sorted)."""
    start, end = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    n = end - start
    rows = np.repeat(np.arange(len(left)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def best_pairs(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`optimal_pairs` of listed candidates at or below ``gate``, many tables at once: a linked group is a table of its
    own. In a group of one row or one column the cheapest candidate wins; only other groups need the paths."""
    if not len(rows):
        return rows, cols
    alone = (np.bincount(rows)[rows] == 1) & (np.bincount(cols)[cols] == 1)
    out = [(rows[alone], cols[alone])]
    rows, cols, cost = rows[~alone], cols[~alone], cost[~alone]
    if len(rows):
        group = linked_groups(rows, cols)
        order = np.lexsort((cols, rows, cost, group))
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        first, ends = np.concatenate(([0], cuts)), np.append(cuts, len(order))
        one = [np.minimum.reduceat(x[order], first) == np.maximum.reduceat(x[order], first) for x in (rows, cols)]
        star = one[0] | one[1]
        out.append((rows[order[first[star]]], cols[order[first[star]]]))
        for s, e in zip(first[~star].tolist(), ends[~star].tolist()):
            at = order[s:e]
            r, c = np.unique(rows[at]), np.unique(cols[at])
            table = np.full((len(r), len(c)), gate + 1.0)
            table[np.searchsorted(r, rows[at]), np.searchsorted(c, cols[at])] = cost[at]
            pairs = np.array(optimal_pairs(table, gate)).reshape(-1, 2)
            out.append((r[pairs[:, 0]], c[pairs[:, 1]]))
    return np.concatenate([r for r, _ in out]), np.concatenate([c for _, c in out])


@dataclass
class TrackerOptions:
    high: float = 0.5
    low: float = 0.1
    birth: float | None = None
    gate: float = 0.8
    rate: float = 30.0
    buffer: int = 30
    same_label: bool = True
    min_area: float = 1.0

    @property
    def patience(self) -> int:
        return max(1, int(self.rate / 30.0 * self.buffer))


#: A track: its shot and number in it, the newest label and score, frames of birth and last sight, and what it is.
COLUMNS = {"shot": np.int64, "id": np.int64, "label": object, "score": float, "born": np.int64, "seen": np.int64, "confirmed": bool, "lost": bool}
#: Its motion, a table of tracks each: place and speed, variance of the place, covariances as the gain reads and as it leaves them, variance
#: of the speed.
PLACE, SPEED, VAR, COV, VOC, SPEED_VAR = range(6)


def _mark(n: int, at: np.ndarray) -> np.ndarray:
    """Which of ``n`` are listed."""
    out = np.zeros(n, bool)
    out[at] = True
    return out


class Trackers:
    """Two-stage association: confident boxes first, then weak ones for the tracks still unmatched. Many shots advance
    together, a frame each per step; their tracks are rows of the same arrays, sorted by shot and in order of birth."""

    def __init__(self, options: TrackerOptions | None = None):
        self.options = options or TrackerOptions()
        self.t = {c: np.empty(0, kind) for c, kind in COLUMNS.items()} | {"motion": np.empty((6, 0, 4))}
        #: Of each shot number: frames stepped and the next track's number.
        self.frames, self.next_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def dump(self) -> tuple:
        """Plain values for a state store."""
        return self.frames, self.next_ids, self.t

    def load(self, saved: tuple) -> "Trackers":
        self.frames, self.next_ids, self.t = saved
        return self

    def _grow(self, n: int) -> None:
        """Room for ``n`` shots."""
        more = n - len(self.frames)
        if more > 0:
            self.frames, self.next_ids = np.append(self.frames, np.zeros(more, np.int64)), np.append(self.next_ids, np.ones(more, np.int64))

    def _match(self, tracks: np.ndarray, dets: np.ndarray, boxes: tuple[np.ndarray, np.ndarray], d: dict, gate: float, weigh: bool) -> tuple[np.ndarray, np.ndarray]:
        """Paired rows of ``tracks`` and ``dets``, which are row numbers sorted by shot; ``boxes``: of all tracks and detections, sized."""
        t = self.t
        i, j = _products(t["shot"][tracks], d["shot"][dets])
        rows, cols = tracks[i], dets[j]
        fit = _overlaps(boxes[0], rows, boxes[1], cols)
        cost = 1 - (fit * d["score"][cols] if weigh else fit)
        near = cost <= gate
        if self.options.same_label:
            near &= (t["label"][rows] == d["label"][cols]).astype(bool)
        i, j = best_pairs(i[near], j[near], cost[near], gate)
        return tracks[i], dets[j]

    def step(self, d: dict[str, np.ndarray], shots: np.ndarray) -> dict[str, np.ndarray]:
        """One frame of each of ``shots`` (sorted): detections d (shot, box, label, score), sorted by shot. Returns the columns of
        the confirmed tracks seen in it, with their box, by shot and number."""
        o, t = self.options, self.t
        if len(shots):
            self._grow(int(shots[-1]) + 1)
        self.frames[shots] += 1
        now = self.frames
        box = d["box"]
        big = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) >= o.min_area
        strong, weak = np.flatnonzero(big & (d["score"] >= o.high)), np.flatnonzero(big & (o.low <= d["score"]) & (d["score"] < o.high))
        steps = _mark(len(now), shots)
        here = steps[t["shot"]]
        fresh = np.flatnonzero(here & ~t["confirmed"])
        pool = np.flatnonzero(here & (t["confirmed"] | t["lost"]))
        pool = pool[np.lexsort((pool, t["lost"][pool], t["shot"][pool]))]
        self._advance(pool)
        boxes = _sized(_boxes(t["motion"][PLACE])), _sized(box)
        hits = self._match(pool, strong, boxes, d, o.gate, True)
        paired, used = _mark(len(here), hits[0]), _mark(len(box), hits[1])
        strong = strong[~used[strong]]
        rest = pool[~paired[pool] & ~t["lost"][pool]]
        more = self._match(rest, weak, boxes, d, 0.5, False)
        paired[more[0]] = True
        t["lost"][rest[~paired[rest]]] = True
        first = self._match(fresh, strong, boxes, d, 0.7, True)
        paired[first[0]], used[first[1]] = True, True
        strong = strong[~used[strong]]
        gone = fresh[~paired[fresh]]
        self._correct(*(np.concatenate(x) for x in zip(hits, more, first)), d)
        dead = here & t["lost"] & (now[t["shot"]] - t["seen"] > o.patience)
        dead[gone] = True
        born = strong[d["score"][strong] >= (o.high + 0.1 if o.birth is None else o.birth)]
        self._keep(~dead, self._born(born, d))
        self._merge(steps)
        t = self.t
        seen = np.flatnonzero(t["confirmed"] & ~t["lost"] & steps[t["shot"]])
        seen = seen[np.lexsort((t["id"][seen], t["shot"][seen]))]
        return {c: t[c][seen] for c in ("shot", "id", "label", "score")} | {"box": _boxes(t["motion"][PLACE, seen])}

    def _advance(self, rows: np.ndarray) -> None:
        place, speed, var, cov, voc, speed_var = m = self.t["motion"].take(rows, axis=1)
        noises = [_noises(place[:, 3], *x) for x in ((POSITION_NOISE, 1e-2), (VELOCITY_NOISE, 1e-5))]
        place += speed
        var[:] = ((var + cov) + (voc + speed_var)) + noises[0]
        voc += speed_var
        cov += speed_var
        speed_var += noises[1]
        self.t["motion"][:, rows] = m

    def _correct(self, rows: np.ndarray, dets: np.ndarray, d: dict) -> None:
        t = self.t
        place, speed, var, cov, voc, speed_var = m = t["motion"].take(rows, axis=1)
        s = var + _noises(place[:, 3], POSITION_NOISE, 1e-1)
        gain, gain_v = var * (1 / s), cov * (1 / s)
        off = _measures(d["box"][dets]) - place
        place += gain * off
        speed += gain_v * off
        var -= gain * s * gain
        voc -= gain * s * gain_v
        cov -= gain_v * s * gain
        speed_var -= gain_v * s * gain_v
        t["motion"][:, rows] = m
        t["label"][rows], t["score"][rows], t["seen"][rows] = d["label"][dets], d["score"][dets], self.frames[t["shot"][rows]]
        t["confirmed"][rows], t["lost"][rows] = True, False

    def _born(self, dets: np.ndarray, d: dict) -> dict[str, np.ndarray]:
        shot, n = d["shot"][dets], len(dets)
        nth = np.arange(n) - np.searchsorted(shot, shot, "left")
        place, frame, motion = _measures(d["box"][dets]), self.frames[shot], np.zeros((6, n, 4))
        motion[PLACE], motion[VAR], motion[SPEED_VAR] = place, _noises(place[:, 3], 2 * POSITION_NOISE, 1e-2), _noises(place[:, 3], 10 * VELOCITY_NOISE, 1e-5)
        out = {"shot": shot, "id": self.next_ids[shot] + nth, "label": d["label"][dets], "score": d["score"][dets], "born": frame, "seen": frame, "confirmed": frame == 1, "lost": np.zeros(n, bool)}
        np.add.at(self.next_ids, shot, 1)
        return out | {"motion": motion}

    def _keep(self, good: np.ndarray, born: dict[str, np.ndarray] | None = None) -> None:
        """Only the ``good`` tracks, and the born ones after those of their shots."""
        t, axis = self.t, lambda c: int(c == "motion")
        new = 0 if born is None else len(born["shot"])
        if not new and good.all():
            return
        rows = np.flatnonzero(good)
        if new:
            rows = np.concatenate((rows, np.arange(len(good), len(good) + new)))
            t = {c: np.concatenate((v, born[c]), axis=axis(c)) for c, v in t.items()}
            rows = rows[np.argsort(t["shot"][rows], kind="stable")]
        self.t = {c: v.take(rows, axis=axis(c)) for c, v in t.items()}

    def _merge(self, steps: np.ndarray) -> None:
        """A live and a lost track on one box are the same object: keep the older. ``steps`` marks the shots to look at."""
        t = self.t
        here = steps[t["shot"]]
        live, lost = np.flatnonzero(here & ~t["lost"]), np.flatnonzero(here & t["lost"])
        i, j = _products(t["shot"][live], t["shot"][lost])
        if not len(i):
            return
        i, j, boxes = live[i], lost[j], _sized(_boxes(t["motion"][PLACE]))
        same = np.flatnonzero(_overlaps(boxes, i, boxes, j) > 0.85)
        i, j, age = i[same], j[same], t["seen"] - t["born"]
        same = (t["label"][i] == t["label"][j]).astype(bool)
        i, j = i[same], j[same]
        good = np.ones(len(here), bool)
        good[np.where(age[i] > age[j], j, i)] = False
        self._keep(good)

    def end(self, shots: np.ndarray) -> None:
        """Forget the tracks of ``shots``."""
        self._keep(~np.isin(self.t["shot"], shots))

    def only(self, good: np.ndarray) -> None:
        """Forget all shots but those that ``good`` marks, which are numbered anew in their order."""
        self._grow(len(good))
        self._keep(good[self.t["shot"]])
        self.t["shot"] = (np.cumsum(good) - 1)[self.t["shot"]]
        self.frames, self.next_ids = self.frames[good], self.next_ids[good]


class Track(NamedTuple):
    id: int
    label: str
    score: float
    box: np.ndarray


class Tracker(Trackers):
    """The tracker of a single shot."""

    def step(self, dets: list[tuple[np.ndarray, str, float]]) -> list[Track]:
        """One frame of (box, label, score); returns the confirmed tracks seen in it."""
        box = np.array([d[0] for d in dets], float).reshape(-1, 4)
        label = np.empty(len(dets), object)
        label[:] = [d[1] for d in dets]
        found = super().step({"shot": np.zeros(len(dets), np.int64), "box": box, "label": label, "score": np.array([d[2] for d in dets], float)}, np.array([0]))
        return [Track(int(i), l, float(s), b) for i, l, s, b in zip(*(found[c] for c in ("id", "label", "score", "box")))]


TRACK_SCHEMA = "asset_id bigint, shot bigint, frame bigint, track_id bigint, label string, score double, x1 double, y1 double, x2 double, y2 double"


def tracked(found: dict[str, np.ndarray], asset: np.ndarray, shot: np.ndarray, frame: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of :data:`TRACK_SCHEMA` of what a step found; the keys are listed by shot number."""
    at = found["shot"]
    return {"asset_id": asset[at], "shot": shot[at], "frame": frame[at], "track_id": found["id"], "label": found["label"], "score": found["score"], **{c: found["box"][:, i] for i, c in enumerate(("x1", "y1", "x2", "y2"))}}


class _TrackShots(Processor):
    """The shots of one lane, advanced together: the rows of a turn hold the next frame of each shot that has one. The last
    turn of a batch waits for the next batch."""

    def __init__(self, options: TrackerOptions):
        self.options = options

    def start(self, key):
        self.tracker, self.held, self.numbers, self.asset, self.shot = Trackers(self.options), [], {}, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _turn(self, c: dict) -> dict | None:
        new = np.flatnonzero(np.concatenate(([True], (c["asset_id"][1:] != c["asset_id"][:-1]) | (c["shot"][1:] != c["shot"][:-1]))))
        keys = list(zip(c["asset_id"][new].tolist(), c["shot"][new].tolist()))
        if not self.numbers:  # the first turn has a row of every shot, in the order of all turns
            self.numbers = {k: i for i, k in enumerate(keys)}
            self.asset, self.shot = c["asset_id"][new], c["shot"][new]
        at = np.array([self.numbers[k] for k in keys])
        self.tracker.end(np.setdiff1d(self.tracker.t["shot"], at))
        frame = np.zeros(len(self.numbers), np.int64)
        frame[at] = c["frame"][new]
        rows = np.repeat(at, np.diff(np.append(new, len(c["frame"]))))
        real = np.array([x is not None for x in c["label"]], bool)
        d = {"shot": rows[real], "box": np.stack([c[x][real] for x in ("x1", "y1", "x2", "y2")], axis=1).astype(float), "label": c["label"][real].astype(object), "score": c["score"][real].astype(float)}
        found = self.tracker.step(d, at)
        return tracked(found, self.asset, self.shot, frame) if len(found["shot"]) else None

    def feed(self, cols):
        last = cols["turn"][-1]
        cut = int(np.searchsorted(cols["turn"], last, "left"))
        done = []
        if self.held and (cut or self.held[0]["turn"][0] != last):
            n = int(np.searchsorted(cols["turn"], self.held[0]["turn"][0], "right"))
            done.append(self._turn(self._joined([*self.held, {k: v[:n] for k, v in cols.items()}])))
            self.held, cols, cut = [], {k: v[n:] for k, v in cols.items()}, cut - n
        turns = cols["turn"][:cut]
        starts = np.flatnonzero(np.concatenate(([True], turns[1:] != turns[:-1]))) if cut else []
        for s, e in zip(starts, np.append(starts[1:], cut) if cut else []):
            done.append(self._turn({k: v[s:e] for k, v in cols.items()}))
        self.held.append({k: v[cut:] for k, v in cols.items()})
        return self._joined([x for x in done if x])

    @staticmethod
    def _joined(parts: list[dict]) -> dict | None:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None

    def finish(self):
        return self._turn(self._joined(self.held)) if self.held else None


#: Lanes of a task: the shots of one lane advance together, so a task holds the live tracks of one lane.
LANES = 8


def byte_track(dets: DataFrame, options: TrackerOptions | None = None) -> DataFrame:
    """Track ids per frame. dets: asset_id, shot, frame, det, label, score, x1..y2; a frame without detections is one
    row with a null label."""
    o = options or TrackerOptions()
    turn = F.dense_rank().over(Window.partitionBy("asset_id", "shot").orderBy("frame"))
    parts = int(dets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("asset_id", "shot"), F.lit(parts * LANES))
    rows = dets.select("asset_id", "shot", "frame", "det", "label", "score", "x1", "y1", "x2", "y2").withColumns({"turn": turn, "lane": lane})
    return sequential(rows, ["lane"], ["turn", "asset_id", "shot", "det"], TRACK_SCHEMA, lambda: _TrackShots(o))


# --------------------------------------------------------------------------- following a pair


# Fixed values of the association: area ratio, overlap, and centre distance in widths that a match may have (the reach grows
# with every missed sample up to a limit), and the weights of distance and appearance beside the overlap.
SIZE_LOW, SIZE_HIGH, OVERLAP_MIN = 0.4, 2.5, 0.2
REACH, REACH_GROWTH, REACH_MAX = 0.6, 0.35, 3.0
DISTANCE_WEIGHT, LOOK_WEIGHT = 0.5, 2.0
KEEP_ANCHOR, KEEP_MATCH = 0.5, 0.6
EDGE = 0.02


def _best_two(cost: np.ndarray, n: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`optimal_pairs` of many tables of two rows, cost (tables, 2, columns) of which the first ``n`` count: which rows are paired at
    or below ``gate``, and with what column."""
    t, k = len(cost), cost.shape[2]
    there = np.arange(k) < n[:, None]
    c = np.where(there[:, None], np.where(cost > gate, gate + 1e3, cost), np.inf)
    each, pick = np.arange(t), c.argmin(axis=2)
    clash = np.flatnonzero((pick[:, 0] == pick[:, 1]) & (n > 1))
    if len(clash):
        # both want one column: the second row takes another, or the first one moves where that costs less
        at, first, row = pick[clash, 0], c[clash, 0], np.arange(len(clash))
        moved = c[clash, 1, at][:, None] + first - first[row, at][:, None]
        other = np.minimum(c[clash, 1], moved)
        other[row, at] = np.inf
        to = other.argmin(axis=1)
        moves = moved[row, to] < c[clash, 1, to]
        pick[clash, 0], pick[clash, 1] = np.where(moves, to, at), np.where(moves, at, to)
    paired = c[each[:, None], [[0, 1]], pick] <= gate
    lone = np.flatnonzero(n == 1)
    paired[lone, 1 - c[lone, :, 0].argmin(axis=1)] = False
    paired[n == 0] = False
    return paired, pick


def _lists(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column of number lists as a table; shorter lists end in zeros, which no product sees."""
    n, flat = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int), column.flatten().to_numpy(zero_copy_only=False)
    wide = max(int(n.max(initial=0)), width or 0)
    if (n == wide).all():
        return flat.astype(float).reshape(len(n), wide)
    out = np.zeros((len(n), wide))
    out[np.arange(wide) < n[:, None]] = flat
    return out


class _FollowPairs:
    """Associates the samples of pairs with their two targets, kept in arrays: last box, velocity, look, and the samples since the last
    match. The pairs of a batch advance together, a sample each per turn; what that means for the result is left to columns."""

    def __init__(self, app_min: float):
        self.app_min, self.last, self.state = app_min, None, None

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows sorted by pair and order: boxes and ages after each."""
        n, pair = batch.num_rows, batch.column("pair_id").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        sizes = np.diff(np.append(starts, n))
        offers, dets = batch.column("dets").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int), batch.column("dets").flatten()
        first = np.cumsum(offers) - offers
        box, look, allowed = _lists(dets.field("box"), 4), _lists(dets.field("emb")), ~dets.field("veto").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        anchored = np.flatnonzero(batch.column("anchor").is_valid().to_numpy(zero_copy_only=False))
        anchors = batch.column("anchor").drop_null()
        place = np.stack([_lists(anchors.field(c), 4) for c in ("p_box", "d_box")], axis=1)
        looks = [_lists(anchors.field(c)) for c in ("p_emb", "d_emb")]
        goes_on = self.last == pair[0]
        wide = max([look.shape[1], *(x.shape[1] for x in looks), self.state[2].shape[2] if goes_on else 0])
        pad = lambda x: np.concatenate((x, np.zeros((*x.shape[:-1], wide - x.shape[-1]))), axis=-1)
        look, looks, number = pad(look), np.stack([pad(x) for x in looks], axis=1), np.full(n, -1)
        number[anchored] = np.arange(len(anchored))
        order = np.argsort(-sizes, kind="stable")  # the pairs that go on longest come first
        p = len(starts)
        self.box, self.velocity, self.look, self.lost, self.known = np.zeros((p, 2, 4)), np.zeros((p, 2, 2)), np.zeros((p, 2, wide)), np.zeros((p, 2), np.int64), np.zeros(p, bool)
        if goes_on:
            i = int(np.flatnonzero(order == 0)[0])
            self.box[i], self.velocity[i], self.look[i], self.lost[i], self.known[i] = *(x[0] for x in self.state[:2]), pad(self.state[2])[0], self.state[3][0], True
        boxes, lost = np.empty((n, 2, 4)), np.empty((n, 2), np.int64)
        for turn, m in enumerate(np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left").tolist()):
            at = starts[order[:m]] + turn
            found, to, keep = np.ones((m, 2), bool), self.box[:m].copy(), np.full(m, KEEP_ANCHOR)
            here = np.flatnonzero(number[at] >= 0)
            if len(here):
                a = number[at[here]]
                new = here[~self.known[here]]
                to[here], self.look[here], self.known[here] = place[a], looks[a], True
                self.box[new] = to[new]
            rest = np.flatnonzero(number[at] < 0)
            if len(rest):
                keep[rest] = KEEP_MATCH
                found[rest], to[rest] = self.matched(rest, offers[at[rest]], first[at[rest]], box, look, allowed)
            self.update(found, to, keep)
            boxes[at], lost[at] = self.box[:m], self.lost[:m]
        i = int(np.flatnonzero(order == p - 1)[0])
        self.last, self.state = pair[-1], [x[i:i + 1].copy() for x in (self.box, self.velocity, self.look, self.lost)]
        listed = lambda values, size: pa.ListArray.from_arrays(np.arange(0, len(values) + 1, size, dtype=np.int32), values)
        found = [listed(listed(pa.array(boxes.ravel()), 4), 2), listed(pa.array(lost.ravel()), 2)]
        return pa.RecordBatch.from_arrays([batch.column("pair_id"), batch.column("frame"), *found], names=["pair_id", "frame", "boxes", "lost"])

    def matched(self, rows: np.ndarray, n: np.ndarray, first: np.ndarray, box: np.ndarray, look: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which targets of the pairs ``rows`` are found among their ``n`` offers from ``first`` on, and their boxes then."""
        found, to = np.zeros((len(rows), 2), bool), self.box[rows].copy()
        for size in np.unique(n[n > 0]).tolist():  # pairs with equally many offers are scored together
            own = np.flatnonzero(n == size)
            at = first[own][:, None] + np.arange(size)
            paired, pick = _best_two(-self.scores(rows[own], box[at], look[at], allowed[at]), n[own], 1e8)
            found[own] = paired
            to[own] = np.where(paired[..., None], box[at][np.arange(len(own))[:, None], pick], to[own])
        return found, to

    def scores(self, rows: np.ndarray, offered: np.ndarray, look: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """How well every offered box suits each target at the place its velocity leads to: (pairs, 2, offers)."""
        lost = self.lost[rows]
        ahead = self.box[rows] + np.tile(self.velocity[rows] * (lost + 1)[..., None], 2)
        extent = ahead[..., 2:] - ahead[..., :2]
        area = (offered[..., 2:] - offered[..., :2]).prod(axis=2)[:, None] / np.maximum(extent.prod(axis=2), 1.0)[..., None]
        size = np.clip(np.minimum(ahead[:, :, None, 2:], offered[:, None, :, 2:]) - np.maximum(ahead[:, :, None, :2], offered[:, None, :, :2]), 0, None)
        inter = size[..., 0] * size[..., 1]
        whole = lambda b: np.clip(b[..., 2] - b[..., 0], 0, None) * np.clip(b[..., 3] - b[..., 1], 0, None)
        union = whole(ahead)[..., None] + whole(offered)[:, None] - inter
        overlap = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        centre = lambda b: (b[..., :2] + b[..., 2:]) / 2
        away = np.linalg.norm(centre(offered)[:, None] - centre(ahead)[:, :, None], axis=3) / np.maximum(extent[..., :1], 1.0)
        own = self.look[rows]
        alike = np.matmul(own, look.transpose(0, 2, 1)) / (np.linalg.norm(own, axis=2)[..., None] * np.linalg.norm(look, axis=2)[:, None] + 1e-9)
        reach = np.minimum(REACH + REACH_GROWTH * lost, REACH_MAX)[..., None]
        near = (overlap >= OVERLAP_MIN) | (away <= reach)
        fits = allowed[:, None] & near & (area >= SIZE_LOW) & (area <= SIZE_HIGH) & (alike >= self.app_min)
        return np.where(fits, overlap + DISTANCE_WEIGHT * np.maximum(0, 1 - away) + LOOK_WEIGHT * (alike - self.app_min), -1e9)

    def update(self, found: np.ndarray, boxes: np.ndarray, keep: np.ndarray):
        """Found targets move, with a velocity smoothed by ``keep``; the others are a sample longer lost."""
        m, keep = len(found), keep[:, None, None]
        box, lost, velocity = self.box[:m], self.lost[:m], self.velocity[:m]
        step = ((boxes[..., :2] + boxes[..., 2:]) / 2 - (box[..., :2] + box[..., 2:]) / 2) / (lost + 1)[..., None]
        self.velocity[:m] = np.where(found[..., None], keep * velocity + (1 - keep) * step, velocity)
        self.box[:m] = np.where(found[..., None], boxes, box)
        self.lost[:m] = np.where(found, 0, lost + 1)


def follow_pairs(samples: DataFrame, anchors: DataFrame, fw: float, fh: float, hold: int, app_min: float = 0.7) -> DataFrame:
    """Primary and duplicate box at every sample of a shot, followed from the confirmed frames.

    samples: pair_id, frame, det, x1..y2, emb array<double>, veto boolean (null det for an empty sample); anchors: pair_id,
    frame, p_* and d_* boxes, p_emb, d_emb. Boxes are held for ``hold`` samples; before the first anchor the
    duplicate is held to the start unless it touches the frame edge. The forward pass streams samples in
    order, the backward pass in reverse; the state is two targets a pair, the pairs of a batch advance together, and the holding is a
    rule over their ages."""
    boxes = [F.array(*[f"{s}_{c}" for c in ("x1", "y1", "x2", "y2")]).alias(f"{s}_box") for s in "pd"]
    a = anchors.select("pair_id", "frame", F.struct(*boxes, "p_emb", "d_emb").alias("anchor"))
    first = anchors.groupBy("pair_id").agg(F.min("frame").alias("_first"))
    det = F.when(F.col("det").isNotNull(), F.struct("det", F.array("x1", "y1", "x2", "y2").alias("box"), "emb", "veto"))
    s = samples.groupBy("pair_id", "frame").agg(F.array_compact(F.array_sort(F.collect_list(det))).alias("dets")).join(a, ["pair_id", "frame"], "left").join(first, "pair_id")
    schema = "pair_id bigint, frame bigint, boxes array<array<double>>, lost array<bigint>"

    def walked(rows: DataFrame, order: Column, back: bool) -> DataFrame:
        def run(batches):
            pairs = _FollowPairs(app_min)
            yield from (pairs.batch(b) for b in batches if b.num_rows)

        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.drop("_first").repartition(parts, "pair_id").sortWithinPartitions("pair_id", order)
        return rows.mapInArrow(run, schema).withColumn("_back", F.lit(back))

    ahead = walked(s.filter(F.col("frame") >= F.col("_first")), F.col("frame"), False)
    behind = walked(s.filter(F.col("frame") <= F.col("_first")), -F.col("frame"), True)
    behind = behind.join(first, "pair_id").filter(F.col("frame") < F.col("_first")).drop("_first")
    box = F.col("boxes")[1]
    inside = (box[0] > EDGE * fw) & (box[1] > EDGE * fh) & (box[2] < (1 - EDGE) * fw) & (box[3] < (1 - EDGE) * fh)
    fresh = [F.col("lost")[i] <= hold for i in range(2)]
    duplicate = F.when(fresh[1] | (F.col("_back") & inside), box)
    out = ahead.unionByName(behind).select("pair_id", "frame", F.when(fresh[0], F.col("boxes")[0]).alias("primary"), duplicate.alias("duplicate"), "lost")
    return out.select("pair_id", "frame", "primary", "duplicate", (F.col("duplicate").isNotNull() & (F.col("lost")[1] > 0)).alias("held"))


def appearance_ema(dets: DataFrame, momentum: float) -> DataFrame:
    """Running unit embedding per track. dets: asset_id, track_id, frame, embedding."""
    class Smooth(Processor):
        def start(self, key):
            self.key, self.prev = key, None

        def feed(self, cols):
            out = []
            for e in cols["embedding"]:
                v = np.asarray(e, dtype=float)
                if self.prev is not None:
                    v = momentum * self.prev + (1 - momentum) * v
                    v = v / (np.linalg.norm(v) + 1e-9)
                self.prev = v
                out.append(v.tolist())
            n = len(out)
            return {"asset_id": [self.key[0]] * n, "track_id": [self.key[1]] * n, "frame": cols["frame"], "embedding": out}

    return sequential(dets.select("asset_id", "track_id", "frame", "embedding"), ["asset_id", "track_id"], ["frame"], "asset_id bigint, track_id bigint, frame bigint, embedding array<double>", Smooth)
