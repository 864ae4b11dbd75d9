"""Streams of job events, samples, scores, frames and detections.

Every function takes and returns a streaming DataFrame (a batch one works too where no custom state is
needed). State is per job or asset, per live track of a shot that has not ended, or bounded by the watermark; the custom
states end by event time where the stream has one.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediaframe import schemas
from mediaframe.session import shared_folder
from mediaframe.operators.tracking import TRACK_SCHEMA, TrackerOptions, Trackers, tracked


def parse_event_lines(lines: DataFrame) -> DataFrame:
    """JSON lines to progress / log / result rows; anything else is an info log line. Keeps other columns."""
    j = F.from_json("value", schemas.EVENT)
    known = j["event"].isin("progress", "log", "result")
    rest = [c for c in lines.columns if c != "value"]
    return lines.withColumn("_j", j).select(*rest, F.when(known, F.col("_j.event")).otherwise("log").alias("event"), "_j.stage", "_j.clip", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_j.pct"))).alias("pct"),
                                            F.when(known, F.col("_j.message")).otherwise(F.col("value")).alias("message"), F.when(known, F.col("_j.level")).otherwise("info").alias("level"), "_j.path")


def read_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return parse_event_lines(spark.readStream.text(folder))


def progress_stream(events: DataFrame) -> DataFrame:
    """Latest stage and highest progress per job: late lines never move a job back. events: job_id, seq, stage, pct."""
    return events.groupBy("job_id").agg(F.max("pct").alias("pct"), F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


def asset_status_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest status per asset; repeated submissions inside the delay count once. events: asset_id, ts, seq, status."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["asset_id", "seq"])
    return once.groupBy("asset_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def waveform_stream(samples: DataFrame, bucket: str, delay: str = "1 hour") -> DataFrame:
    """Peak per fixed time bucket. samples: asset_id, ts, value."""
    w = samples.withWatermark("ts", delay).groupBy("asset_id", F.window("ts", bucket).alias("w")).agg(F.max(F.abs("value")).alias("peak"))
    return w.select("asset_id", F.col("w.start").alias("bucket_start"), "peak")


def score_windows_stream(scores: DataFrame, length: str, step: str, delay: str = "1 hour") -> DataFrame:
    """Sliding model windows: frames and the highest score. scores: asset_id, ts, score."""
    w = scores.withWatermark("ts", delay).groupBy("asset_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("frames"), F.max("score").alias("score"))
    return w.select("asset_id", F.col("w.start").alias("window_start"), "frames", "score")


def visibility_sessions_stream(sightings: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of sightings without a longer gap. sightings: asset_id, ts."""
    w = sightings.withWatermark("ts", delay).groupBy("asset_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"))
    return w.select("asset_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "frames")


def enrich_stream(detections: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream joined to a static table of one row per key."""
    return detections.join(table, key, "left")


def enrich_identity(batch: DataFrame, bank: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Identity of one micro-batch of probes; use inside ``foreachBatch``."""
    from mediaframe.operators.identity import identify, owner_scores

    return identify(owner_scores(batch, bank), threshold, margin)


def identify_stream(probes: DataFrame, bank: Callable[[], DataFrame], threshold: float, margin: float) -> DataFrame:
    """Identity of streamed detections, processed to the end, as a table. probes: vec_id, embedding, ...

    ``bank`` is called once per micro-batch, so a batch meets one version of the references and the next one may meet a newer
    one. A batch writes a folder of its own and replaces it when it runs again."""
    spark = probes.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = "vec_id bigint, best int, score double, margin double, owner int"
    spark.createDataFrame([], schema).write.parquet(f"{base}/rows/batch=-1")  # a stream without rows has no batch

    def one(batch: DataFrame, number: int) -> None:
        enrich_identity(batch, bank(), threshold, margin).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    probes.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/rows")


def _timed(rows: DataFrame, cols: list[str], ts: str | None, delay: str) -> tuple[DataFrame, str]:
    """``cols`` and ``_ms``, the event time in milliseconds, with the timeout that the state may use."""
    if ts is None:
        return rows.select(*cols, F.lit(None).cast("bigint").alias("_ms")), GroupStateTimeout.NoTimeout
    at = F.col(ts).cast("timestamp").alias("_ts")
    # the watermark is set on the column that reaches the grouping
    return rows.select(*cols, at, F.unix_millis(at).alias("_ms")).withWatermark("_ts", delay), GroupStateTimeout.EventTimeTimeout


def _expire_after(state: GroupState, idle_ms: int, timed: bool, rows: pd.DataFrame, before: int | None) -> int | None:
    """Set the end of a state ``idle_ms`` after its newest row; returns that row's time."""
    if not timed:
        return None
    newest = [int(v) for v in (rows["_ms"].max(), before) if not pd.isna(v)]
    latest = max(newest) if newest else state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))
    return latest


def ordered_frames_stream(frames: DataFrame, ts: str | None = None, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Drop frames whose time does not pass the last one seen of their asset. frames: asset_id, pts_us, value.

    With an event-time column ``ts`` an asset is forgotten once the watermark is ``idle_ms`` past its newest frame, and
    starts anew when it comes back; without one, assets are remembered."""
    rows, timeout = _timed(frames, ["asset_id", "pts_us", "value"], ts, delay)
    timed = ts is not None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, latest = state.get if state.exists else (-(1 << 62), None)
        got = pd.concat(list(batches)).sort_values("pts_us", kind="stable")
        before = got["pts_us"].cummax().shift(fill_value=last).clip(lower=last)
        out = got[got["pts_us"] > before]
        latest = _expire_after(state, idle_ms, timed, got, latest)
        state.update((int(max(last, got["pts_us"].max())), latest))
        yield out[["asset_id", "pts_us", "value"]]

    return rows.groupBy("asset_id").applyInPandasWithState(step, "asset_id bigint, pts_us bigint, value double", "last bigint, latest bigint", "append", timeout)


#: Lanes of the tracker's stream: the shots of one lane advance together and share a state, which holds their live tracks. A state
#: outlives its session, so their number does not follow the session's partitions.
TRACK_LANES = 512

#: What tells a shot (``_null``: 1 for an asset that is null, 2 for a shot) and what a row says of its detection.
_SHOT, _BOX = ["asset_id", "shot", "_null"], ["x1", "y1", "x2", "y2"]
_NEVER = np.iinfo(np.int64).min


class _Lane:
    """The open shots of one lane, numbered as they came: their tracks, the frame each has come to, its newest row's time, when it
    ends, and the rows that wait. The shots advance together, the next frame of each in a turn."""

    def __init__(self, options: TrackerOptions, saved: bytes | None):
        self.tracker = Trackers(options)
        self.shots = {c: np.zeros(0, np.int64) for c in (*_SHOT, "last", "latest", "due")}
        self.held: dict[str, np.ndarray] | None = None
        if saved is not None:
            tracks, self.shots, self.held = pickle.loads(saved)
            self.tracker.load(tracks)

    def dump(self) -> bytes:
        return pickle.dumps((self.tracker.dump(), self.shots, self.held))

    def _numbers(self, keys: list[np.ndarray]) -> np.ndarray:
        """Shot numbers of rows by their keys; shots that are not known yet follow the known ones."""
        n = len(self.shots["last"])
        keys = [np.concatenate((self.shots[c], k)).astype(np.int64) for c, k in zip(_SHOT, keys)]
        order = np.lexsort(keys)
        opens = np.ones(len(order), bool)
        opens[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = order[opens]
        rank, numbers = np.empty(len(first), np.int64), np.empty(len(order), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        numbers[order] = rank[np.cumsum(opens) - 1]
        at = np.sort(first)[n:]
        if len(at):
            self.shots = {c: np.concatenate((v, k[at])) for (c, v), k in zip(self.shots.items(), [*keys, *[np.full(len(order), _NEVER)] * 3])}
        return numbers[n:]

    def _read(self, b: pd.DataFrame, timed: bool) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """The numbers of a batch's shots and of those that it ends, and its detections; their newest times go to the shots."""
        numbers, ends = self._numbers([b[c].to_numpy() for c in _SHOT]), b["_ends"].to_numpy(bool)
        if timed:
            ms = b["_ms"].to_numpy(float)
            known = ~np.isnan(ms)
            np.maximum.at(self.shots["latest"], numbers[known], ms[known].astype(np.int64))
        ended = np.unique(numbers[ends])
        if len(ended):
            b = b[~ends]
        rows = {"number": numbers[~ends], "frame": b["frame"].astype(np.int64).to_numpy(), "det": b["det"].to_numpy(), "label": b["label"].to_numpy(object), "score": b["score"].to_numpy(float), "box": b[_BOX].to_numpy(float)}
        return np.unique(numbers), ended, rows

    def _late(self, touched: np.ndarray, now: int, idle_ms: int) -> np.ndarray:
        """Move the ends of the shots that have new rows; returns those that are over at the watermark ``now``."""
        s, new = self.shots, np.zeros(len(self.shots["last"]), bool)
        new[touched] = True
        s["latest"][new & (s["latest"] == _NEVER)] = now
        s["due"][new] = np.maximum(s["latest"][new] + idle_ms, now + 1)
        return ~new & (s["due"] < now)

    def track(self, new: Iterable[pd.DataFrame], now: int | None = None, idle_ms: int = 0) -> dict[str, np.ndarray]:
        """Columns of :data:`TRACK_SCHEMA` of the frames that the new rows settle. With a watermark ``now``, shots end by time."""
        read = [self._read(b, now is not None) for b in new if len(b)]
        touched, ended = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in read)]) for i in (0, 1))
        over = np.zeros(len(self.shots["last"]), bool) if now is None else self._late(touched, now, idle_ms)
        over[ended] = True
        rows = ([self.held] if self.held is not None else []) + [x[2] for x in read]
        self.held, read = None, None
        out: list[dict[str, np.ndarray]] = []
        if rows:
            self._advance({c: np.concatenate([x.pop(c) for x in rows]) for c in list(rows[0])}, over, out)
        self._close(over)
        return {c: np.concatenate([x[c] for x in out]) for c in out[0]} if out else {}

    def _advance(self, r: dict[str, np.ndarray], over: np.ndarray, out: list[dict[str, np.ndarray]]) -> None:
        """Track the frames of the rows, without late ones; the newest of a shot that goes on waits. Rows stay where they are until
        their turn."""
        s, n = self.shots, len(over)
        rows = np.lexsort((r["det"], r["frame"], r["number"]))
        number, frame = r["number"][rows], r["frame"][rows]
        starts = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (frame[1:] != frame[:-1])))[:len(number)])
        sizes, of, at = np.diff(np.append(starts, len(number))), number[starts], frame[starts]
        waits = np.append(of[1:] != of[:-1], True)[:len(of)] & ~over[of]
        if waits.any():
            held = rows[np.repeat(waits, sizes)]
            self.held = {c: v[held] for c, v in r.items()}
        go = np.flatnonzero(~waits & (at > s["last"][of]))
        of, at = of[go], at[go]
        turn = np.arange(len(go)) - np.searchsorted(of, of, "left")
        np.maximum.at(s["last"], of, at)
        turns_of = np.bincount(of, minlength=n)
        order = np.lexsort((of, turn))
        go, of, at = go[order], of[order], at[order]
        cuts, first = np.append(0, np.cumsum(np.bincount(turn))), np.append(0, np.cumsum(sizes[go]))
        rows = rows[np.arange(first[-1]) + np.repeat(starts[go] - first[:-1], sizes[go])]
        real = ~pd.isna(r["label"])
        asset, shot = (np.where(s["_null"] & bit, None, s[c]) if (s["_null"] & bit).any() else s[c] for c, bit in (("asset_id", 1), ("shot", 2)))
        frames = np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            done = np.flatnonzero(over & (turns_of == i))
            if len(done):
                self.tracker.end(done)
            frames[of[a:b]] = at[a:b]
            here = rows[first[a]:first[b]]
            here = here[real[here]]
            found = self.tracker.step({"shot": r["number"][here], **{c: r[c][here] for c in ("box", "label", "score")}}, of[a:b])
            if len(found["shot"]):
                out.append(tracked(found, asset, shot, frames))

    def _close(self, over: np.ndarray) -> None:
        """Forget the shots that are over; the others are numbered anew."""
        if not over.any():
            return
        self.tracker.only(~over)
        self.shots = {c: v[~over] for c, v in self.shots.items()}
        if self.held is not None:
            self.held["number"] = (np.cumsum(~over) - 1)[self.held["number"]]


def byte_track_stream(dets: DataFrame, options: TrackerOptions | None = None, ts: str | None = None, delay: str = "1 hour", idle_ms: int = 3_600_000, lanes: int = TRACK_LANES) -> DataFrame:
    """The tracker with its state kept per lane of (asset, shot), each shot for itself.

    The newest frame waits in the state until a later one arrives, so a frame may come in parts over several
    micro-batches; rows of frames older than one already tracked come too late and are dropped. A row without ``det`` ends
    its shot: what waits is tracked and the state is gone. With an event-time column ``ts`` the same happens without such a
    row once the watermark is ``idle_ms`` past the shot's newest row; without one, a shot needs its end row. A query that
    goes on from a checkpoint must keep its ``lanes``."""
    o = options or TrackerOptions()
    cols = [*_SHOT, "frame", "det", "_ends", "label", "score", *_BOX]
    timed = ts is not None
    # without nulls, whole numbers stay whole in pandas
    filled = {c: F.coalesce(c, F.lit(0).cast(dets.schema[c].dataType)) for c in ("asset_id", "shot", "det")}
    keyed = dets.withColumns(filled | {"_lane": F.pmod(F.xxhash64("asset_id", "shot"), F.lit(lanes)), "_ends": F.col("det").isNull(),
                                       "_null": F.col("asset_id").isNull().cast("int") + F.col("shot").isNull().cast("int") * 2})
    source, timeout = _timed(keyed, ["_lane", *cols], ts, delay)
    names = [f.strip().split(" ")[0] for f in TRACK_SCHEMA.split(",")]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        lane = _Lane(o, state.get[0] if state.exists else None)
        now = state.getCurrentWatermarkMs() if timed else None
        out = lane.track([] if state.hasTimedOut else batches, now, idle_ms)
        if len(lane.shots["last"]):
            if timed:
                state.setTimeoutTimestamp(max(int(lane.shots["due"].min()), now))
            state.update((lane.dump(),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return source.groupBy("_lane").applyInPandasWithState(step, TRACK_SCHEMA, "lane binary", "append", timeout)


def _resampled(start: int, last: int, k: int, times: np.ndarray, period_us: int, near_us: int) -> dict:
    """Outputs from number ``k`` on that ``times`` (rising, after ``last``) settle: each lies before the first frame that is not
    earlier than ``near_us`` past it."""
    ks = np.arange(k, max(k, (int(times[-1]) - near_us - start) // period_us + 1), dtype=np.int64)
    at = start + ks * period_us
    j = np.searchsorted(times - near_us, at, "left")
    before, after = np.concatenate(([last], times))[j], times[j]
    copy = np.abs(at - before) <= near_us
    return {"k": ks, "kind": np.where(copy, "copy", "interp"), "a_us": before, "b_us": pd.arrays.IntegerArray(after, copy), "alpha": np.where(copy, 0.0, (at - before) / (after - before))}


def resample_stream(frames: DataFrame, period_us: int, near_us: int = 500, ts: str | None = None, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Output frames every ``period_us`` from each asset's first frame: copy or interpolate between the two
    source frames around it. The state is the last source frame and the next output. frames: asset_id, pts_us.

    With an event-time column ``ts`` the state ends once the watermark is ``idle_ms`` past the asset's newest frame, and its
    grid starts anew when it comes back."""
    source, timeout = _timed(frames, ["asset_id", "pts_us"], ts, delay)
    timed = ts is not None

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, last, k, latest = state.get if state.exists else (None, None, 0, None)
        got = pd.concat(list(batches))
        times = np.unique(got["pts_us"].dropna().to_numpy().astype(np.int64))
        if start is None and len(times):
            start = last = int(times[0])
        times = times[times > last] if len(times) else times
        out = _resampled(start, last, k, times, period_us, near_us) if len(times) else {}
        if len(times):
            k, last = k + len(out["k"]), int(times[-1])
        if start is not None:
            latest = _expire_after(state, idle_ms, timed, got, latest)
            state.update((start, last, k, latest))
        yield pd.DataFrame({"asset_id": key[0], **out}, index=range(len(out["k"]))) if out else pd.DataFrame([], columns=["asset_id", "k", "kind", "a_us", "b_us", "alpha"])

    return source.groupBy("asset_id").applyInPandasWithState(
        step, "asset_id bigint, k bigint, kind string, a_us bigint, b_us bigint, alpha double", "start bigint, last bigint, k bigint, latest bigint", "append", timeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available and return the result as a table in the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{base}/rows")
    else:
        spark.createDataFrame([], stream.schema).write.parquet(f"{base}/rows")  # a stream without rows has no batch
        query = writer.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
