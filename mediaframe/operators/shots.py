"""Shot boundaries from per-frame scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of
from mediaframe.session import cut_lineage

BLOCK = 65_536  # frames per task in windows over dense frame numbers


def _runs(scores: DataFrame, threshold: float) -> DataFrame:
    """Runs of frames at or below the threshold (asset_id, run, start_frame, end_frame). The number of
    transition frames seen so far names the run, so one running sum is enough."""
    hot = (F.col("score") > threshold).cast("bigint")
    s = scores.select("asset_id", "frame", hot.alias("hot"))
    counted = scan.ordered_scan(s, ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), BLOCK),
                                run=scan.running_sum(F.col("hot")))
    return counted.groupBy("asset_id", "run").agg(
        F.min(F.when(F.col("hot") == 0, F.col("frame"))).alias("start_frame"),
        F.max(F.when(F.col("hot") == 0, F.col("frame"))).alias("end_frame"), F.max("frame").alias("top"))


def _numbered_scenes(scores: DataFrame, threshold: float) -> DataFrame:
    """Scenes with their number and the start of the next one; an asset without calm frames keeps one row."""
    # runs are read twice and are far fewer than frames
    runs = cut_lineage(_runs(scores, threshold))
    calm = runs.filter(F.col("start_frame").isNotNull())
    placed = scan.ordered_scan(calm, ["asset_id"], [F.col("run")], bucket_of(F.col("run"), BLOCK),
                               pos=scan.number(), next_start=scan.lead(F.col("start_frame")))
    sizes = runs.groupBy("asset_id").agg((F.max("top") + 1).alias("n_frames"))
    return sizes.join(placed, "asset_id", "left").select(
        "asset_id", F.coalesce(F.col("pos") - 1, F.lit(0)).cast("bigint").alias("scene"),
        F.coalesce("start_frame", F.lit(0)).alias("start_frame"), "next_start", "n_frames",
        F.least(F.coalesce(F.col("end_frame") + 1, F.col("n_frames") - 1), F.col("n_frames") - 1).alias("end_frame"))


def scenes_from_scores(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """asset_id, frame, score -> asset_id, scene, start_frame, end_frame (inclusive).

    A scene is a run of frames at or below the threshold plus the first frame of the transition that ends
    it. An asset that never drops below the threshold is one scene."""
    return _numbered_scenes(scores, threshold).select("asset_id", "scene", "start_frame", "end_frame")


def cut_confidence(cuts: DataFrame, scores: DataFrame) -> DataFrame:
    """cuts (asset_id, frame) -> with ``confidence`` = highest score of the three frames before the cut."""
    reach = cuts.select("asset_id", F.col("frame").alias("cut"),
                        F.explode(F.sequence(F.col("frame") - 3, F.col("frame") - 1)).alias("frame"))
    near = reach.join(scores.select("asset_id", "frame", "score"), ["asset_id", "frame"], "left")
    return near.groupBy("asset_id", F.col("cut").alias("frame")).agg(F.max("score").alias("confidence"))


def shots_from_cuts(cuts: DataFrame, extents: DataFrame, clock: DataFrame, method: str = "scores") -> DataFrame:
    """Inclusive frame ranges from cut frames.

    cuts: asset_id, frame, confidence (nullable); extents: asset_id, n_frames; clock: asset_id, frame, pts_us."""
    inside = cuts.join(extents, "asset_id").filter((F.col("frame") > 0) & (F.col("frame") < F.col("n_frames")))
    inside = inside.groupBy("asset_id", "frame").agg(F.coalesce(F.max("confidence"), F.lit(0.75)).alias("confidence"))
    first = extents.select("asset_id", F.lit(0).cast("bigint").alias("frame"), F.lit(1.0).alias("confidence"))
    starts = inside.unionByName(first)
    placed = scan.ordered_scan(starts, ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), BLOCK),
                               pos=scan.number(), nxt=scan.lead(F.col("frame")))
    spans = placed.join(extents, "asset_id").select(
        "asset_id", (F.col("pos") - 1).alias("shot"), F.col("frame").alias("start_frame"),
        F.coalesce(F.col("nxt") - 1, F.col("n_frames") - 1).alias("end_frame"), "confidence")
    return _with_times(spans, clock).withColumn("method", F.lit(method))


def detect_shots(scores: DataFrame, threshold: float = 0.5, method: str = "scores") -> DataFrame:
    """Frame scores (asset_id, frame, pts_us, score) straight to shots: the first shot starts at frame 0,
    every later scene starts one, and a shot ends where the next begins."""
    s = _numbered_scenes(scores, threshold).select(
        "asset_id", F.col("scene").alias("shot"),
        F.when(F.col("scene") == 0, 0).otherwise(F.col("start_frame")).cast("bigint").alias("start_frame"),
        F.coalesce(F.col("next_start") - 1, F.col("n_frames") - 1).alias("end_frame"))
    cuts = s.filter(F.col("shot") > 0).select("asset_id", F.col("start_frame").alias("frame"))
    strength = cut_confidence(cuts, scores).withColumnRenamed("frame", "start_frame")
    rated = s.join(strength, ["asset_id", "start_frame"], "left").withColumn(
        "confidence", F.when(F.col("shot") == 0, 1.0).otherwise(F.coalesce("confidence", F.lit(0.75))))
    return _with_times(rated, scores).withColumn("method", F.lit(method))


def _with_times(spans: DataFrame, clock: DataFrame) -> DataFrame:
    at_start = clock.select("asset_id", F.col("frame").alias("start_frame"), F.col("pts_us").alias("start_us"))
    at_end = clock.select("asset_id", F.col("frame").alias("end_frame"), F.col("pts_us").alias("end_us"))
    return spans.withColumn(
        "confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))), 4)
    ).join(at_start, ["asset_id", "start_frame"], "left").join(at_end, ["asset_id", "end_frame"], "left")


def sliding_windows(frames: DataFrame, length: int = 100, stride: int = 50, pad: int = 25) -> DataFrame:
    """Padded model windows as rows (asset_id, window_id, pos, frame): the first / last frame repeats as
    padding, and only positions pad .. pad + stride - 1 carry results (``keep``)."""
    n = frames.groupBy("asset_id").agg((F.max("frame") + 1).alias("n_frames"))
    starts = n.select("asset_id", "n_frames", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_frames") - 1) / stride))).alias("window_id"))
    rows = starts.select("asset_id", "n_frames", "window_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("pos"))
    want = F.col("window_id") * stride + F.col("pos") - pad
    return rows.select("asset_id", "window_id", F.col("pos").cast("bigint").alias("pos"),
                       F.least(F.greatest(want, F.lit(0)), F.col("n_frames") - 1).alias("frame"),
                       ((F.col("pos") >= pad) & (F.col("pos") < pad + stride) & (want < F.col("n_frames"))).alias("keep"))


def adaptive_scores(deltas: DataFrame, reach: int = 2, ratio: float = 3.0) -> DataFrame:
    """Content change of a frame over the mean change of its neighbours; ``hit`` marks candidates."""
    padded = scan.halo(deltas, "frame", BLOCK, reach, reach)
    w = Window.partitionBy("asset_id", "_block").orderBy("frame").rangeBetween(-reach, reach)
    out = padded.withColumn("_n", F.count("delta").over(w) - 1).withColumn(
        "_mean", (F.sum("delta").over(w) - F.col("delta")) / F.nullif(F.col("_n"), F.lit(0)))
    return out.filter("_own").select(
        "asset_id", "frame", "delta", F.when(F.col("_mean") > 0, F.col("delta") / F.col("_mean")).otherwise(F.lit(0.0)).alias("ratio")
    ).withColumn("hit", F.col("ratio") >= ratio)


def spaced_hits(hits: DataFrame, min_len: int = 12) -> DataFrame:
    """Keep a hit only when it is at least ``min_len`` frames after the previous kept one (or the start)."""
    from mediaframe.plans.sequential import Processor, sequential

    class Spacer(Processor):
        def start(self, key):
            self.key, self.last = key, 0

        def feed(self, cols):
            keep = []
            for f in cols["frame"]:
                if f - self.last >= min_len:
                    keep.append(f)
                    self.last = f
            if keep:
                return {"asset_id": [self.key[0]] * len(keep), "frame": keep}
            return None

    return sequential(hits.select("asset_id", "frame"), ["asset_id"], ["frame"], "asset_id bigint, frame bigint", Spacer)


def adaptive_cuts(deltas: DataFrame, ratio: float = 3.0, min_len: int = 12) -> DataFrame:
    return spaced_hits(adaptive_scores(deltas, ratio=ratio).filter("hit"), min_len)
