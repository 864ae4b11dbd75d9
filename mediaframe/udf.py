"""Hooks for user models. Models run inside Arrow-batched tasks; rules around them stay in Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from mediaframe.operators.detections import merge_passes
from mediaframe.session import cut_lineage

DET_SCHEMA = "asset_id bigint, frame bigint, det bigint, label string, score double, x1 double, y1 double, x2 double, y2 double"


def with_detector(frames: DataFrame, detect: Callable[[pd.DataFrame], list[list[tuple]]], threshold: float, floor: float | None = None) -> DataFrame:
    """Many rows out per frame. ``detect(batch)`` returns per row a list of (label, score, x1, y1, x2, y2); rows at
    or above ``floor`` (default: the threshold) are kept and ``used`` marks those above the threshold. frames: asset_id, frame, ..."""
    low = threshold if floor is None else floor

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, f, i, *d) for a, f, dets in zip(pdf["asset_id"], pdf["frame"], detect(pdf)) for i, d in enumerate(dets, 1)]
            yield pd.DataFrame(rows, columns=["asset_id", "frame", "det", "label", "score", "x1", "y1", "x2", "y2"])

    return frames.mapInPandas(run, DET_SCHEMA).filter(F.col("score") >= low).withColumn("used", F.col("score") >= threshold)


def embedder(embed: Callable[[pd.Series], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from crops to unit vectors; the model sees whole batches."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for crops in batches:
            m = np.asarray(embed(crops), dtype=np.float64)
            yield pd.Series(list((m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)).astype(np.float32)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(FloatType()))


def with_frame_scores(windows: DataFrame, score: Callable[[np.ndarray], np.ndarray], value: str) -> DataFrame:
    """Model windows (asset_id, window_id, pos, frame, keep, ``value``) to one score per frame. A window is a
    group of fixed length; only its kept positions report."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("pos")
        out = np.asarray(score(p[value].to_numpy()), dtype=float)
        k = p["keep"].to_numpy(dtype=bool)
        return pd.DataFrame({"asset_id": p["asset_id"][k], "frame": p["frame"][k], "score": out[k]})

    return windows.groupBy("asset_id", "window_id").applyInPandas(run, "asset_id bigint, frame bigint, score double")


def guarded(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``model(batch)`` over rows with a shot_id, with a column ``error``: a shot for which the model raises gives one row per
    batch that holds its reason and nothing else. A batch that raises is tried again shot by shot, so that the others keep
    their rows. ``schema`` starts with shot_id."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def attempt(part: pd.DataFrame) -> pd.DataFrame:
        return model(part)[names].assign(error=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield attempt(pdf)
                continue
            except Exception:
                pass  # found again below, by shot
            for shot, part in pdf.groupby("shot_id", sort=False):
                try:
                    yield attempt(part)
                except Exception as reason:
                    yield pd.DataFrame({n: [shot if n == "shot_id" else None] for n in names} | {"error": [f"{type(reason).__name__}: {reason}"]})

    return rows.mapInPandas(run, f"{schema}, error string")


def cascade(shots: DataFrame, cheap: Callable[[DataFrame], DataFrame], strong: Callable[[DataFrame], DataFrame], stats: Callable[[DataFrame, DataFrame], DataFrame],
            sparse: Callable[[DataFrame, DataFrame], DataFrame] | None = None, fine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The findings of ``cascade_report``. Findings: shot_id, character, ..."""
    return cascade_report(shots, cheap, strong, stats, sparse, fine)[0]


def cascade_report(shots: DataFrame, cheap: Callable[[DataFrame], DataFrame], strong: Callable[[DataFrame], DataFrame], stats: Callable[[DataFrame, DataFrame], DataFrame],
                   sparse: Callable[[DataFrame, DataFrame], DataFrame] | None = None, fine: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cheap findings for every shot, strong ones only where ``stats`` (shot_id, reason) gives a reason.

    Shots that ``sparse`` (shot_id) names run once more through ``fine`` (say, at full resolution), which replaces the cheap
    findings where it has more; the reasons are judged after that. A shot without a strong result keeps the one it
    has, and so does one whose strong model failed (rows with ``error``, see ``guarded``). Named findings that only the
    first pass has are kept. Every model runs once: its findings are written down.

    Returns the findings with ``stage`` (cheap, fine, strong), and per shot with a reason (shot_id, reason, stage, warning)."""
    first = cut_lineage(cheap(shots).withColumn("stage", F.lit("cheap")))
    if sparse is not None and fine is not None:
        again = fine(shots.join(sparse(shots, first.drop("stage")), "shot_id", "left_semi"))
        again = cut_lineage(again.withColumn("stage", F.lit("fine")))
        n = lambda df, name: df.groupBy("shot_id").agg(F.count("*").alias(name))
        more = n(again, "_n").join(n(first, "_m"), "shot_id", "left").filter(F.col("_n") > F.coalesce("_m", F.lit(0))).select("shot_id")
        first = cut_lineage(first.join(more, "shot_id", "left_anti").unionByName(again.join(more, "shot_id", "left_semi")))
    reasons = stats(shots, first.drop("stage")).filter(F.col("reason").isNotNull()).select("shot_id", "reason")
    second = cut_lineage(strong(shots.join(reasons, "shot_id", "left_semi")))
    failed = None
    if "error" in second.columns:
        failed = second.filter(F.col("error").isNotNull()).groupBy("shot_id").agg(F.min("error").alias("warning"))
        second = second.join(failed, "shot_id", "left_anti").drop("error")
    done = second.select("shot_id").distinct()
    merged = merge_passes(first.drop("stage").join(done, "shot_id", "left_semi"), second).withColumn("stage", F.lit("strong"))
    report = reasons.join(done.withColumn("_done", F.lit(True)), "shot_id", "left").join(first.groupBy("shot_id").agg(F.max("stage").alias("_first")), "shot_id", "left")
    report = report.join(failed, "shot_id", "left") if failed is not None else report.withColumn("warning", F.lit(None).cast("string"))
    report = report.select("shot_id", "reason", F.when(F.col("_done"), "strong").otherwise(F.coalesce("_first", F.lit("cheap"))).alias("stage"), "warning")
    return first.join(done, "shot_id", "left_anti").unionByName(merged), report
