"""Suppression in rounds, the cascade with failing models, head crops and streamed identity against plain loops."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mediaframe import udf
from mediaframe.operators import detections, identity
from mediaframe.streaming import streams

DETS = "frame_id bigint, det bigint, label string, score double, x1 double, y1 double, x2 double, y2 double"


def _boxes(rng, frames, hot):
    """Boxes in clusters; one frame holds ``hot`` of them. Scores have many ties, some labels are null."""
    rows = []
    for frame, n in enumerate([hot] + [6] * frames):
        for det in range(n):
            x, y = (float(v) for v in rng.integers(0, 12, 2) * 40 + rng.integers(-9, 9, 2))
            rows.append((frame, det, [None, "a", "b"][rng.integers(3)], float(rng.integers(1, 9)) / 10, x, y, x + float(rng.integers(20, 60)), y + float(rng.integers(20, 60))))
    rows.append((frames + 1, 0, "a", 0.5, 5.0, 5.0, 5.0, 5.0))
    return rows


def _kept(rows, rank, blocks):
    out = set()
    for frame in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda r: (rank(r), r[1])):
            if not any(blocks(k, r) for k in kept):
                kept.append(r)
        out |= {(frame, k[1]) for k in kept}
    return out


def _inter(a, b):
    return max(min(a[6], b[6]) - max(a[4], b[4]), 0) * max(min(a[7], b[7]) - max(a[5], b[5]), 0)


def _area(r):
    return (r[6] - r[4]) * (r[7] - r[5])


def test_suppression_in_rounds_equals_the_greedy_loop(spark):
    rows = _boxes(np.random.default_rng(11), 40, 3000)
    df = spark.createDataFrame(rows, DETS)
    iou = lambda a, b: _inter(a, b) / max(_area(a) + _area(b) - _inter(a, b), 1e-12)
    got = {tuple(r) for r in detections.nms(df, 0.3).collect()}
    assert got == _kept(rows, lambda r: -r[3], lambda k, r: k[2] == r[2] and iou(k, r) > 0.3) and len(got) < len(rows)
    nested = {tuple(r) for r in detections.nested_filter(df, 0.8).collect()}
    assert nested == _kept(rows, lambda r: -_area(r), lambda k, r: _inter(k, r) / max(1e-6, _area(r)) > 0.8)
    assert detections.nms(df.where("false")).collect() == []


def test_suppression_of_a_chain(spark):
    # every box is blocked by the one before it only
    rows = [(0, d, "a", 1.0 - d / 100, 10.0 * d, 0.0, 10.0 * d + 19.0, 10.0) for d in range(13)]
    got = {r.det for r in detections.nms(spark.createDataFrame(rows, DETS), 0.2).collect()}
    assert got == set(range(0, 13, 2))


def test_suppression_has_no_python_and_splits_a_hot_frame(spark):
    df = spark.range(20_000).select(F.lit(1).cast("bigint").alias("frame_id"), F.col("id").alias("det"), F.lit("a").alias("label"), F.rand(1).alias("score"),
                                    (F.col("id") * 30.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * 30.0 + 40).alias("x2"), F.lit(10.0).alias("y2"))
    from mediaframe.plans.tiles import tiled_self_join

    keys = tiled_self_join(df.select("frame_id", "det", "x1", "x2"), ["frame_id"], "det", F.col("a_x2") > F.col("b_x1"))
    assert "Python" not in keys._jdf.queryExecution().toString()
    kept = detections.nms(df, 0.1)
    assert "Python" not in kept._jdf.queryExecution().toString() and "MapIn" not in kept._jdf.queryExecution().toString()
    parts = keys.select(F.spark_partition_id().alias("p"), "a_det").groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 0.7 * sum(r["count"] for r in parts)


def test_cascade_keeps_the_findings_of_a_failing_model(spark):
    shots = spark.createDataFrame([(s, f) for s in range(6) for f in range(4)], "shot_id bigint, frame bigint")
    schema = "shot_id bigint, frame bigint, character string"

    def cheap(s):
        return s.filter((F.col("shot_id") != 5) & (F.col("frame") == 0)).select("shot_id", "frame", F.lit("ann").alias("character"))

    def model(pdf):
        if (pdf["shot_id"] == 2).any():
            raise MemoryError("too large")
        return pd.DataFrame({"shot_id": pdf["shot_id"], "frame": pdf["frame"], "character": "bob"})

    def reasons(s, found):
        return s.select("shot_id").distinct().filter("shot_id in (1, 2, 5)").withColumn("reason", F.lit("nothing found"))

    def fine(s):
        return s.filter("frame < 2 or shot_id = 3").select("shot_id", "frame", F.when(F.col("shot_id") == 4, "cat").alias("character"))

    found, report = udf.cascade_report(shots, cheap, lambda s: udf.guarded(s, model, schema), reasons,
                                       lambda s, f: s.select("shot_id").distinct().filter("shot_id >= 4"), fine)
    got = sorted((r.shot_id, r.frame, r.character, r.stage) for r in found.fillna("?", ["character"]).collect())
    strong = [(s, f, "bob", "strong") for s in (1, 5) for f in range(4)]
    assert got == sorted([(0, 0, "ann", "cheap"), (2, 0, "ann", "cheap"), (3, 0, "ann", "cheap"), (1, 0, "ann", "strong"), (4, 0, "cat", "fine"), (4, 1, "cat", "fine"), *strong])
    assert sorted(map(tuple, report.fillna("", ["warning"]).collect())) == [
        (1, "nothing found", "strong", ""), (2, "nothing found", "cheap", "MemoryError: too large"), (5, "nothing found", "strong", "")]


def _unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def test_heads_count_where_they_are_better(spark):
    rng = np.random.default_rng(12)
    refs = [(i, i % 4, i // 2, i % 3 == 0, rng.normal(size=6)) for i in range(40)]
    probes = [(i, rng.normal(size=6), rng.normal(size=6) if i % 2 else None) for i in range(30)]
    bank = spark.createDataFrame([(a, b, c, d, e.tolist()) for a, b, c, d, e in refs], "ref_id bigint, owner int, crop_group bigint, head boolean, embedding array<double>")
    df = spark.createDataFrame([(i, e.tolist(), h.tolist() if h is not None else None) for i, e, h in probes], "vec_id bigint, embedding array<double>, head array<double>")
    got = {(r.vec_id, r.owner): r.score for r in identity.owner_scores_with_heads(df, bank).collect()}
    want = {}
    for i, body, head in probes:
        for kind, vector in ((False, body), (True, head)):
            if vector is None:
                continue
            for owner in range(4):
                groups: dict = {}
                for _, o, group, h, e in refs:
                    if o == owner and h == kind:
                        groups[group] = max(groups.get(group, -2.0), float(_unit(e) @ _unit(vector)))
                if groups:
                    want[i, owner] = max(want.get((i, owner), -2.0), float(np.mean(sorted(groups.values())[-3:])))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_streamed_identity_takes_one_bank_per_batch(spark, tmp_path):
    rng = np.random.default_rng(13)
    schema = "vec_id bigint, embedding array<double>"
    probes = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    for part in (probes[:25], probes[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bank = spark.createDataFrame([(i, i % 4, i, rng.normal(size=6).tolist()) for i in range(20)], "ref_id bigint, owner int, crop_group bigint, embedding array<double>")
    asked = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = streams.identify_stream(stream, lambda: asked.append(1) or bank, 0.4, 0.05)
    want = identity.identify(identity.owner_scores(spark.createDataFrame(probes, schema), bank), 0.4, 0.05)
    rows = lambda df: sorted((r.vec_id, r.best, round(r.score, 9), round(r.margin, 9), r.owner if r.owner is not None else -1) for r in df.select(*want.columns).collect())
    assert rows(got) == rows(want) and len(asked) == 2
