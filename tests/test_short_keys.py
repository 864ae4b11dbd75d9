"""Short keys are numbered and paired without summaries and tiles; long ones beside them keep theirs."""

from pyspark.sql import functions as F

from mediaframe.plans import scan
from mediaframe.plans.tiles import tiled_self_join


def _rows(spark):
    """Groups of three rows, one of 400, and rows without a group."""
    rows = [(g, 10 * g + i, float(i % 2)) for g in range(20) for i in range(3)] + [(99, 5000 + i, float(i % 7)) for i in range(400)] + [(None, -i, 0.0) for i in range(1, 4)]
    return spark.createDataFrame(rows, "g bigint, id bigint, v double").repartition(4)


def test_numbers(spark):
    df = _rows(spark)
    want = {}
    for g in {r.g for r in df.collect()}:
        own = sorted((r.v, r.id) for r in df.collect() if r.g == g)
        want |= {i: n for n, (_, i) in enumerate(own, 1)}
    for rows in (2, 50, 10_000):
        got = scan.numbered(df, ["g"], [F.col("v"), F.col("id")], F.col("v").cast("bigint"), "n", rows)
        assert dict(got.dtypes)["n"] == "bigint" and {r.id: r.n for r in got.collect()} == want


def test_short_keys_move_once(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("g"), "id", F.lit(1.0).alias("v"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert plan(scan.numbered(df, ["g"], [F.col("id")], F.col("id"), "n")) == 1


def test_pairs(spark):
    df = _rows(spark)
    rows = [tuple(r) for r in df.collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[1] and a[2] == b[2]}
    for tile in (2, 50, 2048):
        got = [(r.a_id, r.b_id) for r in tiled_self_join(df, ["g"], "id", F.col("a_v") == F.col("b_v"), tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_findings_are_made_once(spark):
    """What reads its findings twice reads a written table, not the joins that made them."""
    from mediaframe.operators import detections as op

    box = [F.lit(float(v)).alias(f"{s}_{n}") for s in "pd" for n, v in zip(("x1", "y1", "x2", "y2"), (0, 0, 10, 10))]
    ids = [F.col("id").alias(f"{s}_{n}") for s in "pd" for n in ("det", "track_id")]
    found = spark.range(6).select(F.lit(1).cast("bigint").alias("shot_id"), F.col("id").alias("frame_id"), F.lit("A").alias("character"), *ids, *box)
    for fn, rows in ((op.confirm_findings, 6), (op.harmonize_roles, 6), (op.dedupe_findings, 1)):
        out = fn(found)
        assert "Range (" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == rows
