"""Range and as-of joins that stay equi-joins on (key, bucket)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.plans import scan


def bucket_of(value: Column, width) -> Column:
    return F.floor(value / width).cast("bigint")


def range_join(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width,
               how: str = "inner", closed_end: bool = False, open_start: bool = False) -> DataFrame:
    """Points inside ``[start, end)`` of the same key. Spans are copied into every bucket they touch, so
    the join hashes on (key, bucket) and one busy key spreads over its buckets; the exact bounds are part
    of the join condition. ``how`` may be inner, left, left_semi or left_anti (seen from the points)."""
    p = points.withColumn("_bucket", bucket_of(F.col(at), width))
    s = spans.select(
        *[F.col(k).alias(f"_k_{k}") for k in by],
        *[c for c in spans.columns if c not in by],
    ).withColumn(
        "_span_bucket",
        F.explode(F.sequence(bucket_of(F.col(start), width), F.greatest(bucket_of(F.col(start), width),
                                                                         bucket_of(F.col(end), width)))),
    )
    upper = F.col(at) <= F.col(end) if closed_end else F.col(at) < F.col(end)
    cond = (F.col("_bucket") == F.col("_span_bucket")) & (F.col(at) > F.col(start) if open_start else F.col(at) >= F.col(start)) & upper
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    out = p.join(s, cond, how)
    return out.drop("_bucket", "_span_bucket", *[f"_k_{k}" for k in by])


def bracket_join(left: DataFrame, right: DataFrame, by: list[str], at: str, time: str, payload: list[str],
                 width, tie: str | None = None, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """For every left row the right row at or before it (``lo``) and the first one after it (``hi``), as
    structs of ``payload``. One union and one ordered scan: no self product, no per-key task."""
    pay = F.struct(*[F.col(c) for c in payload])
    tie_col = F.col(tie).cast("double") if tie else F.lit(0.0)
    r = right.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), tie_col.alias("_tie"),
                     pay.alias("_pay"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    lrow = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(0.0).alias("_tie"),
                       F.lit(None).cast(r.schema["_pay"].dataType).alias("_pay"),
                       F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = r.unionByName(lrow)
    scanned = scan.ordered_scan(
        both, by, [F.col("_t"), F.col("_side"), F.col("_tie")], bucket_of(F.col("_t"), width),
        **{lo: scan.last(F.col("_pay")), hi: scan.following(F.col("_pay"))},
    )
    return scanned.filter(F.col("_side") == 1).select("_row.*", lo, hi)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], width) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap. Of two such intervals one starts inside the other, so this
    is two disjoint point-in-interval joins. Both sides hold no empty interval and, beside ``by``, no common column."""
    starts_inside = range_join(left, right, by, left_ends[0], *right_ends, width)
    holds_start = range_join(right, left, by, right_ends[0], *left_ends, width, open_start=True)
    return starts_inside.unionByName(holds_start)
