"""Pairs inside a group without handing a whole group to one task.

A group with more rows than one tile is cut into tiles of about ``tile_rows`` rows and every pair of
tiles becomes its own join key, so a hot frame is spread over many tasks. The caller's condition is part
of the join, so only matching pairs leave it; nothing is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.session import cut_lineage


def tile_counts(df: DataFrame, by: list[str], tile_rows: int) -> DataFrame:
    """Tiles per group, only for groups that need more than one (at most rows / tile_rows of them)."""
    return (
        df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > tile_rows)
        .select(*by, F.ceil(F.col("_n") / tile_rows).cast("int").alias("_tiles"))
    )


def tiled_self_join(df: DataFrame, by: list[str], uid: str, condition: Column, tile_rows: int = 2048) -> DataFrame:
    """All pairs a.uid < b.uid of one group that satisfy ``condition`` (written on ``a_*`` / ``b_*``
    columns). ``uid`` must be unique inside a group."""
    tiles = cut_lineage(tile_counts(df, by, tile_rows))
    if tiles.isEmpty():
        return _whole_groups(df, by, uid, condition)
    tiles = F.broadcast(tiles)  # at most one group in ``tile_rows`` rows
    small = _whole_groups(df.join(tiles, by, "left_anti"), by, uid, condition)
    t = df.join(tiles, by)
    t = t.withColumn("_own", F.pmod(F.xxhash64(uid), F.col("_tiles")).cast("int"))
    values = [c for c in df.columns if c not in by]
    partner = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    low = t.withColumn("_other", partner).select(
        *by, F.least("_own", "_other").alias("_ta"), F.greatest("_own", "_other").alias("_tb"), F.col("_own").alias("a_tile"),
        *[F.col(c).alias(f"a_{c}") for c in values])
    high = t.withColumn("_other", partner).select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.least("_own", "_other").alias("_ka"),
        F.greatest("_own", "_other").alias("_kb"), F.col("_own").alias("b_tile"),
        *[F.col(c).alias(f"b_{c}") for c in values])
    # a pair of rows from tiles (x, y) meets only under key (min, max); inside one tile under (x, x)
    apart = ((F.col("a_tile") != F.col("b_tile")) | (F.col("_ta") == F.col("_tb")))
    cond = ((F.col("_ta") == F.col("_ka")) & (F.col("_tb") == F.col("_kb")) & apart
            & (F.col(f"a_{uid}") < F.col(f"b_{uid}")) & condition)
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return small.unionByName(low.join(high, cond, "inner").drop("_ta", "_tb", "_ka", "_kb", "a_tile", "b_tile", *[f"_k_{k}" for k in by]))


def _whole_groups(df: DataFrame, by: list[str], uid: str, condition: Column) -> DataFrame:
    """The pairs of groups of one tile: they meet by their key alone, so rows that lie by it don't move again."""
    values = [c for c in df.columns if c not in by]
    low = df.select(*by, *[F.col(c).alias(f"a_{c}") for c in values])
    high = df.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[F.col(c).alias(f"b_{c}") for c in values])
    cond = (F.col(f"a_{uid}") < F.col(f"b_{uid}")) & condition
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return low.join(high, cond).drop(*[f"_k_{k}" for k in by])


def tiled_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_uid: str, right_uid: str, condition: Column, tile_rows: int = 2048) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows of one group that satisfy ``condition``. A group with many rows on either
    side is cut into tiles by the rows' ids, and every pair of tiles is a join key of its own."""
    def cut(df: DataFrame, key: str, uid: str, own: str, n: str, other: DataFrame | None) -> DataFrame:
        t = df.join(tile_counts(df, [key], tile_rows).withColumnRenamed("_tiles", n), key, "left").withColumn(n, F.coalesce(n, F.lit(1)))
        t = t.withColumn(own, F.pmod(F.xxhash64(uid), F.col(n)).cast("int")).drop(n)
        if other is None:
            return t.withColumn(f"{own}_other", F.lit(0))
        return t.join(other, key, "left").withColumn(f"{own}_other", F.explode(F.sequence(F.lit(0), F.coalesce("_many", F.lit(1)) - 1))).drop("_many")

    many = lambda df, key, to: tile_counts(df, [key], tile_rows).select(F.col(key).alias(to), F.col("_tiles").alias("_many"))
    a = cut(left, left_key, left_uid, "_la", "_ln", many(right, right_key, left_key))
    b = cut(right, right_key, right_uid, "_ra", "_rn", many(left, left_key, right_key))
    met = (F.col(left_key) == F.col(right_key)) & (F.col("_la") == F.col("_ra_other")) & (F.col("_la_other") == F.col("_ra")) & condition
    return a.join(b, met).drop("_la", "_la_other", "_ra", "_ra_other")
