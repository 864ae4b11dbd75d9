"""Exact interpolated quantiles and salted top-k, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of


def exact_quantile(df: DataFrame, by: list[str], value: str, qs: dict[str, float], width: float) -> DataFrame:
    """One row per key with the linearly interpolated quantiles. Ranks come from an ordered scan chunked by
    value (``width``), so neither a sort nor a value map of a whole key is needed."""
    keyed = df.filter(F.col(value).isNotNull()).select(*by, value)
    ranked = scan.ordered_scan(keyed, by, [F.col(value)], bucket_of(F.col(value), width),
                               _pos=scan.number(), _n=scan.total(F.lit(1)))
    at = {name: F.lit(q) * (F.col("_n") - 1) for name, q in qs.items()}
    rank0 = F.col("_pos") - 1
    aggs = []
    for name, t in at.items():
        aggs += [F.max(F.when(rank0 == F.floor(t), F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(rank0 == F.ceil(t), F.col(value))).alias(f"_hi_{name}"),
                 F.max(t - F.floor(t)).alias(f"_f_{name}")]
    near = F.lit(False)
    for t in at.values():
        near = near | (rank0 == F.floor(t)) | (rank0 == F.ceil(t))
    out = ranked.filter(near).groupBy(*by).agg(*aggs, F.max("_n").alias("n"))
    return out.select(*by, "n", *[(F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_f_{q}")).alias(q) for q in qs])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: Column, rank: str = "rank", salts: int = 32) -> DataFrame:
    """Rows ranked 1..k in their group, ``k`` being a column that is constant in the group. Each salted part
    keeps its own best k first, so a huge group is thinned in parallel before the final ranking."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    thin = salted.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= k).drop("_salt")
    return thin.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)
