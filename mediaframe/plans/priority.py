"""Greedy suppression without a serial loop: the independent set that visiting rows in order would give.

Visiting rows best first and keeping each one that no kept row blocks is decided by the conflict pairs alone. A row that
nothing better blocks is kept, and what it blocks is gone; taking both out of the pairs leaves a smaller problem
of the same kind. Rounds go on until no pair is left: about the logarithm of the group for pairs in no particular order, in
the worst case half of the longest chain of rows that block each other one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import geometry as g
from mediaframe.plans.tiles import tiled_self_join
from mediaframe.session import cut_lineage


def keep_best(rows: DataFrame, by: list[str], uid: str, blocks: Column) -> DataFrame:
    """(by, uid) of the rows that are kept. rows: by, uid (unique in a group), ``rank`` (lowest first, ties by uid), the box
    x1..y2 (boxes that don't meet never block each other) and what ``blocks`` needs, a condition on the better row's ``a_*`` and the worse row's ``b_*`` columns."""
    cols = [c for c in rows.columns if c not in by]
    swapped = [F.when(F.col("_a_first"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in cols]
    pairs = tiled_self_join(rows, by, uid, g.intersects(g.box("a_"), g.box("b_"))).withColumn("_a_first", F.col("a_rank") <= F.col("b_rank"))
    pairs = pairs.select(*by, *swapped).filter(blocks)
    pairs = cut_lineage(pairs.select(*by, F.col(f"a_{uid}").alias("_better"), F.col(f"b_{uid}").alias("_worse")))
    gone: list[DataFrame] = []
    while not pairs.isEmpty():
        blocked = pairs.select(*by, F.col("_worse").alias("_better")).distinct()
        out = cut_lineage(pairs.join(blocked, [*by, "_better"], "left_anti").select(*by, "_worse").distinct())
        gone.append(out)
        pairs = pairs.join(out, [*by, "_worse"], "left_anti").join(out.withColumnRenamed("_worse", "_better"), [*by, "_better"], "left_anti")
        pairs = cut_lineage(pairs)
    kept = rows.select(*by, uid)
    if gone:
        kept = kept.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("_worse", uid), [*by, uid], "left_anti")
    return kept
