"""Every probe vector against every reference vector, as bounded matrix tiles.

A reference bank of at most ``BANK_ROWS`` rows, which is checked, is broadcast: probes are dealt out evenly and
multiplied slice by slice. A larger bank is hashed into tiles, and each (probe tile, reference tile) is one
task-sized matrix product. Only summary rows (top k per owner, softmax mass) leave a product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.plans.blocks import packed

#: The largest tiles: a row is sent once for each tile of the other side, so that small ones would move most of the time.
PROBE_ROWS = 16_384
REFERENCE_ROWS = 65_536
LEAST_ROWS = 2048
#: The largest bank that is broadcast; with 128 numbers a row about 32 MB.
BANK_ROWS = 32_768
SLICE = 64  # probes multiplied at once inside a tile: with the largest tile 32 MB


def _tiles(df: DataFrame, rows: int) -> int:
    """Tiles of at most about ``rows`` rows, smaller ones where the cores would go without."""
    n, side = df.count(), isqrt(4 * df.sparkSession.sparkContext.defaultParallelism) + 1
    return max(1, -(-n // min(rows, max(LEAST_ROWS, -(-n // side)))))


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def tiled_products(probes: DataFrame, refs: DataFrame, probe_id: str, ref_id: str, schema: str,
                   bind: Callable[[pd.DataFrame], Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]], order: list[str] | None = None) -> DataFrame:
    """``bind(reference_rows)`` is called per tile, sorted by ``order``, and what it returns per slice, as ``reduce(probe_rows, cosines)``;
    both sides need ``embedding``, which the rows come without. The cosines may be changed in place."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    spark = probes.sparkSession

    def ready(b: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        b = b.sort_values(order, kind="stable", ignore_index=True) if order else b
        return b.drop(columns="embedding"), unit(b["embedding"])

    def products(a: pd.DataFrame, reduce, mb: np.ndarray) -> Iterator[pd.DataFrame]:
        rows = a.drop(columns="embedding")
        for s in range(0, len(a), SLICE):
            yield reduce(rows.iloc[s:s + SLICE], unit(a["embedding"].iloc[s:s + SLICE]) @ mb.T)

    if refs.limit(BANK_ROWS + 1).count() <= BANK_ROWS:
        few = refs.toPandas()
        shared = spark.sparkContext.broadcast(ready(few) if len(few) else None)

        def stay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if shared.value is not None:
                b, mb = shared.value
                reduce = bind(b)
                yield from packed(part[names] for a in batches if len(a) for part in products(a, reduce, mb))

        # products are all CPU: spread the probes evenly instead of by the bytes of their files
        return probes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), probe_id).mapInPandas(stay, schema)

    np_, nr = _tiles(probes, PROBE_ROWS), _tiles(refs, REFERENCE_ROWS)
    p = probes.withColumn("_pt", F.pmod(F.xxhash64(probe_id), F.lit(np_)).cast("int")).withColumn(
        "_rt", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = refs.withColumn("_rt", F.pmod(F.xxhash64(ref_id), F.lit(nr)).cast("int")).withColumn(
        "_pt", F.explode(F.sequence(F.lit(0), F.lit(np_ - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b, mb = ready(b)
        return pd.concat(list(products(a, bind(b), mb)), ignore_index=True)[names]

    return p.groupBy("_pt", "_rt").cogroup(r.groupBy("_pt", "_rt")).applyInPandas(run, schema)
