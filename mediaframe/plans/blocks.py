"""Numeric work on bounded blocks of a dense series, and linear recurrences joined across blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.plans.scan import halo
from mediaframe.plans.sequential import Processor, sequential
from mediaframe.session import cut_lineage


def blockwise(df: DataFrame, by: list[str], index: str, size: int, before: int, after: int,
              fn: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str) -> DataFrame:
    """``fn(rows sorted by index, first own index, end of own indices)`` per block of ``size`` rows plus its
    halo. No group exceeds size + before + after rows, however long the series is."""

    keys = [*by, "_block"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, keys):
            block = int(group["_block"].iloc[0])
            out = fn(group, block * size, (block + 1) * size)
            if len(out):
                yield out

    # numeric work is CPU-bound: keep every shuffle partition instead of letting them merge by bytes
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = halo(df, index, size, before, after).repartition(parts, *keys).sortWithinPartitions(*keys, index)
    return rows.mapInPandas(lambda batches: packed(run(batches)), schema)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches sorted by ``keys``; many short keys share one batch. Holds one batch and one key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        pair = pd.concat([held[-1].iloc[-1:], pdf]) if held else pdf
        change = np.zeros(len(pair), dtype=bool)
        for k in keys:
            c = pair[k].to_numpy()
            gone = pd.isna(c)
            change[1:] |= np.where(gone[1:] | gone[:-1], gone[1:] != gone[:-1], c[1:] != c[:-1])
        cuts = np.flatnonzero(change[1:] if held else change).tolist()
        if cuts and held:
            yield pd.concat([*held, pdf.iloc[: cuts[0]]], ignore_index=True)
        if cuts:
            edges = cuts if held else [0, *cuts]
            for s, e in zip(edges, edges[1:]):
                yield pdf.iloc[s:e].reset_index(drop=True)
            held = []
        held.append(pdf.iloc[cuts[-1] if cuts else 0 :])
    if held:
        yield pd.concat(held, ignore_index=True)


def packed(found: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """Small results joined to frames of about ``rows`` rows."""
    held: list[pd.DataFrame] = []
    for out in found:
        held.append(out)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def averages(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str], alpha: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` and order: the moving averages of ``values`` from zero, anew for each key, and ``_k``, the weight of what
    came before the key's first row. The series of a batch advance together, a row each per turn; the newest average
    of the last one goes on in the next batch."""
    keep = 1.0 - alpha
    last: tuple | None = None
    carry, before = np.zeros(len(values)), 0
    for pdf in batches:
        n = len(pdf)
        if not n:
            continue
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for k in keys:
            c = pdf[k].to_numpy()
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, n))
        x = pdf[values].to_numpy(dtype=np.float64)
        out, acc = np.empty_like(x), np.zeros((len(starts), x.shape[1]))
        place = np.arange(1, n + 1) - np.repeat(starts, sizes)
        if last == tuple(pdf[k].iloc[0] for k in keys):
            acc[0] = carry
            place[: sizes[0]] += before
        order = np.argsort(-sizes, kind="stable")  # the series that go on longest come first
        starts, acc = starts[order], acc[order]
        live = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
        for turn, m in enumerate(live.tolist()):
            acc[:m] = alpha * x[starts[:m] + turn] + keep * acc[:m]
            out[starts[:m] + turn] = acc[:m]
        last, carry, before = tuple(pdf[k].iloc[-1] for k in keys), out[-1].copy(), int(place[-1])
        yield pdf[keys[:-1]].assign(**{c: pdf[c] for c in pdf.columns if c not in keys and c not in values}, _b=pdf[keys[-1]], _k=np.power(keep, place.astype(np.float64)), **{v: out[:, j] for j, v in enumerate(values)})


def zero_phase(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str], alpha: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` and order, whole series: their ``values`` averaged forward from the first and then back from the last
    one, other columns as they are. The series of a batch advance together, a row each per turn; holds one batch and one series."""
    keep = 1.0 - alpha

    def averaged(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sizes = np.diff(np.append(starts, len(pdf)))
        order = np.argsort(-sizes, kind="stable")  # the series that go on longest come first
        starts, sizes = starts[order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(sizes.max()), side="left").tolist()
        x, weight = pdf[values].to_numpy(dtype=np.float64), np.power(keep, np.arange(1, len(live) + 1, dtype=np.float64)).tolist()
        for first, step in ((starts, 1), (starts + sizes - 1, -1)):
            # as in :func:`ema`: averaged from zero, the first value enters with its weight
            out, acc = np.empty_like(x), np.zeros((len(first), x.shape[1]))
            for turn, m in enumerate(live):
                at = first[:m] + step * turn
                acc[:m] = alpha * x[at] + keep * acc[:m]
                out[at] = acc[:m] + weight[turn] * x[first[:m]]
            x = out
        return pdf.assign(**{v: x[:, j] for j, v in enumerate(values)})

    def starting(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            c = pdf[k].to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        starts = starting(pdf)
        goes_on = bool(held) and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys)
        if goes_on and len(starts) == 1:
            held.append(pdf)
            continue
        cut = int(starts[-1])
        whole = [*held, pdf.iloc[:cut]] if cut else held
        if whole:
            done = pd.concat(whole, ignore_index=True)
            yield averaged(done, starting(done))
        held = [pdf.iloc[cut:]]
    if held:
        done = pd.concat(held, ignore_index=True)
        yield averaged(done, np.zeros(1, dtype=np.int64))


def ema(df: DataFrame, by: list[str], index: str, values: list[str], alpha: float, size: int = 8192, backwards: bool = False) -> DataFrame:
    """Exponential moving average over a dense index, started with the first value.

    Blocks are averaged from zero in parallel; the value carried into each block comes from a pass over one
    row per block and enters with weight (1 - alpha)^k. Returns by, index and the averaged ``values``."""
    keep = 1.0 - alpha
    data = df.select(*by, index, *values)
    if backwards:
        data = data.join(data.groupBy(*by).agg(F.max(index).alias("_top")), by).withColumn(index, F.col("_top") - F.col(index))
    types = dict(df.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in by)
    schema = f"{keys}, {index} bigint, _b bigint, _k double, " + ", ".join(f"{v} double" for v in values)

    # rows stream in order, many short series in one batch, and stay in every shuffle partition: the work is CPU-bound
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*by, index]
    rows = data.dropna(subset=cols).select(*cols, F.floor(F.col(index) / size).alias("_b"), *[F.col(v).cast("double").alias(v) for v in values])
    rows = rows.repartition(parts, *by, "_b").sortWithinPartitions(*by, "_b", index)
    loc = cut_lineage(rows.mapInPandas(lambda batches: averages(batches, [*by, "_b"], values, alpha), schema))
    ends = loc.groupBy(*by, "_b").agg(F.min("_k").alias("_d"), *[F.max_by(v, index).alias(v) for v in values])
    first = data.filter(F.col(index) == 0).select(*by, *[F.col(v).cast("double").alias(f"_f_{v}") for v in values])
    summary = ends.join(first, by)

    class Carry(Processor):
        def start(self, key):
            self.key, self.acc = key, None

        def feed(self, cols):
            carry = []
            for i in range(len(cols["_b"])):
                if self.acc is None:
                    self.acc = np.array([cols[f"_f_{v}"][i] for v in values])
                carry.append(self.acc)
                self.acc = np.array([cols[v][i] for v in values]) + cols["_d"][i] * self.acc
            c = np.array(carry)
            return {**{k: [v] * len(c) for k, v in zip(by, self.key)}, "_b": cols["_b"], **{f"_c_{v}": c[:, j] for j, v in enumerate(values)}}

    carry = sequential(summary, by, ["_b"], f"{keys}, _b bigint, " + ", ".join(f"_c_{v} double" for v in values), Carry)
    out = loc.join(carry, [*by, "_b"]).select(*by, index, *[(F.col(v) + F.col("_k") * F.col(f"_c_{v}")).alias(v) for v in values])
    if backwards:
        top = data.groupBy(*by).agg(F.max(index).alias("_top"))
        out = out.join(top, by).withColumn(index, F.col("_top") - F.col(index)).drop("_top")
    return out
