"""Order-dependent loops that Catalyst cannot express, fed row by row.

Rows are hashed by key, sorted, and streamed through Arrow batches; a processor keeps only its own small
state between batches, so a long key is never held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame


class Processor:
    """State for one key at a time. ``feed`` gets column arrays of consecutive rows of the key and yields
    output columns; ``finish`` is called when the key ends."""

    def start(self, key: tuple) -> None:
        raise NotImplementedError

    def feed(self, cols: dict[str, np.ndarray]) -> dict | None:
        raise NotImplementedError

    def finish(self) -> dict | None:
        return None


def sequential(df: DataFrame, by: list[str], order: list[str | Column], schema: str,
               factory: Callable[[], Processor]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_df = df.repartition(parts, *by).sortWithinPartitions(*by, *order)
    names = list(df.columns)
    out_names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proc = factory()
        current: tuple | None = None

        def column(values) -> np.ndarray:
            if not isinstance(values, list):
                return np.asarray(values)
            cells = np.empty(len(values), dtype=object)
            for i, v in enumerate(values):
                cells[i] = v
            return cells

        def frame(parts: list[dict]) -> pd.DataFrame:
            return pd.DataFrame({c: np.concatenate([column(p[c]) for p in parts]) for c in out_names})

        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            cols = {c: pdf[c].to_numpy() for c in names}
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for k in by:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], n)
            parts = []
            for a, b in zip(starts, ends):
                key = tuple(cols[k][a] for k in by)
                if key != current:
                    if current is not None:
                        tail = proc.finish()
                        if tail:
                            parts.append(tail)
                    proc.start(key)
                    current = key
                out = proc.feed({c: v[a:b] for c, v in cols.items()})
                if out:
                    parts.append(out)
            if parts:
                yield frame(parts)
        if current is not None:
            tail = proc.finish()
            if tail:
                yield frame([tail])

    return sorted_df.mapInPandas(run, schema)


class _Greedy(Processor):
    """First come, first served: remembers used ids only."""

    def __init__(self, by: list[str], left: str, right: str):
        self.by, self.left, self.right = by, left, right

    def start(self, key):
        self.key, self.used_left, self.used_right = key, set(), set()

    def feed(self, cols):
        ls, rs = [], []
        for a, b in zip(cols[self.left], cols[self.right]):
            if a not in self.used_left and b not in self.used_right:
                self.used_left.add(a)
                self.used_right.add(b)
                ls.append(a)
                rs.append(b)
        if not ls:
            return None
        return {**{k: [v] * len(ls) for k, v in zip(self.by, self.key)}, self.left: ls, self.right: rs}


def greedy_pairs(candidates: DataFrame, by: list[str], order: list[str], left: str, right: str) -> DataFrame:
    """One-to-one pairs taken greedily from candidate pairs in ``order``; ids are bigint."""
    schema = ", ".join(f"{c} bigint" for c in [*by, left, right])
    cols = list(dict.fromkeys([*by, *order, left, right]))
    return sequential(candidates.select(*cols), by, order, schema, lambda: _Greedy(by, left, right))


class Gather(Processor):
    """Hands a complete small group (a frame's candidates, a line-up) to ``fn(key, columns)``; many such groups
    share one task and one Arrow batch."""

    def __init__(self, fn: Callable[[tuple, dict[str, np.ndarray]], dict | None]):
        self.fn = fn

    def start(self, key):
        self.key, self.parts = key, []

    def feed(self, cols):
        self.parts.append(cols)
        return None

    def finish(self):
        return self.fn(self.key, {c: np.concatenate([p[c] for p in self.parts]) for c in self.parts[0]})
