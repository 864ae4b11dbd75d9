"""Deterministic noise: a 32-bit permuted congruential hash on bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def _mul32(a: Column, factor: int) -> Column:
    """a x factor modulo 2^32, in halves so that 64 bits never overflow."""
    low, high = a.bitwiseAND(0xFFFF), F.shiftright(a, 16)
    return (low * factor + F.shiftleft((high * factor).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _once(value: Column, use) -> Column:
    """Evaluate ``value`` once and pass it on."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pcg(v: Column) -> Column:
    """u32 -> u32 as bigint."""
    state = (_mul32(v.cast("bigint").bitwiseAND(MASK), 747796405) + 2891336453).bitwiseAND(MASK)

    def word(s: Column) -> Column:
        shift = (F.shiftright(s, 28) + 4).bitwiseAND(31)
        return _mul32(F.floor(s / F.pow(F.lit(2.0), shift)).cast("bigint").bitwiseXOR(s), 277803737)

    return _once(_once(state, word), lambda w: F.shiftright(w, 22).bitwiseXOR(w))


def _pcg_int(v: int) -> int:
    s = (v * 747796405 + 2891336453) & MASK
    w = (((s >> (((s >> 28) + 4) & 31)) ^ s) * 277803737) & MASK
    return (w >> 22) ^ w


def rnd(i: Column, seed: int) -> Column:
    """Uniform 0..1 from a lattice point and a seed."""
    return pcg(i.cast("bigint").bitwiseAND(MASK).bitwiseXOR(F.lit(_pcg_int(seed)))) / 4294967295.0


def value_noise(x: Column, seed: int) -> Column:
    """-1..1, smooth between hashed lattice values."""
    cx = F.greatest(x, F.lit(0.0))
    f = cx - F.floor(cx)
    u = f * f * (F.lit(3.0) - f * 2)
    a, b = rnd(F.floor(cx), seed), rnd(F.floor(cx) + 1, seed)
    return (a * (F.lit(1.0) - u) + b * u) * 2 - 1
