"""Ordered scans that split one key over many tasks.

A plain window partitioned by an asset puts that whole asset in one task, and one asset may hold a
third of the table. Row numbers, running sums and maxima, last / next values and neighbours are all
associative, so they are computed in two levels here: inside chunks of the order (a time bucket or a
block of frame numbers), then over one summary row per chunk, and the carry is joined back. The detail
rows move once, hashed by (key, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.session import cut_lineage

SUMMED = ("number", "running_sum", "prefix_sum", "total")


@dataclass(frozen=True)
class Scan:
    kind: str
    value: Column | None = None


def number() -> Scan:
    """1-based position."""
    return Scan("number", F.lit(1))


def running_sum(value: Column) -> Scan:
    return Scan("running_sum", value)


def prefix_sum(value: Column) -> Scan:
    """Sum of the rows before this one."""
    return Scan("prefix_sum", value)


def total(value: Column) -> Scan:
    """Sum over the whole key."""
    return Scan("total", value)


def running_max(value: Column) -> Scan:
    return Scan("running_max", value)


def last(value: Column) -> Scan:
    """Latest non-null value up to and including this row."""
    return Scan("last", value)


def following(value: Column) -> Scan:
    """Earliest non-null value from this row on."""
    return Scan("following", value)


def lag(value: Column) -> Scan:
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    return Scan("lead", value)


def ordered_scan(df: DataFrame, by: list[str], order: list[Column], chunk: Column, **scans: Scan) -> DataFrame:
    """Add one column per scan. ``chunk`` must not decrease along ``order`` inside a key."""
    here = Window.partitionBy(*by, "_chunk").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = here.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = df.withColumn("_chunk", chunk)
    for name, scan in scans.items():
        base = base.withColumn(f"_v_{name}", scan.value)

    local, tail, head = {}, {}, {}
    for name, scan in scans.items():
        v = F.col(f"_v_{name}")
        if scan.kind in SUMMED:
            local[name] = F.sum(v).over(upto)
            tail[name] = F.col(f"_l_{name}")
        elif scan.kind == "running_max":
            local[name] = F.max(v).over(upto)
            tail[name] = F.col(f"_l_{name}")
        elif scan.kind == "last":
            local[name] = F.last(v, ignorenulls=True).over(upto)
            tail[name] = F.col(f"_l_{name}")
        elif scan.kind == "following":
            local[name] = F.first(v, ignorenulls=True).over(onward)
            head[name] = F.col(f"_l_{name}")
        elif scan.kind == "lag":
            local[name] = F.lag(F.struct(v.alias("v"))).over(here)
            tail[name] = F.struct(v.alias("v"))
        elif scan.kind == "lead":
            local[name] = F.lead(F.struct(v.alias("v"))).over(here)
            head[name] = F.struct(v.alias("v"))
        else:
            raise ValueError(scan.kind)
    detail = base.select(
        "*",
        *[c.alias(f"_l_{n}") for n, c in local.items()],
        F.lag(F.lit(1)).over(here).isNull().alias("_head"),
        F.lead(F.lit(1)).over(here).isNull().alias("_tail"),
    )
    if all(scan.kind in SUMMED or scan.kind == "running_max" for scan in scans.values()):
        # sums and maxima combine before the shuffle: no second sort of the detail rows
        summary = base.groupBy(*by, "_chunk").agg(
            *[(F.sum if scan.kind in SUMMED else F.max)(f"_v_{n}").alias(f"_s_{n}") for n, scan in scans.items()])
    elif head:
        summary = (
            detail.filter("_head or _tail")
            .groupBy(*by, "_chunk")
            .agg(
                *[F.first(F.when(F.col("_tail"), c), ignorenulls=True).alias(f"_s_{n}") for n, c in tail.items()],
                *[F.first(F.when(F.col("_head"), c), ignorenulls=True).alias(f"_s_{n}") for n, c in head.items()],
            )
        )
    else:
        summary = detail.filter("_tail").select(*by, "_chunk", *[c.alias(f"_s_{n}") for n, c in tail.items()])

    across = Window.partitionBy(*by).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = across.rowsBetween(1, Window.unboundedFollowing)
    carries = []
    for name, scan in scans.items():
        s = F.col(f"_s_{name}")
        if scan.kind in ("number", "running_sum", "prefix_sum"):
            c = F.sum(s).over(earlier)
        elif scan.kind == "total":
            c = F.sum(s).over(Window.partitionBy(*by))
        elif scan.kind == "running_max":
            c = F.max(s).over(earlier)
        elif scan.kind == "last":
            c = F.last(s, ignorenulls=True).over(earlier)
        elif scan.kind == "following":
            c = F.first(s, ignorenulls=True).over(later)
        elif scan.kind == "lag":
            c = F.lag(s).over(across)
        else:
            c = F.lead(s).over(across)
        carries.append(c.alias(f"_c_{name}"))
    carry = summary.select(*by, "_chunk", *carries)

    out = detail.join(carry, [*by, "_chunk"], "left")
    results = []
    for name, scan in scans.items():
        lc, cc, v = F.col(f"_l_{name}"), F.col(f"_c_{name}"), F.col(f"_v_{name}")
        zero = F.lit(0)
        if scan.kind in ("number", "running_sum"):
            r = F.coalesce(lc, zero) + F.coalesce(cc, zero)
        elif scan.kind == "prefix_sum":
            r = F.coalesce(lc, zero) + F.coalesce(cc, zero) - F.coalesce(v, zero)
        elif scan.kind == "total":
            r = F.coalesce(cc, zero)
        elif scan.kind == "running_max":
            r = F.greatest(lc, cc)
        elif scan.kind in ("last", "following"):
            r = F.coalesce(lc, cc)
        else:
            r = F.coalesce(lc, cc)["v"]
        results.append(r.alias(name))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in scans]
    return out.select(*keep, *results)


#: Rows of a key that one window may number in one task; longer keys are spread over their chunks.
WINDOW_ROWS = 65_536


def numbered(df: DataFrame, by: list[str], order: list[Column], chunk: Column, name: str, rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with the 1-based position in its key as ``name`` (bigint). Keys of at most ``rows`` rows move once and are numbered by
    a plain window; only longer ones take the :func:`ordered_scan`, whose summaries cost as much as short keys do themselves."""
    plain = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint")
    long = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(*[F.col(k).alias(f"_k_{k}") for k in by]))
    if long.isEmpty():
        return df.withColumn(name, plain)
    long = F.broadcast(long)  # at most one key in ``rows`` rows
    met = lambda how: df.join(long, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], how)
    return met("left_anti").withColumn(name, plain).unionByName(ordered_scan(met("left_semi"), by, order, chunk, **{name: number()}))


def halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Copy the rows next to a block border into the neighbouring block, for windows of fixed width
    over a dense 0-based ``index``. Adds ``_block`` and ``_own``: compute the window partitioned by
    (key, ``_block``), then keep ``_own`` rows. A block never has more than size + before + after rows."""
    i = F.col(index)
    first = F.greatest(F.lit(0), F.floor((i - after) / size)).cast("bigint")
    final = F.floor((i + before) / size).cast("bigint")
    return df.withColumn("_block", F.explode(F.sequence(first, final))).withColumn(
        "_own", F.col("_block") == F.floor(i / size).cast("bigint")
    )
