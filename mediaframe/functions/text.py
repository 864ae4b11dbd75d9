"""Paths, time texts, fingerprints and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _pad(n: Column) -> Column:
    s = F.floor(n).cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def timecode(ms: Column, fps: Column) -> Column:
    """HH:MM:SS:FF."""
    total = F.floor(F.greatest(F.lit(0), ms) / 1000 * fps + 1e-6)
    s = F.floor(total / fps)
    return F.concat_ws(":", _pad(s / 3600), _pad((s / 60) % 60), _pad(s % 60), _pad(total % F.round(fps)))


def short_time(ms: Column) -> Column:
    s = F.greatest(F.lit(0), ms) / 1000
    m = F.floor(s / 60)
    return F.concat(_pad(m), F.lit(":"), _pad(s - m * 60))


def fmt_duration(ms: Column) -> Column:
    s = ms / 1000
    return F.when(s < 60, F.format_string("%.1fs", s.cast("double"))).otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.round(s % 60).cast("bigint").cast("string"), F.lit("s")))


def fingerprint(*parts: Column) -> Column:
    """Stable key of one input: sha1 over the texts of its parts."""
    return F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts]))


def pair_key(a: Column, b: Column, version: int = 1) -> Column:
    return F.sha1(F.concat_ws("|", a, b, F.lit(str(version))))


def new_id(prefix: str, *keys: Column) -> Column:
    """Deterministic id: prefix and the keys' whole hash (random ids would change on a re-run, cut ones collide)."""
    return F.concat(F.lit(prefix + "_"), fingerprint(*keys))
