"""Frame rates as exact fractions, grids and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
NTSC = ((24000, 1001), (30000, 1001), (48000, 1001), (60000, 1001), (120000, 1001))
STANDARD_RATES = (24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 48.0, 50.0, 60000 / 1001, 60.0)
ALLOWED_FPS = (23.976, 24.0, 25.0, 29.97, 30.0, 40.0, 48.0, 50.0, 59.94, 60.0)
EXPORT_GRIDS = (24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 40.0, 48.0, 50.0, 60000 / 1001, 60.0)


def _fraction(num: Column, den: Column) -> Column:
    a, b = num.cast("bigint"), den.cast("bigint")
    # greatest common divisor by repeated remainders (a few dozen steps cover 64 bits)
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")),
                       lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))))
    g = pair["a"]
    return F.struct((a / g).cast("bigint").alias("num"), (b / g).cast("bigint").alias("den"))


def parse_fps(text: Column) -> Column:
    """struct<num,den>: "60", "30000/1001", or a decimal; decimals near an NTSC rate become exact, other
    decimals are taken literally to three places. Null when invalid or outside (0, 1000]."""
    s = F.trim(text)
    num, den = F.try_to_number(F.regexp_extract(s, r"^(\d+)/(\d+)$", 1), F.lit("99999999")), F.try_to_number(
        F.regexp_extract(s, r"^(\d+)/(\d+)$", 2), F.lit("99999999"))
    value = s.try_cast("double")
    out = F.when(s.rlike(r"^\d+/0*[1-9]\d*$"), _fraction(num, den))
    for n, d in NTSC:
        out = out.when(s.rlike(r"\.\d*[1-9]") & (F.abs(value - n / d) < 0.01), F.struct(F.lit(n).cast("bigint").alias("num"), F.lit(d).cast("bigint").alias("den")))
    out = out.when(value.isNotNull(), _fraction(F.round(value * 1000), F.lit(1000)))
    ratio = out["num"] / F.nullif(out["den"], F.lit(0))
    return F.when((ratio > 0) & (ratio <= 1000), out)


def snap_fps(fps: Column, tolerance: float = 0.005) -> Column:
    """Nearest standard rate when within the relative tolerance."""
    best, best_d = F.lit(STANDARD_RATES[0]), F.abs(fps - STANDARD_RATES[0])
    for r in STANDARD_RATES[1:]:
        d = F.abs(fps - r)
        best, best_d = F.when(d < best_d, r).otherwise(best), F.least(best_d, d)
    return F.when((fps > 0) & (best_d <= best * tolerance), F.round(best, 3)).otherwise(fps)


def is_allowed_fps(fps: Column) -> Column:
    ok = F.lit(False)
    for r in ALLOWED_FPS:
        ok = ok | (F.abs(fps - r) <= 0.01)
    return ok


def target_frame_count(in_ms: Column, out_ms: Column, num: Column, den: Column) -> Column:
    """round(duration x rate), at least one; whole milliseconds keep it exact."""
    return F.greatest(F.lit(1), F.floor(((out_ms - in_ms) * num * 2 + den * 1000) / (den * 2000))).cast("bigint")


def frame_range_start(ms: Column, fps: Column) -> Column:
    """First frame whose time is at or after ``ms`` (a tenth of a frame of tolerance)."""
    return F.greatest(F.lit(0), F.ceil(ms / 1000.0 * fps - 0.1)).cast("bigint")


def expected_samples(start_frame: Column, end_frame: Column, fps: Column, sample_fps: Column) -> Column:
    rate = F.when(fps > 0, fps).otherwise(25.0)
    return F.greatest(F.lit(1), F.ceil((end_frame + 1 - start_frame) / rate * sample_fps - 1e-6)).cast("bigint")


def cut_points(first_new_ms: Column, margin: float = 0.25, grids: tuple[float, ...] = EXPORT_GRIDS) -> Column:
    """struct<out_ms, in_ms>: where the outgoing clip may end and the incoming one may start so that no
    export grid shows a frame of the other side. A seek may shift a frame by up to one millisecond."""
    tick = lambda grid, shift, bias: F.floor((first_new_ms + shift) * grid / 1000.0 + 0.5 + bias)
    outs = [first_new_ms - margin] + [tick(g, 0.0, -1e-4) * 1000.0 / g - margin for g in grids]
    ins = [first_new_ms + margin] + [tick(g, 1.0, 1e-4) * 1000.0 / g + margin for g in grids]
    return F.struct(F.round(F.least(*outs), 3).alias("out_ms"), F.round(F.greatest(*ins), 3).alias("in_ms"))
