"""Clip time maps, fades, transitions and effect parameters as column expressions.

``factor`` is timeline ms per source ms (1 / speed for a constant speed). Freeze frames hold the picture at
``freeze_at`` (clip-local) for ``freeze_hold`` ms; both are null without a freeze.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediaframe.functions.easing import BEZIER, cubic_bezier, ease_in_out_cubic, ease_out_back, ease_out_cubic, unit_clamp
from mediaframe.functions.noise import value_noise

MIN_CLIP_MS = 40
TRANSITION_MIN_MS, TRANSITION_MAX_MS, TRANSITION_DEFAULT_MS = 100, 3000, 500


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def clip_duration(in_ms: Column, out_ms: Column, factor: Column | None = None, hold: Column | None = None) -> Column:
    src = F.greatest(F.lit(0), out_ms - in_ms)
    d = src if factor is None else src * factor
    return d if hold is None else d + zero(hold)


def local_to_play(local: Column, at: Column, hold: Column) -> Column:
    """Clip-local time without the freeze hold."""
    return F.when(at.isNull() | (local <= at), local).when(local < at + hold, at).otherwise(local - hold)


def is_frozen(local: Column, at: Column, hold: Column) -> Column:
    return F.coalesce((local >= at) & (local < at + hold), F.lit(False))


def source_at(local: Column, in_ms: Column, out_ms: Column, factor: Column, at: Column, hold: Column, reversed_: Column) -> Column:
    """struct<local_ms, source_ms, rate, frozen> of a clip with one constant speed."""
    total = clip_duration(in_ms, out_ms, factor, hold)
    t = F.least(F.greatest(local, F.lit(0.0)), total)
    src = out_ms - in_ms
    off = local_to_play(t, at, hold) / factor
    off = F.when(reversed_, src - off).otherwise(off)
    frozen = is_frozen(t, at, hold)
    return F.struct(t.cast("double").alias("local_ms"), (in_ms + F.least(F.greatest(off, F.lit(0.0)), src)).cast("double").alias("source_ms"),
                    F.when(frozen, 0.0).otherwise(F.lit(1.0) / factor).alias("rate"), frozen.alias("frozen"))


def source_extended(local: Column, in_ms: Column, out_ms: Column, factor: Column, at: Column, hold: Column, reversed_: Column, source_len: Column) -> Column:
    """:func:`source_at` continued past the ends at the boundary speed (transition handles), inside the file."""
    total = clip_duration(in_ms, out_ms, factor, hold)
    inside = source_at(local, in_ms, out_ms, factor, at, hold, reversed_)
    edge = F.when(local < 0, F.lit(0.0)).otherwise(total)
    held = is_frozen(F.when(local < 0, F.lit(0.0)).otherwise(F.greatest(total - 1e-6, F.lit(0.0))), at, hold)
    rate = F.when(held, 0.0).otherwise(F.lit(1.0) / factor)
    base = source_at(edge, in_ms, out_ms, factor, at, hold, reversed_)["source_ms"]
    limit = F.when(source_len > 0, source_len).otherwise(out_ms)
    src = base + F.when(reversed_, -1.0).otherwise(1.0) * (local - edge) * rate
    past = F.struct(edge.cast("double").alias("local_ms"), F.least(F.greatest(src, F.lit(0.0)), limit).cast("double").alias("source_ms"), rate.alias("rate"), (rate == 0).alias("frozen"))
    return F.when((local >= 0) & (local <= total), inside).otherwise(past)


# --------------------------------------------------------------------------- audio and video fades


def db_to_lin(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def lin_to_db(lin: Column) -> Column:
    return F.when(lin <= 1e-6, -120.0).otherwise(F.log10(lin) * 20.0)


def equal_power(u: Column) -> Column:
    return F.sin(unit_clamp(u) * (math.pi / 2))


def audio_fade_gain(local: Column, dur: Column, fade_in: Column, fade_out: Column) -> Column:
    """Sine fades, each at most half the clip long."""
    half = F.greatest(F.lit(0.0), dur / 2)
    fi, fo = F.least(half, F.greatest(F.lit(0.0), zero(fade_in))), F.least(half, F.greatest(F.lit(0.0), zero(fade_out)))
    t = F.least(dur, F.greatest(F.lit(0.0), local))
    return F.when(fi > 0, equal_power(t / fi)).otherwise(1.0) * F.when(fo > 0, equal_power((dur - t) / fo)).otherwise(1.0)


def clip_gain(muted: Column, gain_db: Column, volume_db: Column, local: Column, dur: Column, fade_in: Column, fade_out: Column) -> Column:
    return F.when(muted, 0.0).otherwise(db_to_lin(zero(gain_db) + zero(volume_db)) * audio_fade_gain(local, dur, fade_in, fade_out))


def video_fade(local: Column, dur: Column, fade_in: Column, fade_out: Column) -> Column:
    """Linear fade from and to black, 1 = none."""
    half = F.greatest(F.lit(0.0), dur / 2)
    fi, fo = F.least(half, F.greatest(F.lit(0.0), zero(fade_in))), F.least(half, F.greatest(F.lit(0.0), zero(fade_out)))
    t = F.least(dur, F.greatest(F.lit(0.0), local))
    ramp = lambda a, f: F.when(f > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a / f))).otherwise(1.0)
    return ramp(t, fi) * ramp(dur - t, fo)


# --------------------------------------------------------------------------- transitions


def clamp_transition(duration: Column, outgoing: Column, incoming: Column) -> Column:
    base = F.least(F.lit(TRANSITION_MAX_MS), F.greatest(F.lit(TRANSITION_MIN_MS), F.coalesce(duration, F.lit(TRANSITION_DEFAULT_MS))))
    return F.greatest(F.lit(0), F.least(base, outgoing, incoming))


def transition_progress(raw: Column) -> Column:
    return cubic_bezier(*BEZIER["easeInOut"], unit_clamp(raw))


# --------------------------------------------------------------------------- effects

ENVELOPE_MS = 120.0
ENVELOPED = ("blackAndWhite", "sepia", "letterbox", "shake", "rgbSplit", "vhs", "vignettePulse")


def envelope(t: Column, dur: Column) -> Column:
    """Linear ramps in and out of 120 ms."""
    return F.when(dur <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t / ENVELOPE_MS, (dur - t) / ENVELOPE_MS)))


def effect_strength(kind: Column, intensity: Column, t: Column, dur: Column) -> Column:
    k = unit_clamp(F.coalesce(intensity, F.lit(1.0)))
    return F.when(kind.isin(*ENVELOPED), k * envelope(t, dur)).otherwise(k)


def effect_amount(kind: Column, s: Column, t: Column, dur: Column, amplitude: Column | float = 0.01) -> Column:
    """The main parameter of an effect at effect-local ``t`` ms: fade amount, flash alpha, blur radius in
    pixels, zoom scale or vignette strength."""
    u = F.when(dur > 0, unit_clamp(t / dur)).otherwise(1.0)
    punch = F.when(u < 0.35, ease_out_back(u / 0.35)).otherwise(F.lit(1.0) - ease_in_out_cubic((u - 0.35) / 0.65))
    return (F.when(kind.isin("fadeFromBlack", "fadeFromWhite"), s * (F.lit(1.0) - u)).when(kind.isin("fadeToBlack", "fadeToWhite"), s * u)
            .when(kind == "flashWhite", s * (F.lit(1.0) - F.abs(u * 2 - 1))).when(kind == "blurIn", s * (F.lit(1.0) - u) * 20).when(kind == "blurOut", s * u * 20)
            .when(kind == "zoomPunch", s * punch * 0.15 + 1).when(kind == "shake", s * amplitude * 2 + 1)
            .when(kind == "vignettePulse", s * (F.lit(0.4) - F.cos(t / 1000 * (2 * math.pi)) * 0.2))
            .when(kind == "cameraSnap", s * F.greatest(F.lit(0.0), F.lit(1.0) - t / 250)).otherwise(0.0))


def effect_shift(kind: Column, s: Column, t: Column, amplitude: Column, frequency: Column, amount: Column) -> Column:
    """struct<dx, dy, rot>: shake offsets and degrees, or the channel offset of the colour split."""
    x = t / 1000 * frequency
    shake = kind == "shake"
    dx = F.when(shake, amplitude * s * value_noise(x, 1)).when(kind == "rgbSplit", amount * s * (value_noise(t / 1000 * 8, 4) * 0.5 + 1)).otherwise(0.0)
    return F.struct(dx.alias("dx"), F.when(shake, amplitude * s * value_noise(x, 2)).otherwise(0.0).alias("dy"),
                    F.when(shake, amplitude * s * value_noise(x, 3) * 100).otherwise(0.0).alias("rot"))


def snap_progress(s: Column, t: Column) -> Column:
    """How far the camera-snap photo has settled."""
    return s * ease_out_cubic(unit_clamp(t / 350))
