"""Loudness, waveforms, onsets, tempo and beats.

Samples are (asset_id, i, value) with a dense 0-based i. Spectral work runs on bounded blocks of samples with a
halo; everything per asset is a partial aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.operators.shots import BLOCK
from mediaframe.plans import scan
from mediaframe.plans.blocks import blockwise
from mediaframe.plans.joins import bucket_of
from mediaframe.plans.quantile import exact_quantile
from mediaframe.plans.sequential import Processor, sequential
from mediaframe.session import cut_lineage

SILENT_LUFS = -70.0
BEAT_MIN_PERIODICITY = 0.25


def recommended_gain(lufs: Column, true_peak: Column, target: float = -14.0, clamp: float = 12.0, ceiling: float = -1.0) -> Column:
    """Gain to the target that keeps the true peak under the ceiling; null for silence."""
    g = F.lit(target) - lufs
    g = F.when(true_peak.isNotNull() & (true_peak > -90), F.least(g, F.lit(ceiling) - true_peak)).otherwise(g)
    return F.when(lufs > SILENT_LUFS, F.least(F.greatest(g, F.lit(-clamp)), F.lit(clamp)))


def parse_loudness_log(text: Column) -> Column:
    """struct<lufs, true_peak, range> from a loudness meter's log: the summary block when it has one, else the
    last JSON block of the normaliser. Null when there is no measurable sound."""
    body = F.regexp_extract(text, r"(?s)Summary:(.*)", 1)
    num = r"(-?inf|-?[\d.]+)"

    def last(pattern: str) -> Column:
        v = F.lower(F.try_element_at(F.regexp_extract_all(body, F.lit(pattern), 1), F.lit(-1)))
        return F.when(v.contains("inf"), F.lit(float("-inf"))).otherwise(v.try_cast("double"))

    found = F.regexp_extract_all(body, F.lit(r"I:\s+" + num + r"\s+LUFS"), 1)
    finite = lambda c, d: F.when(c.isNull() | (c == float("-inf")), F.lit(d)).otherwise(c)
    i = last(r"I:\s+" + num + r"\s+LUFS")
    meter = F.when(i > SILENT_LUFS, F.struct(i.alias("lufs"), finite(last(r"Peak:\s+" + num + r"\s+dBFS"), -99.0).alias("true_peak"), finite(last(r"LRA:\s+" + num + r"\s+LU(?!FS)"), 0.0).alias("range")))
    block = F.try_element_at(F.regexp_extract_all(text, F.lit(r'(?s)(\{[^{}]*"input_i"[^{}]*\})'), 1), F.lit(-1))
    j = F.from_json(block, "input_i string, input_tp string, input_lra string")
    # "-inf" does not cast everywhere: it means silence here
    val = lambda c: F.when(F.lower(c).contains("inf"), F.lit(float("-inf"))).otherwise(c.try_cast("double"))
    ji = val(j["input_i"])
    norm = F.when(ji > SILENT_LUFS, F.struct(ji.alias("lufs"), F.coalesce(val(j["input_tp"]), F.lit(-99.0)).alias("true_peak"), F.coalesce(val(j["input_lra"]), F.lit(0.0)).alias("range")))
    return F.when(F.size(found) > 0, meter).otherwise(norm)


def waveform(pcm: DataFrame, bucket: int) -> DataFrame:
    """Peak per bucket of samples, scaled so that the loudest bucket of an asset is 1."""
    peaks = pcm.groupBy("asset_id", F.floor(F.col("i") / bucket).alias("bucket")).agg(F.max(F.abs("value")).alias("peak"))
    top = peaks.groupBy("asset_id").agg(F.max("peak").alias("_top"))
    return peaks.join(top, "asset_id").select("asset_id", "bucket", F.when(F.col("_top") > 0, F.least(F.lit(1.0), F.col("peak") / F.col("_top"))).otherwise(F.col("peak")).alias("peak"))


# --------------------------------------------------------------------------- onset envelope


def band_edges(n_bins: int, bands: int = 64) -> list[int]:
    """Log-spaced bin borders without repeats."""
    return sorted({int(round(v)) for v in np.geomspace(1, n_bins - 1, bands + 1)})


def spectrum_bands(pcm: DataFrame, n_fft: int = 1024, hop: int = 256, frames_per_block: int = 2048) -> DataFrame:
    """(asset_id, frame, bands array<double>): windowed magnitude spectrum pooled into log-spaced bands.

    Frame k is centred on sample k x hop; the series is mirrored at both ends. Samples are blocked with half a
    window on either side, so blocks are independent."""
    half = n_fft // 2
    edges = band_edges(half + 1)
    window = np.hanning(n_fft)
    sizes = pcm.groupBy("asset_id").agg((F.max("i") + 1).alias("n"))

    def run(pdf: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        n, first = int(pdf["n"].iloc[0]), int(pdf["i"].iloc[0])
        if lo >= n:
            return pd.DataFrame({"asset_id": [], "frame": [], "bands": []})
        x = pdf["value"].to_numpy(dtype=np.float64)
        length = max(n, n_fft)
        last_frame = (length + 2 * half - n_fft) // hop
        ks = np.arange(-(-lo // hop), min(last_frame, (hi - 1) // hop if hi < n else last_frame) + 1)
        out = []
        for s in range(0, len(ks), 256):
            at = np.abs(ks[s : s + 256, None] * hop - half + np.arange(n_fft))
            at = np.where(at >= length, 2 * (length - 1) - at, at)
            ok = (at >= first) & (at - first < len(x))
            seg = np.where(ok, x[np.clip(at - first, 0, len(x) - 1)], 0.0)
            mag = np.abs(np.fft.rfft(seg * window, axis=1))
            out += np.stack([mag[:, a:b].mean(axis=1) for a, b in zip(edges[:-1], edges[1:])], axis=1).tolist()
        return pd.DataFrame({"asset_id": pdf["asset_id"].iloc[0], "frame": ks, "bands": out})

    # the last block may need samples mirrored back over half a window
    return blockwise(pcm.join(sizes, "asset_id"), ["asset_id"], "i", frames_per_block * hop, n_fft + hop, n_fft, run, "asset_id bigint, frame bigint, bands array<double>")


def onset_from_bands(bands: DataFrame, fps: float) -> DataFrame:
    """Positive change of log band energy, averaged over bands, less its local mean over a fifth of a second,
    scaled to a maximum of 1. bands: asset_id, frame, bands."""
    top = bands.groupBy("asset_id").agg(F.max(F.array_max("bands")).alias("_top"))
    log = bands.join(top, "asset_id").withColumn("log", F.expr("transform(bands, b -> ln(1 + 1000.0 * b / (_top + 1e-9)))"))
    d = scan.ordered_scan(log.select("asset_id", "frame", "log"), ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), BLOCK), prev=scan.lag(F.col("log")))
    flux = F.aggregate(F.zip_with("log", F.coalesce("prev", "log"), lambda a, b: F.greatest(a - b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v) / F.size("log")
    env = d.select("asset_id", "frame", flux.alias("flux"))
    win = max(3, int(0.2 * fps)) | 1
    half = win // 2
    ends = env.groupBy("asset_id").agg(F.max("frame").alias("_n"), F.min_by("flux", "frame").alias("_a"), F.max_by("flux", "frame").alias("_z"))
    w = Window.partitionBy("asset_id", "_block").orderBy("frame").rowsBetween(-half, half)
    near = scan.halo(env, "frame", BLOCK, half, half).withColumn("_s", F.sum("flux").over(w)).filter("_own").join(ends, "asset_id")
    missing_a, missing_z = F.greatest(F.lit(0), half - F.col("frame")), F.greatest(F.lit(0), F.col("frame") + half - F.col("_n"))
    local = (F.col("_s") + missing_a * F.col("_a") + missing_z * F.col("_z")) / win
    lifted = near.select("asset_id", "frame", F.greatest(F.col("flux") - local, F.lit(0.0)).alias("env"))
    peak = lifted.groupBy("asset_id").agg(F.max("env").alias("_peak"))
    return lifted.join(peak, "asset_id").select("asset_id", "frame", F.when(F.col("_peak") > 0, F.col("env") / F.col("_peak")).otherwise(F.col("env")).alias("env"))


def onset_envelope(pcm: DataFrame, rate: int, n_fft: int = 1024, hop: int = 256) -> DataFrame:
    return onset_from_bands(spectrum_bands(pcm, n_fft, hop), rate / hop)


# --------------------------------------------------------------------------- tempo and beats


def autocorrelation(series: DataFrame, value: str, max_lag: int, up: int = 1, size: int = 32_768) -> DataFrame:
    """(asset_id, lag, ac) of a series, linearly upsampled ``up`` times, for lags 0..max_lag in upsampled
    steps. Blocks send partial sums of products only."""
    reach = max_lag // up + 2
    sizes = series.groupBy("asset_id").agg((F.max("frame") + 1).alias("n"))

    def run(pdf: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        x = pdf[value].to_numpy(dtype=np.float64)
        if up > 1:
            r = np.arange(up) / up
            nxt = np.append(x[1:], 0.0)
            u = (x[:, None] * (1 - r) + nxt[:, None] * r).ravel()
            # the series ends at its last original sample
            u = u[:max(0, (min(n - 1, lo + len(x)) - lo) * up)]
        else:
            u = x
        own = min((hi - lo) * up, len(u))
        ac = [float(u[:own][:max(0, len(u) - lag)] @ u[lag:lag + own][:own]) if lag < len(u) else 0.0 for lag in range(max_lag + 1)]
        return pd.DataFrame({"asset_id": pdf["asset_id"].iloc[0], "lag": range(max_lag + 1), "ac": ac})

    parts = blockwise(series.join(sizes, "asset_id").select("asset_id", "frame", "n", value), ["asset_id"], "frame", size, 0, reach, run, "asset_id bigint, lag bigint, ac double")
    return parts.groupBy("asset_id", "lag").agg(F.sum("ac").alias("ac"))


def tempo(env: DataFrame, fps: float, low: float = 60.0, high: float = 200.0, prior: float = 120.0) -> DataFrame:
    """(asset_id, bpm, periodicity): the best lag of the smoothed, four times upsampled autocorrelation under a
    log-normal prior, refined by a parabola. Assets shorter than two seconds, or silent, have no tempo and periodicity 0."""
    up = 4
    rate = fps * up
    lag_min, lag_max = int(math.floor(rate * 60 / high)), int(math.ceil(rate * 60 / low))
    every = env.groupBy("asset_id").agg(F.avg("env").alias("_mean"), F.max("env").alias("_max"), F.count("*").alias("n"))
    stats = every.filter((F.col("n") >= int(fps * 2)) & (F.col("_max") > 0))
    centred = env.join(stats, "asset_id").withColumn("x", F.col("env") - F.col("_mean"))
    w = Window.partitionBy("asset_id", "_block").orderBy("frame")
    smooth = scan.halo(centred, "frame", BLOCK, 1, 1).withColumn(
        "x", F.coalesce(F.lag("x").over(w), F.lit(0.0)) * 0.25 + F.col("x") * 0.5 + F.coalesce(F.lead("x").over(w), F.lit(0.0)) * 0.25).filter("_own")
    # a few hundred lags per asset, read twice below
    ac = cut_lineage(autocorrelation(smooth.select("asset_id", "frame", "x"), "x", lag_max, up))
    zero = ac.filter(F.col("lag") == 0).select("asset_id", F.col("ac").alias("_zero"))
    top = stats.select("asset_id", F.least(F.lit(lag_max), (F.col("n") - 1) * up - 1).alias("_top"))
    a = ac.filter(F.col("lag") >= lag_min).join(zero, "asset_id").join(top, "asset_id").filter((F.col("lag") <= F.col("_top")) & (F.col("_top") > lag_min + 1))
    octave = F.log2(F.lit(60.0 * rate) / F.col("lag")) - math.log2(prior)
    a = a.withColumn("r", F.col("ac") / (F.col("_zero") + 1e-9)).withColumn("score", F.col("r") * F.exp(octave * octave * -0.5))
    # at most lag_max rows per asset from here on
    by = Window.partitionBy("asset_id").orderBy("lag")
    s = a.withColumn("y0", F.lag("score").over(by)).withColumn("y2", F.lead("score").over(by))
    best = s.groupBy("asset_id").agg(F.max(F.struct("score", (-F.col("lag")).alias("neg"), "r", "y0", "y2")).alias("m"))
    lag, y0, y1, y2 = -F.col("m.neg"), F.col("m.y0"), F.col("m.score"), F.col("m.y2")
    curve = y0 - y1 * 2 + y2
    fine = lag + F.when(y0.isNotNull() & y2.isNotNull() & (F.abs(curve) > 1e-12), (y0 - y2) * 0.5 / curve).otherwise(0.0)
    found = best.select("asset_id", (F.lit(60.0 * rate) / fine).alias("bpm"), F.greatest(F.lit(0.0), F.col("m.r")).alias("periodicity"))
    return every.join(found, "asset_id", "left").select("asset_id", "bpm", F.coalesce("periodicity", F.lit(0.0)).alias("periodicity"))


def tempos_agree(a: Column, b: Column, tol: float = 0.06) -> Column:
    """The same pulse up to an octave."""
    r = a / b
    near = (F.abs(r - 1) <= tol) | (F.abs(r / 2 - 1) <= tol) | (F.abs(r * 2 - 1) <= tol)
    return F.coalesce((a > 0) & (b > 0) & near, F.lit(False))


def beat_confidence(periodicity: Column, agree: Column) -> Column:
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), periodicity) / 0.5)
    return F.round(F.when(agree.isNull(), base * 0.8).when(agree, base).otherwise(0.0), 3)


def has_pulse(bpm: Column, periodicity: Column, gate: float = BEAT_MIN_PERIODICITY) -> Column:
    """Whether audio has a pulse at all: a tempo whose periodicity reaches the gate; speech and ambience stay below."""
    return F.coalesce(bpm.isNotNull() & (periodicity >= gate), F.lit(False))


def track_beats(env: DataFrame, tempos: DataFrame, fps: float, min_strength: float = 0.02) -> DataFrame:
    """Beats on the tempo grid (asset_id, position in frames, strength): the phase with the most onset energy,
    every grid point moved to the strongest onset within an eighth of a period, refined by a parabola, at least
    half a period apart. env: asset_id, frame, env; tempos: asset_id, bpm, and with periodicity only assets with a pulse."""
    pulse = has_pulse(F.col("bpm"), F.col("periodicity")) if "periodicity" in tempos.columns else F.col("bpm").isNotNull()
    tempos = tempos.filter(pulse)
    n = env.groupBy("asset_id").agg((F.max("frame") + 1).alias("n"))
    t = tempos.join(n, "asset_id").withColumn("period", F.lit(fps * 60.0) / F.col("bpm")).filter(F.col("period") > 1)
    near = scan.ordered_scan(env, ["asset_id"], [F.col("frame")], bucket_of(F.col("frame"), BLOCK), before=scan.lag(F.col("env")), after=scan.lead(F.col("env")))
    phases = F.greatest(F.lit(8), F.bround("period").cast("int"))
    grid = t.withColumn("phases", phases).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("period")).cast("bigint") - 1)))
    pos = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("phases") - 1))).withColumn("pos", F.col("g") * F.col("period") + F.col("period") * F.col("k") / F.col("phases")).filter(F.col("pos") < F.col("n"))
    hit = pos.withColumn("frame", F.floor("pos")).join(near, ["asset_id", "frame"])
    energy = F.col("env") + (F.coalesce("after", "env") - F.col("env")) * (F.col("pos") - F.col("frame"))
    score = hit.groupBy("asset_id", "k").agg(F.sum(energy).alias("s"))
    phase = score.groupBy("asset_id").agg(F.max(F.struct("s", (-F.col("k")).alias("k"))).alias("m")).select("asset_id", (-F.col("m.k")).alias("k"))
    radius = F.greatest(F.lit(1), F.floor(F.col("period") / 8).cast("int"))
    beats = grid.join(phase, "asset_id").withColumn("beat", F.col("g") * F.col("period") + F.col("period") * F.col("k") / F.col("phases")).filter(F.col("beat") < F.col("n"))
    around = beats.withColumn("frame", F.explode(F.sequence(F.bround("beat").cast("bigint") - radius, F.bround("beat").cast("bigint") + radius)))
    peaks = around.join(near, ["asset_id", "frame"]).groupBy("asset_id", "g", "period").agg(F.max(F.struct("env", (-F.col("frame")).alias("f"), "before", "after")).alias("p")).filter(F.col("p.env") >= min_strength)
    y0, y1, y2 = F.col("p.before"), F.col("p.env"), F.col("p.after")
    curve = y0 - y1 * 2 + y2
    shift = F.when(y0.isNotNull() & y2.isNotNull() & (F.abs(curve) > 1e-12), F.least(F.lit(0.5), F.greatest(F.lit(-0.5), (y0 - y2) * 0.5 / curve))).otherwise(0.0)
    placed = peaks.select("asset_id", "g", "period", (-F.col("p.f") + shift).alias("position"), y1.alias("strength"))

    class Space(Processor):
        def start(self, key):
            self.key, self.last = key[0], None

        def feed(self, cols):
            keep = []
            for i, (p, period) in enumerate(zip(cols["position"], cols["period"])):
                if self.last is None or p - self.last > period / 2:
                    keep.append(i)
                    self.last = p
            return {"asset_id": [self.key] * len(keep), "position": cols["position"][keep], "strength": cols["strength"][keep]} if keep else None

    return sequential(placed, ["asset_id"], ["g"], "asset_id bigint, position double, strength double", Space)


def classify_beats(beats: DataFrame, quantile: float = 0.6) -> DataFrame:
    """beat1 for beats at or above the asset's strength quantile, beat2 otherwise. beats: asset_id, strength."""
    thr = exact_quantile(beats, ["asset_id"], "strength", {"_thr": quantile}, 0.01).drop("n")
    return beats.join(thr, "asset_id").withColumn("kind", F.when((F.col("strength") >= F.col("_thr")) & (F.col("strength") > 0), "beat1").otherwise("beat2")).drop("_thr")


# --------------------------------------------------------------------------- cuts


def smoothness(flow_percent: Column, histogram_similarity: Column) -> Column:
    """0..1 from mean motion (percent of the frame width) and colour similarity."""
    s = F.exp(flow_percent / -4.0) * 0.6 + histogram_similarity * 0.4
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 4)


def suggest_transitions(cuts: DataFrame) -> DataFrame:
    """dissolve for jarring cuts: below 0.12, or below 0.2 and half the asset's median (three cuts or more).

    cuts: asset_id, smoothness."""
    med = exact_quantile(cuts, ["asset_id"], "smoothness", {"_med": 0.5}, 0.01)
    j = cuts.join(med, "asset_id")
    s = F.col("smoothness")
    bad = (s < 0.12) | ((F.col("n") >= 3) & (s < 0.2) & (s < F.col("_med") * 0.5))
    return j.withColumn("suggestion", F.when(bad, "dissolve").otherwise("cut")).drop("n", "_med")
