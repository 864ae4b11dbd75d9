"""Image-table jobs: lookups in 3D tables, layer compositing, colour histograms, cut tests, grades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions import color as c

# fixed slider ranges
RANGES = {"exposure": (-50, 50), "brilliance": (-50, 50), "contrast": (-50, 50), "brightness": (-50, 50), "highlights": (-50, 50), "shadows": (-50, 50), "saturation": (-50, 50),
          "vibrance": (-50, 50), "sharpness": (0, 50), "temperature": (-50, 50), "tint": (-50, 50), "vignette": (0, 1), "grain": (0, 1)}


def effective_grade(clips: DataFrame, adjust: DataFrame) -> DataFrame:
    """Clip grades plus the project's enabled adjustment. Only sliders with a delta are moved and clamped; HSL
    channels add up inside +-100. Grade columns are flat; hsl is map<string, struct<h,s,l>>.

    adjust: project_id, enabled, the slider columns (nullable) and optionally hsl."""
    names = [n for n in RANGES if n in clips.columns and n in adjust.columns]
    cols = [F.col(n).alias(f"_d_{n}") for n in names] + ([F.col("hsl").alias("_d_hsl")] if "hsl" in adjust.columns else [])
    j = clips.join(adjust.filter("enabled").select("project_id", *cols), "project_id", "left")
    fresh = {}
    for n in names:
        lo, hi = RANGES[n]
        moved = F.least(F.greatest(F.coalesce(F.col(n), F.lit(0.0)) + F.col(f"_d_{n}"), F.lit(float(lo))), F.lit(float(hi)))
        fresh[n] = F.when(F.col(f"_d_{n}").isNotNull(), moved).otherwise(F.col(n))
    if "hsl" in clips.columns and "hsl" in adjust.columns:
        part = lambda a, b, p: F.least(F.greatest(F.coalesce(a[p], F.lit(0.0)) + b[p], F.lit(-100.0)), F.lit(100.0)).alias(p)
        mixed = F.map_zip_with("hsl", "_d_hsl", lambda k, a, b: F.when(b.isNull(), a).otherwise(F.struct(part(a, b, "h"), part(a, b, "s"), part(a, b, "l"))))
        fresh["hsl"] = F.when(F.col("_d_hsl").isNull(), F.col("hsl")).otherwise(mixed)
    return j.select(*[fresh.get(n, F.col(n)).alias(n) for n in clips.columns])


def lut_cells(lattice: DataFrame) -> DataFrame:
    """One row per cell of a 3D table with its eight corners: lut_id, cr, cg, cb, and _l<channel>0..7, the
    corner's bits being (r, g, b)."""
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)))
    bit = lambda i: F.shiftright("_k", i).bitwiseAND(F.lit(1))
    at = lattice.withColumn("_k", corner).select("lut_id", "size", "_k", "r", "g", "b", *[(F.col(f"i{ch}") - bit(i)).cast("bigint").alias(f"c{ch}") for i, ch in enumerate("rgb")])
    for ch in "rgb":
        at = at.filter(F.col(f"c{ch}").between(0, F.col("size") - 2))
    return at.groupBy("lut_id", "cr", "cg", "cb").agg(*[F.max(F.when(F.col("_k") == k, F.col(ch))).alias(f"_l{ch}{k}") for ch in "rgb" for k in range(8)])


def apply_lut(pixels: DataFrame, lattice: DataFrame, keys: list[str]) -> DataFrame:
    """Trilinear 3D-table lookup mixed in by ``intensity``. pixels: keys, lut_id, intensity, r, g, b; lattice:
    lut_id, size, ir, ig, ib, r, g, b. Each pixel meets its cell once, in an equi-join; pixels are not grouped."""
    size = lattice.groupBy("lut_id").agg(F.max("size").alias("size"))
    p = pixels.select(*keys, "lut_id", "intensity", *[F.col(ch).alias(f"_p{ch}") for ch in "rgb"]).join(size, "lut_id")
    n = F.col("size") - 1
    for ch in "rgb":
        f = F.least(F.greatest(F.col(f"_p{ch}") * n, F.lit(0.0)), n.cast("double"))
        p = p.withColumn(f"c{ch}", F.least(F.floor(f), n - 1).cast("bigint")).withColumn(f"_{ch}t", f - F.col(f"c{ch}"))
    side = lambda ch, on: F.col(f"_{ch}t") if on else F.lit(1.0) - F.col(f"_{ch}t")
    weight = [side("r", k & 1) * side("g", k >> 1 & 1) * side("b", k >> 2) for k in range(8)]
    mixed = lambda ch: sum((F.col(f"_l{ch}{k}") * weight[k] for k in range(1, 8)), F.col(f"_l{ch}0") * weight[0])
    cells = p.join(lut_cells(lattice), ["lut_id", "cr", "cg", "cb"])
    return cells.select(*keys, *[(F.col(f"_p{ch}") + (mixed(ch) - F.col(f"_p{ch}")) * F.col("intensity")).alias(ch) for ch in "rgb"])


def composite_layers(layers: DataFrame, by: list[str]) -> DataFrame:
    """Fold the layers of each pixel in draw order over black. layers: by, layer (draw order), r, g, b, mode, alpha.
    A pixel has as many rows as there are layers over it."""
    item = F.struct("layer", "mode", "alpha", "r", "g", "b")
    stack = layers.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    mix = lambda acc, s, ch: (acc[ch] + (c.blend_channel(s["mode"], acc[ch], s[ch]) - acc[ch]) * F.least(F.greatest(s["alpha"], F.lit(0.0)), F.lit(1.0))).alias(ch)
    zero = F.struct(*[F.lit(0.0).alias(ch) for ch in "rgb"])
    return stack.select(*by, F.aggregate("_s", zero, lambda acc, s: F.struct(*[mix(acc, s, ch) for ch in "rgb"])).alias("_o")).select(*by, "_o.r", "_o.g", "_o.b")


def colour_histogram(pixels: DataFrame, by: list[str], h_bins: int = 32, s_bins: int = 16) -> DataFrame:
    """(by, h_bin, s_bin, value): hue x saturation counts scaled to unit length."""
    h, s, _ = c.rgb_to_hsv(c.rgb())
    cell = lambda v, n: F.least(F.floor(v * n), F.lit(n - 1)).cast("bigint")
    counts = pixels.groupBy(*by, cell(h, h_bins).alias("h_bin"), cell(s, s_bins).alias("s_bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_len"))
    return counts.join(total, by).select(*by, "h_bin", "s_bin", (F.col("n") / F.col("_len")).alias("value"))


def histogram_correlation(a: DataFrame, b: DataFrame, by: list[str], bins: int = 512) -> DataFrame:
    """Pearson correlation of two histograms over all bins (absent bins are 0), clamped to 0..1."""
    x = a.select(*by, "h_bin", "s_bin", F.col("value").alias("x"))
    y = b.select(*by, "h_bin", "s_bin", F.col("value").alias("y"))
    j = x.join(y, [*by, "h_bin", "s_bin"], "full_outer").fillna(0.0, ["x", "y"])
    m = j.groupBy(*by).agg(*[F.sum(e).alias(n) for n, e in (("sx", F.col("x")), ("sy", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
    cov = F.col("xy") - F.col("sx") * F.col("sy") / bins
    var = (F.col("xx") - F.col("sx") * F.col("sx") / bins) * (F.col("yy") - F.col("sy") * F.col("sy") / bins)
    return m.select(*by, F.when(var > 1e-24, F.least(F.lit(1.0), F.greatest(F.lit(0.0), cov / F.sqrt(var)))).otherwise(1.0).alias("similarity"))


def is_hard_cut(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Mean absolute difference above 35 (of 255) or histogram similarity below 0.8 between two images.

    a, b: by, x, y, r, g, b with the same pixel grid."""
    q = b.select(*by, "x", "y", *[F.col(ch).alias(f"o_{ch}") for ch in "rgb"])
    diff = a.join(q, [*by, "x", "y"]).groupBy(*by).agg((F.avg(sum((F.abs(F.col(ch) - F.col(f"o_{ch}")) for ch in "rgb"), F.lit(0.0)) / 3) * 255).alias("mean_diff"))
    sim = histogram_correlation(colour_histogram(a, by), colour_histogram(b, by), by)
    return diff.join(sim, by).withColumn("hard_cut", (F.col("mean_diff") > 35) | (F.col("similarity") < 0.8))


def patch_descriptor(pixels: DataFrame, by: list[str], size: int = 64) -> DataFrame:
    """Unit-length descriptor of a size x size patch: 8 x 8 x 4 hue-saturation-value shares, then 9 gradient
    directions in each of four cells at half weight. pixels: by, x, y (0..size-1), r, g, b. Returns (by, slot, value).

    A patch is size^2 rows, the bounded group all windows work on."""
    h, s, v = c.rgb_to_hsv(c.rgb())
    cell = lambda q, n: F.least(F.floor(q * n), F.lit(n - 1))
    n_px = float(size * size)
    hist = pixels.groupBy(*by, (cell(h, 8) * 32 + cell(s, 8) * 4 + cell(v, 4)).cast("int").alias("slot")).agg((F.count("*") / n_px).alias("value"))
    grey = pixels.select(*by, "x", "y", (F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114).alias("v"))
    row, col = Window.partitionBy(*by, "y").orderBy("x"), Window.partitionBy(*by, "x").orderBy("y")
    mirror = lambda w, k: F.coalesce((F.lag if k < 0 else F.lead)("v").over(w), (F.lead if k < 0 else F.lag)("v").over(w))
    g = grey.withColumn("_dx", mirror(row, 1) - mirror(row, -1)).withColumn("_sx", mirror(row, 1) + mirror(row, -1) + F.col("v") * 2)
    nb = lambda name, k: F.coalesce((F.lag if k < 0 else F.lead)(name).over(col), (F.lead if k < 0 else F.lag)(name).over(col))
    g = g.withColumn("gx", nb("_dx", -1) + F.col("_dx") * 2 + nb("_dx", 1)).withColumn("gy", nb("_sx", 1) - nb("_sx", -1))
    turn = (F.atan2("gy", "gx") + math.pi) / (2 * math.pi)
    half = size // 2
    g = g.withColumn("_q", (F.when(F.col("y") >= half, 2).otherwise(0) + F.when(F.col("x") >= half, 1).otherwise(0))).withColumn("_b", cell(turn, 9))
    mag = F.hypot("gx", "gy")
    hog = g.groupBy(*by, "_q", "_b").agg(F.sum(mag).alias("m"))
    cells = hog.groupBy(*by, "_q").agg(F.sum("m").alias("t"))
    dirs = hog.join(cells, [*by, "_q"]).select(*by, (F.lit(256) + F.col("_q") * 9 + F.col("_b")).cast("int").alias("slot"), (F.col("m") / (F.col("t") + 1e-9) * 0.5).alias("value"))
    both = hist.unionByName(dirs)
    length = both.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_len"))
    return both.join(length, by).select(*by, "slot", (F.col("value") / (F.col("_len") + 1e-9)).alias("value"))
