"""Detections in frames: filters, suppression, pairs, duplicate subjects and per-shot statistics.

Detection rows carry frame_id, det (unique in a frame), label, score, x1, y1, x2, y2; identity columns
(character, best, id_score, rejected) are optional additions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.functions import geometry as g
from mediaframe.plans.priority import keep_best
from mediaframe.plans.sequential import greedy_pairs
from mediaframe.plans.tiles import tiled_join, tiled_self_join
from mediaframe.session import cut_lineage

# fixed values
GENERIC_WORDS = ("character", "creature", "animal", "person", "people", "figure")
OVERLAP_IOU = 0.3
NESTED_MAX = 0.6
BORDERLINE_MARGIN = 0.1
MIN_HEIGHT_FRACTION = 0.15
CHARACTER_LIKE_MARGIN = 0.12
PSEUDO_ID_BASE = 100_000
CAST_THRESHOLD = 0.66
CAST_MARGIN = 0.05
CAST_THRESHOLD_STRONG_TEXT = 0.62
TEXT_AGREES, TEXT_CERTAIN = 0.8, 0.95


# --------------------------------------------------------------------------- labels


def is_generic(label: Column) -> Column:
    return F.coalesce(F.lower(label), F.lit("")).rlike("|".join(GENERIC_WORDS))


def labels_compatible(a: Column, b: Column) -> Column:
    return (a == b) | is_generic(a) | is_generic(b)


def snap_label(phrase: Column, prompts: list[str]) -> Column:
    """The prompt a model phrase came from: exact, then one inside the other, then most shared words."""
    ph = F.lower(F.trim(phrase))
    words = F.array_distinct(F.filter(F.split(ph, r"\s+"), lambda w: w != ""))
    exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
    best, best_n = F.lit(None).cast("string"), F.lit(0)
    for p in reversed(prompts):
        pl = p.strip().lower()
        exact = F.when(ph == pl, p).otherwise(exact)
        inside = F.when(ph.contains(pl) | F.lit(pl).contains(ph), p).otherwise(inside)
    for p in prompts:
        shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(set(p.lower().split()))])))
        better = shared > best_n
        best, best_n = F.when(better, p).otherwise(best), F.when(better, shared).otherwise(best_n)
    return F.when((ph != "") & phrase.isNotNull(), F.coalesce(exact, inside, best))


# --------------------------------------------------------------------------- filters


def score_class(dets: DataFrame, high: float, low: float, min_area: float = 1.0) -> DataFrame:
    """Drop tiny boxes and mark the rest high / low / none by score."""
    s = F.col("score")
    return dets.filter(g.raw_area(g.box()) >= min_area).withColumn(
        "score_class", F.when(s >= high, "high").when(s >= low, "low").otherwise("none"))


def filter_candidates(dets: DataFrame, w: float, h: float, min_area_frac: float = 0.012) -> DataFrame:
    """Whole-figure candidates: big enough, not too flat or thin; small ones need ``char_prob`` >= 0.5."""
    b = g.box()
    bw, bh = g.width(b), g.height(b)
    shape = (bw * bh >= min_area_frac * w * h) & (bw / F.greatest(bh, F.lit(1.0)) <= 2.5) & (bh / F.greatest(bw, F.lit(1.0)) <= 5.0)
    return dets.filter(shape & ((F.col("char_prob") >= 0.5) | (bh >= 0.25 * h)))


def loose_cast(best: Column, score: Column, margin: Column, rejected: Column, text_best: Column, text_prob: Column) -> Column:
    """The best guess when it passes the looser rule used for cast tags, else null."""
    agree = F.coalesce(text_best == best, F.lit(False))
    clear = (margin >= CAST_MARGIN) | (agree & (text_prob >= TEXT_AGREES))
    ok = ((score >= CAST_THRESHOLD) & clear) | (agree & (score >= CAST_THRESHOLD_STRONG_TEXT) & (text_prob >= TEXT_CERTAIN))
    return F.when(ok & rejected.isNull() & best.isNotNull(), best)


def escalation_reason(frames: Column, detections: Column, ambiguous: Column, borderline: Column) -> Column:
    """Why a shot needs the strong model, or null."""
    return (F.when((frames > 0) & (detections == 0), "nothing found")
            .when(ambiguous > OVERLAP_IOU, "ambiguous overlap").when(borderline > 0, "borderline similarity"))


# --------------------------------------------------------------------------- greedy per-frame operators


def nms(dets: DataFrame, iou: float = 0.7, class_agnostic: bool = False) -> DataFrame:
    """Greedy suppression, best score first; ties keep detection order. Returns the kept (frame_id, det)."""
    blocks = g.iou(g.box("a_"), g.box("b_")) > iou
    if not class_agnostic:
        blocks = blocks & F.col("a_label").eqNullSafe(F.col("b_label"))
    return keep_best(dets.select("frame_id", "det", "label", (-F.col("score")).alias("rank"), "x1", "y1", "x2", "y2"), ["frame_id"], "det", blocks)


def nested_filter(dets: DataFrame, contain: float = 0.8) -> DataFrame:
    """Largest box first, drop boxes mostly inside a kept one. Returns the kept (frame_id, det)."""
    rows = dets.select("frame_id", "det", (-g.raw_area(g.box())).alias("rank"), "x1", "y1", "x2", "y2")
    return keep_best(rows, ["frame_id"], "det", g.containment(g.box("b_"), g.box("a_")) > contain)


def iou_match(dets: DataFrame, tracks: DataFrame, w: float, h: float, min_iou: float = 0.5) -> DataFrame:
    """Detection -> track id by greedy one-to-one IoU; the rest get an id from their 8 x 8 frame cell.

    The join only meets boxes of one frame whose IoU passes; the greedy pass streams those candidates in
    falling IoU and remembers used ids only."""
    t = tracks.select(F.col("frame_id").alias("_f"), "track_id", *[F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2")])
    overlap = g.iou(g.box(), g.box("t_"))
    cand = tiled_join(dets, t, "frame_id", "_f", "det", "track_id", g.intersects(g.box(), g.box("t_"))).withColumn("iou", overlap).filter(
        F.col("iou") >= min_iou).select("frame_id", "det", "track_id", (-F.col("iou")).alias("rank"))

    won = greedy_pairs(cand, ["frame_id"], ["rank", "det", "track_id"], "det", "track_id")
    cell = lambda c, size: F.least(F.lit(7), F.greatest(F.lit(0), F.floor(c / size * 8))).cast("bigint")
    pseudo = PSEUDO_ID_BASE + cell(g.centre_y(g.box()), h) * 8 + cell(g.centre_x(g.box()), w)
    return dets.join(won, ["frame_id", "det"], "left").withColumn("track_id", F.coalesce(F.col("track_id"), pseudo))


# --------------------------------------------------------------------------- pairs and duplicates


def pair_detections(dets: DataFrame, w: float, h: float, min_iou: float = 0.0) -> DataFrame:
    """Overlapping pairs of one frame (IoU > ``min_iou``) with their geometry. Boxes that do not touch have
    IoU and containment 0 and are not listed. With a ``character`` column pairs also tell ``different``."""
    a, b = g.box("a_"), g.box("b_")
    named = [c for c in ("character",) if c in dets.columns]
    iou = g.iou(a, b, (F.col("a__area"), F.col("b__area")))
    pairs = tiled_self_join(dets.select("frame_id", "det", "label", "score", "x1", "y1", "x2", "y2", *named, g.area(g.box()).alias("_area")), ["frame_id"], "det",
                            g.intersects(a, b) & (iou > min_iou))
    return pairs.select(
        "frame_id", F.col("a_det").alias("det_a"), F.col("b_det").alias("det_b"), iou.alias("iou"),
        F.greatest(g.containment(a, b), g.containment(b, a)).alias("containment"),
        (g.raw_area(a) / g.raw_area(b)).alias("area_ratio"), g.head_in_body(a, b).alias("nested"),
        labels_compatible(F.col("a_label"), F.col("b_label")).alias("compatible"),
        g.centre_distance(a, w, h).alias("dist_a"), g.centre_distance(b, w, h).alias("dist_b"),
        F.least(g.height(a), g.height(b)).alias("min_height"), *([certainly_different().alias("different")] if named else []))


def duplicate_pairs(dets: DataFrame, similarity, w: float, h: float, threshold: float = 0.85,
                    like_floor: float | None = None, unique_ids: list[str] | None = None) -> DataFrame:
    """Pairs of one frame that could be the same subject twice, with ``sim``, ``rule`` (null where the pair isn't alike
    enough for any) and ``generic`` (judged by looks alone). Columns of the two rows come as ``a_*`` and ``b_*``.

    dets need track_id, character, best, id_score, rejected besides the boxes, and the columns the
    ``similarity(a_prefix, b_prefix)`` expression reads. ``rule`` is named, near (same best guess below the id threshold),
    generic, or borderline (counted, not a finding). Overlapping or nested pairs never qualify."""
    box = g.box()
    rows = dets.withColumns({
        "_area": g.raw_area(box), "_height": g.height(box), "_dist": g.centre_distance(box, w, h), "_generic": is_generic(F.col("label")),
        "_known": F.col("best").isNotNull() & F.col("rejected").isNull()})
    a, b = g.box("a_"), g.box("b_")
    col = lambda side, name: F.col(f"{side}_{name}")
    both = lambda fn, name: fn(col("a", name), col("b", name))
    inter = g.intersection(a, b)
    aa, ab = col("a", "_area"), col("b", "_area")
    apart = (inter <= OVERLAP_IOU * (aa + ab - inter)) & (inter <= NESTED_MAX * F.greatest(F.lit(1e-6), F.least(aa, ab)))
    unique = lambda c: F.lit(True) if unique_ids is None else c.isin(unique_ids)
    floor = F.lit(True) if like_floor is None else both(F.least, "id_score") >= like_floor
    tall = both(F.least, "_height") >= MIN_HEIGHT_FRACTION * h
    named = col("a", "character").isNotNull() | col("b", "character").isNotNull()
    same_named = F.coalesce((col("a", "character") == col("b", "character")) & unique(col("a", "character")), F.lit(False))
    like = col("a", "_known") & col("b", "_known") & floor & F.lit(like_floor is not None)
    same_best = col("a", "best") == col("b", "best")
    near = like & same_best & unique(col("a", "best")) & tall
    plain = (((col("a", "label") == col("b", "label")) | col("a", "_generic") | col("b", "_generic")) & tall & floor
             & (aa > 0) & (ab > 0) & (aa >= ab * 0.5) & (aa <= ab * 2.0))
    # what the pair could be, before looking at the (expensive) similarity
    kind = F.when(named, F.when(same_named, 1)).when(F.coalesce(like & ~same_best, F.lit(False)), F.lit(None)).otherwise(
        F.nullif(F.when(F.coalesce(near, F.lit(False)), 2).otherwise(0) + F.when(plain, 4).otherwise(0), F.lit(0)))
    pairs = tiled_self_join(rows, ["frame_id"], "det", apart & kind.isNotNull()).withColumn("kind", kind)
    # explode keeps the similarity in one place: it is evaluated once per pair, before the rule filter
    pairs = pairs.withColumn("sim", F.explode(F.array(similarity("a_", "b_"))))
    hit, bit = F.col("sim") >= threshold, lambda n: F.col("kind").bitwiseAND(n) > 0
    rule = (F.when(bit(1), F.when(hit, "named")).when(bit(2) & hit, "near").when(bit(4) & hit, "generic")
            .when(bit(4) & (F.col("sim") >= threshold - BORDERLINE_MARGIN), "borderline"))
    return pairs.withColumn("rule", rule).withColumn("generic", bit(4) & ~(bit(2) & hit))


def duplicate_candidates(dets: DataFrame, similarity, w: float, h: float, threshold: float = 0.85,
                         like_floor: float | None = None, unique_ids: list[str] | None = None) -> DataFrame:
    """The pairs of ``duplicate_pairs`` with a rule, as primary (``p_*``) and duplicate (``d_*``)."""
    pairs = duplicate_pairs(dets, similarity, w, h, threshold, like_floor, unique_ids)
    col = lambda side, name: F.col(f"{side}_{name}")
    aa, ab = col("a", "_area"), col("b", "_area")
    da, db = col("a", "_dist"), col("b", "_dist")
    by_score = F.when(F.abs(col("a", "id_score") - col("b", "id_score")) > 1e-6, col("a", "id_score") > col("b", "id_score")).otherwise(da <= db)
    by_centre = (da < db) | ((F.abs(da - db) < 1e-6) & (aa >= ab))
    out = pairs.filter(F.col("rule").isNotNull()).withColumn("similarity", F.round("sim", 4)).withColumn(
        "first", F.when(F.col("rule").isin("named", "near"), by_score).otherwise(by_centre))
    take = lambda name, win: F.when(F.col("first") == win, col("a", name)).otherwise(col("b", name))
    return out.select(
        "frame_id", "rule", "similarity",
        F.when(F.col("rule") == "named", col("a", "character")).when(F.col("rule") == "near", col("a", "best")).alias("character"),
        *[take(n, True).alias(f"p_{n}") for n in ("det", "track_id", "x1", "y1", "x2", "y2")],
        *[take(n, False).alias(f"d_{n}") for n in ("det", "track_id", "x1", "y1", "x2", "y2")])


def finding_group() -> Column:
    """Key of one duplicate inside a shot: the character, or the two track ids in order."""
    return F.when(F.col("character").isNotNull(), F.concat(F.lit("char:"), F.col("character"))).otherwise(
        F.concat_ws(":", F.lit("pair"), F.least("p_track_id", "d_track_id"), F.greatest("p_track_id", "d_track_id")))


def confirm_findings(findings: DataFrame, min_frames: int = 2, keep_all: bool = True) -> DataFrame:
    """Findings of groups seen in enough distinct frames (findings need shot_id and frame_id)."""
    f = cut_lineage(findings.withColumn("group_key", finding_group()))  # read twice
    seen = f.groupBy("shot_id", "group_key").agg(F.countDistinct("frame_id").alias("_frames")).filter(F.col("_frames") >= min_frames)
    out = f.join(seen.select("shot_id", "group_key"), ["shot_id", "group_key"], "left_semi")
    return out if keep_all else representative(out)


def representative(findings: DataFrame) -> DataFrame:
    """The middle finding (element n // 2 by frame) of each group. Position and size come from ordered
    scans, so a group with very many findings is not sorted in one task."""
    from mediaframe.plans import scan
    from mediaframe.plans.joins import bucket_of

    f = cut_lineage(findings.withColumn("group_key", finding_group()))  # the scan reads it several times
    placed = scan.ordered_scan(f, ["shot_id", "group_key"], [F.col("frame_id"), F.col("p_det"), F.col("d_det")],
                               bucket_of(F.col("frame_id"), 4096), pos=scan.number(), size=scan.total(F.lit(1)))
    return placed.filter(F.col("pos") == F.floor(F.col("size") / 2) + 1).drop("pos", "size")


def harmonize_roles(findings: DataFrame) -> DataFrame:
    """Keep the primary on one side for every finding of a group: the majority side, on a tie the side with
    the larger mean primary."""
    f = cut_lineage(findings.withColumn("group_key", finding_group()))  # read twice
    p, d = g.box("p_"), g.box("d_")
    left = g.centre_x(p) < g.centre_x(d)
    votes = f.groupBy("shot_id", "group_key").agg(
        F.count_if(left).alias("_nl"), F.count_if(~left).alias("_nr"),
        F.avg(F.when(left, g.area(p))).alias("_al"), F.avg(F.when(~left, g.area(p))).alias("_ar"))
    keep_left = F.when(F.col("_nl") != F.col("_nr"), F.col("_nl") > F.col("_nr")).otherwise(F.col("_al") >= F.col("_ar"))
    j = f.join(votes, ["shot_id", "group_key"]).withColumn(
        "swap", (F.col("_nl") > 0) & (F.col("_nr") > 0) & (left != keep_left))
    names = ("det", "track_id", "x1", "y1", "x2", "y2")
    flip = {f"{s}_{n}": F.when(F.col("swap"), F.col(f"{o}_{n}")).otherwise(F.col(f"{s}_{n}"))
            for s, o in (("p", "d"), ("d", "p")) for n in names if f"{s}_{n}" in findings.columns}
    return j.select(*[flip.get(c, F.col(c)).alias(c) for c in findings.columns], "group_key", "swap")


def dedupe_findings(findings: DataFrame) -> DataFrame:
    return representative(findings)


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """The strong pass plus the named findings of the cheap pass whose character it lacks (per shot)."""
    have = second.filter(F.col("character").isNotNull()).select("shot_id", "character").distinct()
    extra = first.filter(F.col("character").isNotNull()).join(have, ["shot_id", "character"], "left_anti")
    return second.unionByName(extra.select(*second.columns))


# --------------------------------------------------------------------------- statistics


def shot_stats(dets: DataFrame, pairs: DataFrame, h: float, alike: DataFrame | None = None) -> DataFrame:
    """Per shot: frames, detections, overlapping pairs, highest overlap of compatible pairs, highest ambiguous overlap.
    Pairs with ``different`` set (two cast members for certain) are not ambiguous. With ``alike`` (duplicate_pairs with
    shot_id) also the pairs judged by looks, how many of them are borderline, and their highest similarity."""
    base = dets.groupBy("shot_id").agg(F.countDistinct("frame_id").alias("frames"), F.count("*").alias("detections"))
    different = F.coalesce("different", F.lit(False)) if "different" in pairs.columns else F.lit(False)
    ambiguous = F.col("compatible") & ~F.col("nested") & ~different & (F.col("min_height") >= MIN_HEIGHT_FRACTION * h)
    over = pairs.groupBy("shot_id").agg(
        F.count("*").alias("pairs"), F.max(F.when(F.col("compatible"), F.col("iou"))).alias("max_label_iou"),
        F.max(F.when(ambiguous, F.col("iou"))).alias("max_ambiguous_iou"))
    zero = F.lit(0.0)
    out = base.join(over, "shot_id", "left").select(
        "shot_id", "frames", "detections", F.coalesce("pairs", F.lit(0)).alias("pairs"),
        F.coalesce("max_label_iou", zero).alias("max_label_iou"), F.coalesce("max_ambiguous_iou", zero).alias("max_ambiguous_iou"))
    if alike is None:
        return out
    looks = alike.filter("generic").groupBy("shot_id").agg(
        F.count("*").alias("generic_pairs"), F.count_if(F.col("rule") == "borderline").alias("borderline"), F.max("sim").alias("max_sim"))
    return out.join(looks, "shot_id", "left").withColumns({
        "generic_pairs": F.coalesce("generic_pairs", F.lit(0)), "borderline": F.coalesce("borderline", F.lit(0)), "max_sim": F.coalesce("max_sim", zero)})


def certainly_different(a: str = "a_", b: str = "b_") -> Column:
    """Two cast members for certain: different confident characters."""
    return F.coalesce(F.col(f"{a}character") != F.col(f"{b}character"), F.lit(False))


def shot_cast(sightings: DataFrame, min_frames: int = 2, min_hits: int = 3) -> DataFrame:
    """Who is in a shot: confident in >= ``min_frames`` frames, or carried by one track with >= ``min_hits``
    loose hits and a strict majority of that track's hits.

    sightings: shot_id, frame_id, track_id, character (confident, nullable), loose (nullable)."""
    confident = (sightings.filter(F.col("character").isNotNull()).groupBy("shot_id", "character")
                 .agg(F.countDistinct("frame_id").alias("n")).filter(F.col("n") >= min_frames).select("shot_id", "character"))
    hits = sightings.filter(F.col("loose").isNotNull() & (F.col("track_id") < PSEUDO_ID_BASE)).groupBy(
        "shot_id", "track_id", F.col("loose").alias("character")).agg(F.count("*").alias("n"))
    everyone = hits.groupBy("shot_id", "track_id").agg(F.sum("n").alias("all_hits"))
    carried = hits.join(everyone, ["shot_id", "track_id"]).filter(
        (F.col("n") >= min_hits) & (F.col("n") * 2 > F.col("all_hits"))).select("shot_id", "character")
    return confident.union(carried).distinct()


def scene_tags(shots: DataFrame, cast: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names of everyone seen in an asset, in manifest order, joined into one text.

    shots: asset_id, shot_id; cast: shot_id, character; manifest: character, name, position."""
    seen = shots.join(cast, "shot_id").select("asset_id", "character").distinct().join(manifest, "character")
    return seen.groupBy("asset_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s["name"]), ",").alias("tags"))


def cast_intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    """(shot_id, character) reported by both passes."""
    cols = ["shot_id", "character"]
    return first.select(*cols).intersect(second.select(*cols))


def reuse_detections(wanted: DataFrame, cache: DataFrame, threshold: float) -> DataFrame:
    """Cached detections of frames whose checksum matches and whose score floor is low enough; ``hit``
    tells which wanted frames were served. Misses keep one row with null detection columns."""
    c = cache.filter(F.col("floor") <= threshold + 1e-9).withColumn("hit", F.lit(True))
    served = wanted.join(c, ["detector", "frame_id", "checksum"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return served.filter(~F.col("hit") | (F.col("score") >= threshold))


def mask_to_bbox(masks: DataFrame, boxes: DataFrame, w: int, h: int, min_fill: float = 0.15, slack: float = 0.05) -> DataFrame:
    """Tight box around the mask pixels inside the slightly grown box; the box itself when too few.

    masks: frame_id, det, x, y (integer pixels); boxes: frame_id, det, x1..y2."""
    b = g.box()
    bw, bh = g.width(b), g.height(b)
    lo = lambda c, s: F.greatest(F.lit(0.0), F.floor(c - s * slack).cast("double"))
    hi = lambda c, s, top: F.least(F.lit(float(top)), F.ceil(c + s * slack).cast("double"))
    inside = boxes.join(masks, ["frame_id", "det"], "left").filter(F.col("x").isNull() | (
        (F.col("x") >= lo(b.x1, bw)) & (F.col("x") < hi(b.x2, bw, w)) & (F.col("y") >= lo(b.y1, bh)) & (F.col("y") < hi(b.y2, bh, h))))
    tight = inside.groupBy("frame_id", "det").agg(F.count("x").alias("n"), F.min("x").alias("mx1"), F.min("y").alias("my1"),
                                                  (F.max("x") + 1).alias("mx2"), (F.max("y") + 1).alias("my2"))
    enough = F.coalesce((F.col("n") > 0) & (F.col("n") >= F.greatest(bw * bh, F.lit(1.0)) * min_fill), F.lit(False))
    pick = lambda m, c: F.when(enough, F.col(m).cast("double")).otherwise(F.col(c)).alias(c)
    return boxes.join(tight, ["frame_id", "det"], "left").select(
        "frame_id", "det", pick("mx1", "x1"), pick("my1", "y1"), pick("mx2", "x2"), pick("my2", "y2"), enough.alias("tightened"))


def visible_union(boxes: DataFrame, by: list[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def lineup_by_rank(boxes: DataFrame, lineup: DataFrame) -> DataFrame:
    """The n best boxes of an image, left to right, zipped with the n listed characters.

    boxes: image_id, det, score, x1..y2 (non-nested); lineup: image_id, position (0-based), character."""
    from mediaframe.plans.quantile import top_k

    n = lineup.groupBy("image_id").agg(F.count("*").alias("n"))
    top = top_k(boxes.join(n, "image_id"), ["image_id"], [F.col("score").desc(), F.col("det")], F.col("n"))
    across = Window.partitionBy("image_id").orderBy(g.centre_x(g.box()), F.col("det"))
    placed = top.withColumn("position", F.row_number().over(across) - 1)
    return lineup.join(placed, ["image_id", "position"]).select("image_id", "position", "character", "det", "score", *g.box())
