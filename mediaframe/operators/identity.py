"""Who is in a crop: similarity of probe vectors to a bank of owned reference vectors.

probes: vec_id bigint, embedding (and image / lineup for calibration); bank: ref_id, owner int, crop_group, embedding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaframe.plans.matrix import tiled_products
from mediaframe.plans.quantile import exact_quantile
from mediaframe.plans.sequential import Processor, sequential
from mediaframe.session import cut_lineage

TOP = 3
NEGATIVE_OWNER = -1
REJECT_MASS = 0.5
# fixed clamp ranges for calibrated thresholds
THRESHOLD_RANGE, MARGIN_RANGE = (0.68, 0.74), (0.05, 0.08)
DEFAULT_THRESHOLD, DEFAULT_MARGIN = 0.72, 0.06
SAME_CROP_COS = 0.97


#: Columns of a block that share a maximum.
CHUNK = 32


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values of every row, greatest first; of equal ones the first. A wide row is settled by the
    maxima of chunks of its columns: the k greatest values lie in the k chunks with the greatest maxima, unless chunks tie."""
    n, wide = values.shape
    many = wide // CHUNK
    if many <= 2 * k:
        return np.argsort(-values, axis=1, kind="stable")[:, :k]
    # column c of every stretch of ``many`` columns belongs to chunk c, so that places rise along (stretch, chunk)
    body = values[:, :many * CHUNK].reshape(n, CHUNK, many)
    peaks, each = body.max(axis=1), np.arange(n)
    odd = np.isnan(peaks).any(axis=1)
    chunks = np.empty((n, k), dtype=np.int64)
    for i in range(k):
        chunks[:, i] = peaks.argmax(axis=1)
        least = peaks[each, chunks[:, i]]
        peaks[each, chunks[:, i]] = -np.inf
    tied = np.flatnonzero((peaks.max(axis=1) >= least) | ~np.isfinite(least) | odd)
    chunks.sort(axis=1)
    place = (np.arange(CHUNK)[:, None] * many + chunks[:, None, :]).reshape(n, -1)
    place = np.concatenate((place, np.broadcast_to(np.arange(many * CHUNK, wide), (n, wide - many * CHUNK))), axis=1)
    found, out = np.take_along_axis(values, place, axis=1), np.empty((n, k), dtype=np.int64)
    for i in range(k):
        at = found.argmax(axis=1)
        out[:, i] = place[each, at]
        found[each, at] = -np.inf
    if len(tied):
        out[tied] = np.argsort(-values[tied], axis=1, kind="stable")[:, :k]
    return out


def _best_per_owner(owners: np.ndarray, groups: np.ndarray, k: int):
    """Of references sorted by owner and group, a function of (cosines, ids): the top k crop groups of every owner for every
    row, each group by its best reference."""
    edge = np.flatnonzero(np.r_[True, (owners[1:] != owners[:-1]) | (groups[1:] != groups[:-1])])
    go, gg = owners[edge], groups[edge]
    first = np.flatnonzero(np.r_[True, go[1:] != go[:-1]])
    spans = list(zip(first.tolist(), np.append(first[1:], len(go)).tolist()))

    def best(sims: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
        if len(edge) < sims.shape[1]:
            sims = np.maximum.reduceat(sims, edge, axis=1)
        out = []
        for s, e in spans:
            # -inf marks masked references; rank by value, then by group for a fixed order
            rank = _top(sims[:, s:e], k)
            n = rank.shape[1]
            out.append((np.repeat(ids, n), np.full(rank.size, go[s]), gg[s:e][rank].ravel(), np.take_along_axis(sims[:, s:e], rank, axis=1).ravel()))
        df = pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("vec_id", "owner", "crop_group", "sim"))})
        return df[np.isfinite(df["sim"])]

    return best


BANK_ORDER = ["owner", "crop_group"]


def top_k_similar(probes: DataFrame, bank: DataFrame, k: int = TOP) -> DataFrame:
    """The k most similar crop groups of every owner, per probe, with their rank."""
    def bind(b):
        best = _best_per_owner(b["owner"].to_numpy(), b["crop_group"].to_numpy(), k)
        return lambda p, sims: best(sims, p["vec_id"].to_numpy())

    parts = tiled_products(probes.select("vec_id", "embedding"), bank.select("ref_id", *BANK_ORDER, "embedding"), "vec_id", "ref_id",
                           "vec_id bigint, owner int, crop_group bigint, sim double", bind, BANK_ORDER)
    return _rank_groups(parts, k)


def _rank_groups(parts: DataFrame, k: int) -> DataFrame:
    # a probe's few rows meet once: groups, ranks and what follows need no further move
    merged = parts.repartition("vec_id").groupBy("vec_id", "owner", "crop_group").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("vec_id", "owner").orderBy(F.col("sim").desc(), F.col("crop_group"))
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def owner_scores(probes: DataFrame, bank: DataFrame) -> DataFrame:
    """(vec_id, owner, score): mean of the top three crop groups."""
    return top_k_similar(probes, bank).groupBy("vec_id", "owner").agg(F.avg("sim").alias("score"))


def owner_scores_with_heads(probes: DataFrame, bank: DataFrame) -> DataFrame:
    """(vec_id, owner, score): the better of the full box against full-box references and the head against head references,
    from one pass over the bank. probes: vec_id, embedding, head (null: none); bank: ..., head (boolean)."""
    part = lambda head, column: F.struct(F.lit(head).alias("head"), F.col(column).alias("embedding"))
    both = F.filter(F.array(part(False, "embedding"), part(True, "head")), lambda p: p["embedding"].isNotNull())
    vectors = probes.select("vec_id", F.explode(both).alias("_p")).select("vec_id", "_p.head", "_p.embedding")

    def bind(b):
        of_head, bests = b["head"].to_numpy(dtype=bool), {}
        for kind in (False, True):
            refs = np.flatnonzero(of_head == kind)
            if len(refs):
                bests[kind] = refs, _best_per_owner(b["owner"].to_numpy()[refs], b["crop_group"].to_numpy()[refs], TOP)

        def reduce(p, sims):
            head, out = p["head"].to_numpy(dtype=bool), []
            for kind, (refs, best) in bests.items():
                rows = np.flatnonzero(head == kind)
                if len(rows):
                    out.append(best(sims[np.ix_(rows, refs)], p["vec_id"].to_numpy()[rows]).assign(head=kind))
            columns = ["vec_id", "head", "owner", "crop_group", "sim"]
            return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame({c: [] for c in columns})

        return reduce

    parts = tiled_products(vectors, bank, "vec_id", "ref_id", "vec_id bigint, head boolean, owner int, crop_group bigint, sim double", bind, BANK_ORDER)
    merged = parts.groupBy("vec_id", "head", "owner", "crop_group").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("vec_id", "head", "owner").orderBy(F.col("sim").desc(), F.col("crop_group"))
    top = merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP)
    return top.groupBy("vec_id", "owner", "head").agg(F.avg("sim").alias("score")).groupBy("vec_id", "owner").agg(F.max("score").alias("score"))


def with_heads(body: DataFrame, head: DataFrame) -> DataFrame:
    """Per owner the better of the full-box and the head score."""
    return body.unionByName(head).groupBy("vec_id", "owner").agg(F.max("score").alias("score"))


def identify(scores: DataFrame, threshold: float = DEFAULT_THRESHOLD, margin: float = DEFAULT_MARGIN) -> DataFrame:
    """Best owner, its score and the margin to the runner-up; ``owner`` is set when both pass."""
    w = Window.partitionBy("vec_id").orderBy(F.col("score").desc(), F.col("owner"))
    two = scores.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    best = two.groupBy("vec_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("owner"))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    return best.select("vec_id", "best", "score", (F.col("score") - F.col("second")).alias("margin")).withColumn(
        "owner", F.when((F.col("score") >= threshold) & (F.col("margin") >= margin), F.col("best")))


def zero_shot(probes: DataFrame, texts: DataFrame, scale: float = 100.0) -> DataFrame:
    """Softmax of ``scale`` x cosine over all texts, summed per owner. Each tile sends a shifted sum of
    exponentials, so the shares are exact however many tiles there are. texts: ref_id, owner, embedding."""
    def bind(b):
        owners = b["owner"].to_numpy()

        def reduce(p, sims):
            logits, ids = sims * scale, p["vec_id"].to_numpy()
            out = []
            for owner in np.unique(owners):
                part = logits[:, owners == owner]
                top = part.max(axis=1)
                out.append(pd.DataFrame({"vec_id": ids, "owner": owner, "peak": top, "mass": np.exp(part - top[:, None]).sum(axis=1)}))
            return pd.concat(out, ignore_index=True)

        return reduce

    parts = tiled_products(probes.select("vec_id", "embedding"), texts.select("ref_id", "owner", "embedding"), "vec_id", "ref_id",
                           "vec_id bigint, owner int, peak double, mass double", bind)
    w = Window.partitionBy("vec_id")
    m = parts.withColumn("m", F.col("mass") * F.exp(F.col("peak") - F.max("peak").over(w)))
    m = m.withColumn("prob", F.col("m") / F.sum("m").over(w))
    return m.groupBy("vec_id", "owner").agg(F.sum("prob").alias("prob"))


def open_set_reject(identified: DataFrame, text_share: DataFrame, negative: DataFrame, floor: float = 0.62) -> DataFrame:
    """Adds ``rejected``: the text share of the negatives wins, or a negative reference is at least as close.

    identified: vec_id, best, score; text_share: vec_id, owner, prob (negatives under owner -1);
    negative: vec_id, neg_score (top-three mean over negative references)."""
    neg = text_share.filter(F.col("owner") == NEGATIVE_OWNER).select("vec_id", F.col("prob").alias("p_neg"))
    own = text_share.filter(F.col("owner") != NEGATIVE_OWNER).select("vec_id", F.col("owner").alias("best"), F.col("prob").alias("p_own"))
    j = identified.join(neg, "vec_id", "left").join(own, ["vec_id", "best"], "left").join(negative, "vec_id", "left")
    p_own, ns = F.coalesce("p_own", F.lit(0.0)), F.coalesce("neg_score", F.lit(0.0))
    rejected = F.when(F.col("score") < floor, F.lit(None).cast("string")).when(
        (F.col("p_neg") >= REJECT_MASS) & (F.col("p_neg") > p_own), "text").when((ns > 0) & (ns >= F.col("score")), "reference")
    return j.withColumn("rejected", rejected).drop("p_neg", "p_own", "neg_score")


def calibration_rows(refs: DataFrame) -> DataFrame:
    """Leave-one-image-out: every reference is identified with the references of the other kind (line-up
    against sheet) from other images. refs: ref_id, owner, crop_group, image, lineup, embedding."""
    probes = refs.select(F.col("ref_id").alias("vec_id"), F.col("owner").alias("truth"), "image", "lineup", "embedding")

    def bind(b):
        best, places = _best_per_owner(b["owner"].to_numpy(), b["crop_group"].to_numpy(), TOP), b.groupby("image").indices

        def reduce(p, sims):
            for i, image in enumerate(p["image"].tolist()):
                own = places.get(image)
                if own is not None:
                    sims[i, own] = -np.inf
            return best(sims, p["vec_id"].to_numpy())

        return reduce

    # line-up meets sheet and sheet line-up: of each kind's products only these are made
    schema = "vec_id bigint, owner int, crop_group bigint, sim double"
    half = lambda kind: tiled_products(probes.filter(F.col("lineup") == kind).select("vec_id", "image", "embedding"),
                                       refs.filter(F.col("lineup") != kind).select("ref_id", *BANK_ORDER, "image", "embedding"), "vec_id", "ref_id", schema, bind, BANK_ORDER)
    parts = half(True).unionByName(half(False))
    scores = _rank_groups(parts, TOP).groupBy("vec_id", "owner").agg(F.avg("sim").alias("score"))
    j = scores.join(probes.select("vec_id", "truth"), "vec_id")
    rows = j.groupBy("vec_id", "truth").agg(
        F.max(F.when(F.col("owner") == F.col("truth"), F.col("score"))).alias("pos"),
        F.coalesce(F.max(F.when(F.col("owner") != F.col("truth"), F.col("score"))), F.lit(0.0)).alias("wrong"))
    return rows.filter(F.col("pos").isNotNull()).withColumn("gap", F.col("pos") - F.col("wrong")).withColumn("correct", (F.col("gap") > 0))


def calibrate(rows: DataFrame) -> DataFrame:
    """One row: query count, top-1 accuracy, threshold and margin chosen from the score distributions."""
    # the distributions are read several times, the products behind them are made once
    keyed = cut_lineage(rows.withColumn("_all", F.lit(1)))
    pos = exact_quantile(keyed, ["_all"], "pos", {"pos_p10": 0.1, "pos_median": 0.5}, 0.005)
    wrong = exact_quantile(keyed, ["_all"], "wrong", {"wrong_p90": 0.9, "wrong_median": 0.5}, 0.005).drop("n")
    gap = exact_quantile(keyed.filter(F.col("gap") > 0), ["_all"], "gap", {"gap_p10": 0.1}, 0.005).drop("n")
    hits = keyed.groupBy("_all").agg(F.avg(F.col("correct").cast("double")).alias("top1_accuracy"))
    clip = lambda c, r: F.least(F.greatest(c, F.lit(r[0])), F.lit(r[1]))
    j = pos.join(wrong, "_all").join(hits, "_all").join(gap, "_all", "left")
    raw = (F.col("pos_p10") + F.col("wrong_p90")) / 2
    return j.select(F.col("n").alias("queries"), "top1_accuracy", "pos_p10", "pos_median", "wrong_p90", "wrong_median", raw.alias("raw_threshold"),
                    clip(raw, THRESHOLD_RANGE).alias("threshold"),
                    clip(F.coalesce(F.col("gap_p10") / 2, F.lit(DEFAULT_MARGIN)), MARGIN_RANGE).alias("margin"))


def owner_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("truth").alias("owner")).agg(F.count("*").alias("queries"), F.avg(F.col("correct").cast("double")).alias("top1_accuracy"))


def crop_group(source: Column) -> Column:
    """``"sheet.webp#3rhf"`` -> ``"sheet.webp#3r"``: the crop a variant was made from."""
    image, tag = F.substring_index(source, "#", 1), F.when(source.contains("#"), F.regexp_replace(source, "^[^#]*#", "")).otherwise(F.lit(""))
    core = F.regexp_extract(tag, r"^(\d+r?)", 1)
    return F.concat(image, F.lit("#"), F.when(core != "", core).otherwise(tag))


def dedupe_references(refs: DataFrame, cos: float = SAME_CROP_COS) -> DataFrame:
    """Drop crops that are nearly identical to a kept crop of the same owner, query crops first.

    refs: ref_id, owner, source, embedding. All variants of a dropped crop go with it. Rows stream per owner;
    the state is the kept crops only."""
    tag = F.when(F.col("source").contains("#"), F.regexp_replace("source", "^[^#]*#", "")).otherwise(F.lit(""))
    r = refs.withColumn("crop", crop_group(F.col("source"))).withColumn("tag", tag)
    full = r.filter(F.col("tag").rlike(r"^\d+r?$")).withColumn("late", (~F.col("tag").rlike(r"^\d+$")).cast("int"))

    class Keep(Processor):
        def start(self, key):
            self.owner, self.kept = key[0], None

        def feed(self, cols):
            out = []
            for crop, e in zip(cols["crop"], cols["embedding"]):
                v = np.asarray(e, dtype=np.float64)
                if self.kept is not None and float((self.kept @ v).max()) > cos:
                    continue
                self.kept = v[None] if self.kept is None else np.vstack([self.kept, v])
                out.append(crop)
            return {"owner": [self.owner] * len(out), "crop": out} if out else None

    kept = sequential(full.select("owner", "late", "ref_id", "crop", "embedding"), ["owner"], ["late", "ref_id"], "owner int, crop string", Keep)
    views = full.select("owner", "crop").distinct()
    loose = r.join(views, ["owner", "crop"], "left_anti")
    return r.join(kept, ["owner", "crop"], "left_semi").unionByName(loose).select("ref_id", "owner", "source")
