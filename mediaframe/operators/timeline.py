"""Timeline lookups, packing and links over clip tables.

Clips carry project_id, track_index, kind (video / audio / fx), clip_id, asset_id, start_ms, dur_ms, in_ms, out_ms,
link_id (nullable). Track order is track_index; ties are broken by clip_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions import playback as pb
from mediaframe.plans import scan
from mediaframe.plans.joins import bucket_of, range_join
from mediaframe.plans.sequential import Processor, greedy_pairs, sequential

TRACK = ["project_id", "track_index"]
BUCKET_MS = 60_000


def end_ms() -> Column:
    return F.col("start_ms") + F.col("dur_ms")


def _chunk() -> Column:
    return bucket_of(F.col("start_ms"), BUCKET_MS)


def _order() -> list[Column]:
    return [F.col("start_ms"), F.col("clip_id")]


# --------------------------------------------------------------------------- neighbours, cuts, transitions


def adjacent_clips(clips: DataFrame, frame_ms: float) -> DataFrame:
    """Previous and next neighbour of every clip on its track: a gap or overlap under one frame, closest
    first. Previous ends where the clip starts and starts earlier; next starts where it ends and starts later."""
    c = clips.select(*TRACK, "clip_id", "start_ms", end_ms().alias("end_ms"))
    other = c.select(*TRACK, F.col("clip_id").alias("o_id"), F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"))

    def best(points: DataFrame, at: str, edge: str, later: Column, name: str) -> DataFrame:
        spans = other.withColumn("lo", F.col(edge) - frame_ms).withColumn("hi", F.col(edge) + frame_ms)
        hit = range_join(points, spans, TRACK, at, "lo", "hi", BUCKET_MS, open_start=True).filter(later)
        gap = F.abs(F.col(edge) - F.col(at))
        return hit.groupBy("project_id", "clip_id").agg(F.min(F.struct(gap.alias("gap"), F.col("o_id").alias("id"))).alias("m")).select(
            "project_id", "clip_id", F.col("m.id").alias(name))

    prev = best(c, "start_ms", "o_end", F.col("o_start") < F.col("start_ms"), "prev_id")
    nxt = best(c, "end_ms", "o_start", F.col("o_start") > F.col("start_ms"), "next_id")
    return clips.join(prev, ["project_id", "clip_id"], "left").join(nxt, ["project_id", "clip_id"], "left")


def previous_clips(clips: DataFrame, frame_ms: float) -> DataFrame:
    """Cuts: clips with the clip that directly precedes them (prev_id, prev_dur_ms)."""
    c = clips.select(*TRACK, "clip_id", "start_ms")
    spans = clips.select(*TRACK, F.col("clip_id").alias("o_id"), F.col("start_ms").alias("o_start"), F.col("dur_ms").alias("o_dur"), end_ms().alias("o_end")).withColumn(
        "lo", F.col("o_end") - frame_ms).withColumn("hi", F.col("o_end") + frame_ms)
    hit = range_join(c, spans, TRACK, "start_ms", "lo", "hi", BUCKET_MS, open_start=True).filter(F.col("o_start") < F.col("start_ms"))
    m = hit.groupBy("project_id", "clip_id").agg(F.min(F.struct(F.abs(F.col("o_end") - F.col("start_ms")).alias("gap"), F.col("o_id").alias("id"), F.col("o_dur").alias("dur"))).alias("m"))
    return m.select("project_id", "clip_id", F.col("m.id").alias("prev_id"), F.col("m.dur").alias("prev_dur_ms"))


def find_transitions(clips: DataFrame, frame_ms: float, known: list[str]) -> DataFrame:
    """Transitions into clips (transition_type, transition_ms set) on video tracks with their clamped length.
    Without a preceding clip, or with an unknown type, ``warning`` says what happens instead."""
    video = clips.filter((F.col("kind") == "video") & ~F.col("track_muted"))
    wanted = video.filter(F.col("transition_type").isNotNull())
    j = wanted.join(previous_clips(video, frame_ms), ["project_id", "clip_id"], "left")
    has = F.col("prev_id").isNotNull()
    return j.select(
        "project_id", "track_index", "clip_id", "prev_id", F.col("start_ms").alias("cut_ms"),
        F.when(F.col("transition_type").isin(*known), F.col("transition_type")).otherwise("dissolve").alias("type"),
        F.when(has, pb.clamp_transition(F.col("transition_ms"), F.col("prev_dur_ms"), F.col("dur_ms"))).alias("dur_ms"),
        F.when(~has, "ignored: no clip ends where it starts").when(~F.col("transition_type").isin(*known), "unknown type, rendered as a dissolve").alias("warning"))


def transition_at(transitions: DataFrame, times: DataFrame) -> DataFrame:
    """Transition windows [cut - d/2, cut + d/2) over times (project_id, t): raw and eased progress."""
    spans = transitions.filter(F.col("dur_ms") > 0).withColumn("from_ms", F.col("cut_ms") - F.col("dur_ms") / 2).withColumn("to_ms", F.col("cut_ms") + F.col("dur_ms") / 2)
    hit = range_join(times, spans, ["project_id"], "t", "from_ms", "to_ms", BUCKET_MS)
    raw = (F.col("t") - F.col("from_ms")) / F.col("dur_ms")
    return hit.withColumn("raw", raw).withColumn("progress", pb.transition_progress(F.col("raw")))


# --------------------------------------------------------------------------- what is where


def clips_at(clips: DataFrame, times: DataFrame, kind: str = "video", include_muted: bool = False) -> DataFrame:
    """Clips under each time: start <= t < end on tracks of one kind, muted tracks skipped."""
    c = clips.filter(F.col("kind") == kind) if include_muted else clips.filter((F.col("kind") == kind) & ~F.col("track_muted"))
    return range_join(times, c.withColumn("end_ms", end_ms()), ["project_id"], "t", "start_ms", "end_ms", BUCKET_MS)


def top_clip_at(clips: DataFrame, times: DataFrame) -> DataFrame:
    """The clip drawn on top: the last track wins, then the last clip."""
    hit = clips_at(clips, times)
    return hit.groupBy(*times.columns).agg(F.max(F.struct("track_index", "clip_id")).alias("m")).select(*times.columns, F.col("m.track_index").alias("track_index"), F.col("m.clip_id").alias("clip_id"))


def active_effects(clips: DataFrame, times: DataFrame) -> DataFrame:
    """Effect clips under each time with the effect-local time; ``track_index`` is the stacking order."""
    hit = clips_at(clips, times, "fx")
    return hit.withColumn("local_ms", F.col("t") - F.col("start_ms"))


def video_times(times: DataFrame, snaps: DataFrame) -> DataFrame:
    """Picture time: inside a snap the picture holds the earliest active snap's start. Starts of active
    snaps only rise as time goes on, so the result never goes back. snaps: project_id, start_ms, dur_ms."""
    held = range_join(times, snaps.withColumn("end_ms", end_ms()), ["project_id"], "t", "start_ms", "end_ms", BUCKET_MS)
    low = held.groupBy(*times.columns).agg(F.min("start_ms").alias("hold_ms"))
    return times.join(low, times.columns, "left").withColumn("video_ms", F.coalesce(F.col("hold_ms"), F.col("t"))).drop("hold_ms")


def span_is_free(spans: DataFrame, clips: DataFrame, eps: float = 0.001) -> DataFrame:
    """Spans (project_id, track_index, span_id, start_ms, end_ms) that no clip of the track overlaps.

    Two intervals overlap when one starts inside the other, so two point-in-interval anti joins decide it."""
    c = clips.select(*TRACK, F.col("start_ms").alias("c_start"), end_ms().alias("c_end"))
    inner = c.withColumn("lo", F.col("c_start")).withColumn("hi", F.col("c_end") - eps)
    free = range_join(spans, inner, TRACK, "start_ms", "lo", "hi", BUCKET_MS, how="left_anti")
    own = free.select(*TRACK, "span_id", (F.col("start_ms") + eps).alias("lo"), (F.col("end_ms") - eps).alias("hi"))
    taken = range_join(c, own, TRACK, "c_start", "lo", "hi", BUCKET_MS).select("span_id").distinct()
    return free.join(taken, "span_id", "left_anti")


def project_duration(clips: DataFrame) -> DataFrame:
    return clips.groupBy("project_id").agg(F.max(end_ms()).alias("duration_ms"))


def cut_point_times(clips: DataFrame) -> DataFrame:
    """0 and every distinct rounded start and end."""
    return clips.select("project_id", F.explode(F.array(F.lit(0).cast("bigint"), F.round("start_ms").cast("bigint"), F.round(end_ms()).cast("bigint"))).alias("t")).distinct()


# --------------------------------------------------------------------------- packing


def compact_track(clips: DataFrame) -> DataFrame:
    """Gapless from 0 in start order."""
    return scan.ordered_scan(clips, TRACK, _order(), _chunk(), new_start=scan.prefix_sum(F.col("dur_ms")))


def resolve_overlaps(clips: DataFrame) -> DataFrame:
    """Push overlapping clips right, keeping the start order. With P the durations before a clip, the new
    start is P + max(0, running max of start - P): two scans instead of a loop."""
    p = scan.ordered_scan(clips, TRACK, _order(), _chunk(), _before=scan.prefix_sum(F.col("dur_ms")))
    q = scan.ordered_scan(p, TRACK, _order(), _chunk(), _push=scan.running_max(F.col("start_ms") - F.col("_before")))
    return q.withColumn("new_start", F.col("_before") + F.greatest(F.lit(0), F.col("_push"))).drop("_before", "_push")


class _Packer(Processor):
    """Start-ordered packing where pinned clips stay and others move right; state is one cursor."""

    def start(self, key):
        self.key, self.cursor = key, 0

    def feed(self, cols):
        out = []
        for s, d, pinned in zip(cols["start_ms"], cols["dur_ms"], cols["pinned"]):
            at = s if pinned else max(s, self.cursor)
            self.cursor = max(self.cursor, at + d) if pinned else at + d
            out.append(at)
        n = len(out)
        return {"project_id": [self.key[0]] * n, "track_index": [self.key[1]] * n, "clip_id": cols["clip_id"], "new_start": out}


def resolve_overlaps_pinned(clips: DataFrame) -> DataFrame:
    """:func:`resolve_overlaps` with a boolean ``pinned``; one cursor per track streams over the clips."""
    rows = clips.select(*TRACK, "clip_id", "start_ms", "dur_ms", "pinned")
    return sequential(rows, TRACK, ["start_ms", "clip_id"], "project_id bigint, track_index bigint, clip_id bigint, new_start bigint", _Packer)


def ripple(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Shift clips starting at or after ``from_ms`` by ``delta_ms``, never before 0, except the edited clip.

    edits: project_id, track_index, from_ms, delta_ms, except_id; one per track."""
    j = clips.join(edits, TRACK, "left")
    move = (F.col("start_ms") >= F.col("from_ms") - 0.001) & (F.col("clip_id") != F.col("except_id"))
    return j.withColumn("new_start", F.when(F.coalesce(move, F.lit(False)), F.greatest(F.lit(0), F.col("start_ms") + F.col("delta_ms"))).otherwise(F.col("start_ms"))).drop("from_ms", "delta_ms", "except_id")


# --------------------------------------------------------------------------- sound


def audible_clips(clips: DataFrame, assets: DataFrame) -> DataFrame:
    """Clips in the mix: live track and clip, an asset with sound; a video-track clip gives way to any
    audio-track clip of the same asset that starts within a millisecond. assets: asset_id, has_sound."""
    a = clips.join(assets.filter("has_sound").select("asset_id"), "asset_id", "left_semi")
    live = a.filter(~F.col("track_muted") & ~F.col("muted") & (F.col("dur_ms") > 0) & F.col("kind").isin("video", "audio"))
    mirrors = clips.filter(F.col("kind") == "audio").select("project_id", "asset_id", (F.col("start_ms") - 1).alias("lo"), (F.col("start_ms") + 1).alias("hi"))
    video = range_join(live.filter(F.col("kind") == "video"), mirrors, ["project_id", "asset_id"], "start_ms", "lo", "hi", BUCKET_MS, how="left_anti", open_start=True)
    return live.filter(F.col("kind") == "audio").unionByName(video)


def audio_schedule(audible: DataFrame, start_ms: float, end_ms_: float, rate: int = 48_000) -> DataFrame:
    """Output samples [i0, i1) of every audible clip inside an export range and the source it reads (20 ms
    margin), for clips at normal speed."""
    spm = rate / 1000.0
    c0, c1 = F.greatest(F.col("start_ms"), F.lit(start_ms)), F.least(end_ms(), F.lit(end_ms_))
    i0 = F.greatest(F.lit(0), F.ceil((c0 - start_ms) * spm)).cast("bigint")
    i1 = F.least(F.ceil((c1 - start_ms) * spm).cast("bigint"), F.lit(int((end_ms_ - start_ms) * spm)).cast("bigint"))
    s = audible.filter(c1 > c0).withColumn("i0", i0).withColumn("i1", i1).filter(F.col("i1") > F.col("i0"))
    at = lambda i: F.least(F.greatest(F.lit(start_ms) + i / spm - F.col("start_ms"), F.lit(0.0)), F.col("dur_ms"))
    return s.withColumn("w0", F.greatest(F.col("in_ms") + at(F.col("i0")) - 20, F.col("in_ms"))).withColumn("w1", F.least(F.col("in_ms") + at(F.col("i1")) + 20, F.col("out_ms")))


def sound_events(clips: DataFrame, start_ms: float, end_ms_: float, rate: int = 48_000) -> DataFrame:
    """Shutter sounds of camera-snap effects: sample index and linear gain (-6 dB x intensity)."""
    c = clips.filter((F.col("kind") == "fx") & ~F.col("track_muted") & (F.col("effect") == "cameraSnap") & (F.col("dur_ms") > 0)
                     & (F.col("start_ms") + 120 > start_ms) & (F.col("start_ms") < end_ms_))
    gain = 10.0 ** (-6.0 / 20.0)
    return c.select("project_id", "clip_id", F.round((F.col("start_ms") - start_ms) * (rate / 1000.0)).cast("bigint").alias("at"),
                    (F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("intensity"))) * gain).alias("gain"))


def mix_samples(schedule: DataFrame, pcm: DataFrame, per_clip_gain: Column) -> DataFrame:
    """Sum of all clips per output sample, at 1x: sample i of a clip reads pcm sample src0 + i - i0.

    schedule: project_id, clip_id, asset_id, i0, i1, src0 (source sample at i0) and what the gain reads;
    pcm: asset_id, i, value. The clip side is copied per pcm block, the sum is pre-aggregated per task."""
    s = schedule.withColumn("s_end", F.col("src0") + F.col("i1") - F.col("i0"))
    hit = range_join(pcm.withColumnRenamed("i", "src"), s, ["asset_id"], "src", "src0", "s_end", 480_000)
    out = hit.withColumn("sample", F.col("i0") + F.col("src") - F.col("src0"))
    return out.groupBy("project_id", "sample").agg(F.sum(F.col("value") * per_clip_gain).alias("mix"))


# --------------------------------------------------------------------------- links


def mirror_of(clips: DataFrame) -> DataFrame:
    """The linked partner of the other kind that plays the same asset; without a link, the unlinked clip of
    the same asset that starts within a millisecond. Adds mirror_id (first by track)."""
    av = clips.filter(F.col("kind").isin("video", "audio"))
    other = lambda c: F.when(c == "video", "audio").otherwise("video")
    o = av.select("project_id", F.col("kind").alias("o_kind"), "asset_id", "link_id", "start_ms", F.struct("track_index", "clip_id").alias("o"))
    mine = av.withColumn("o_kind", other(F.col("kind")))
    linked = mine.filter(F.col("link_id").isNotNull()).join(o.drop("start_ms"), ["project_id", "o_kind", "asset_id", "link_id"])
    loose_spans = o.filter(F.col("link_id").isNull()).select("project_id", "o_kind", "asset_id", "o", (F.col("start_ms") - 1).alias("lo"), (F.col("start_ms") + 1).alias("hi"))
    loose = range_join(mine.filter(F.col("link_id").isNull()), loose_spans, ["project_id", "o_kind", "asset_id"], "start_ms", "lo", "hi", BUCKET_MS, open_start=True)
    pick = linked.select("project_id", "clip_id", "o").unionByName(loose.select("project_id", "clip_id", "o")).groupBy("project_id", "clip_id").agg(F.min("o").alias("m"))
    return av.join(pick.select("project_id", "clip_id", F.col("m.clip_id").alias("mirror_id")), ["project_id", "clip_id"], "left")


def infer_links(clips: DataFrame) -> DataFrame:
    """Pair unlinked video and audio clips of one asset whose start, in and out agree within a millisecond:
    each video clip in track order takes the first free audio clip. Returns project_id, video_id, audio_id."""
    free = clips.filter(F.col("link_id").isNull())
    cols = ["project_id", "asset_id", "track_index", "clip_id", "start_ms", "in_ms", "out_ms"]
    v = free.filter(F.col("kind") == "video").select(*cols)
    a = free.filter(F.col("kind") == "audio").select("project_id", "asset_id", *[F.col(c).alias(f"a_{c}") for c in cols[2:]],
                                                    (F.col("start_ms") - 1).alias("lo"), (F.col("start_ms") + 1).alias("hi"))
    near = range_join(v, a, ["project_id", "asset_id"], "start_ms", "lo", "hi", BUCKET_MS, open_start=True).filter(
        (F.abs(F.col("a_in_ms") - F.col("in_ms")) < 1) & (F.abs(F.col("a_out_ms") - F.col("out_ms")) < 1))
    cand = near.select("project_id", "asset_id", "track_index", F.col("clip_id").alias("video_id"), "a_track_index", F.col("a_clip_id").alias("audio_id"))
    return greedy_pairs(cand, ["project_id", "asset_id"], ["track_index", "video_id", "a_track_index", "audio_id"], "video_id", "audio_id").drop("asset_id")


def with_partners(clips: DataFrame, chosen: DataFrame, unlocked_only: bool = False) -> DataFrame:
    """The chosen clips (project_id, clip_id) and everything linked to them."""
    live = clips.filter(~F.col("locked")) if unlocked_only else clips
    own = live.join(chosen, ["project_id", "clip_id"], "left_semi")
    links = own.filter(F.col("link_id").isNotNull()).select("project_id", "link_id").distinct()
    return own.select("project_id", "clip_id").union(live.join(links, ["project_id", "link_id"], "left_semi").select("project_id", "clip_id")).distinct()


def link_groups(clips: DataFrame) -> DataFrame:
    """Members per link: count, first and last member in track order."""
    m = F.struct("track_index", "clip_id")
    return clips.filter(F.col("link_id").isNotNull()).groupBy("project_id", "link_id").agg(
        F.count("*").alias("members"), F.min(m)["clip_id"].alias("first_id"), F.max(m)["clip_id"].alias("last_id"))


def sync_links(clips: DataFrame) -> DataFrame:
    """Copy the timing of each link group's first video member (lowest track) onto its non-video members."""
    timing = ["start_ms", "in_ms", "out_ms", "dur_ms"]
    lead = clips.filter((F.col("kind") == "video") & F.col("link_id").isNotNull()).groupBy("project_id", "link_id").agg(
        F.min(F.struct("track_index", "clip_id", *timing)).alias("_lead"))
    j = clips.join(lead, ["project_id", "link_id"], "left")
    follow = (F.col("kind") != "video") & F.col("_lead").isNotNull()
    return j.select(*[F.when(follow, F.col(f"_lead.{c}")).otherwise(F.col(c)).alias(c) if c in timing else F.col(c) for c in clips.columns])


def settle(clips: DataFrame, magnet: bool, main_track: int = 0) -> DataFrame:
    """Pack the main track (gapless with the magnet, pushed right without), copy link timing, then push
    overlaps apart on the other tracks without moving clips linked to a video clip. Locked tracks stay."""
    main = (F.col("track_index") == main_track) & ~F.col("locked")
    head = clips.filter(main)
    packed = (compact_track if magnet else resolve_overlaps)(head)
    packed = packed.withColumn("start_ms", F.col("new_start")).drop("new_start")
    synced = sync_links(packed.unionByName(clips.filter(~main)))
    others = synced.filter((F.col("track_index") != main_track) & ~F.col("locked"))
    led = synced.filter((F.col("kind") == "video") & F.col("link_id").isNotNull()).select("project_id", "link_id").distinct().withColumn("_led", F.lit(True))
    pinned = others.join(led, ["project_id", "link_id"], "left").withColumn("pinned", F.coalesce("_led", F.lit(False)) & (F.col("kind") != "video"))
    moved = resolve_overlaps_pinned(pinned)
    out = others.join(moved, [*TRACK, "clip_id"]).withColumn("start_ms", F.col("new_start")).drop("new_start")
    rest = synced.filter((F.col("track_index") == main_track) | F.col("locked"))
    return rest.unionByName(out.select(*rest.columns))


# --------------------------------------------------------------------------- assets and documents


def assets_needing_stems(clips: DataFrame, assets: DataFrame) -> DataFrame:
    """Used assets with sound and no stems, one per normalised path (lowest asset id)."""
    used = assets.join(clips.select("asset_id").distinct(), "asset_id", "left_semi").filter(F.col("has_sound") & ~F.col("has_stems"))
    return used.groupBy("path_key").agg(F.min("asset_id").alias("asset_id"))


def with_stems(assets: DataFrame, stems: DataFrame) -> DataFrame:
    """Attach stem paths by normalised path."""
    s = stems.select("path_key", F.col("vocals").alias("_v"), F.col("background").alias("_b"))
    return assets.join(s, "path_key", "left").withColumn("vocals", F.coalesce("_v", "vocals")).withColumn("background", F.coalesce("_b", "background")).drop("_v", "_b")


def merge_assets(current: DataFrame, incoming: DataFrame, keep: tuple[str, ...] = ("order", "tags", "stems")) -> DataFrame:
    """Union by path_key: incoming fields win, ``keep`` fields survive when the incoming ones are missing."""
    values = [c for c in current.columns if c != "path_key"]
    cur = current.select("path_key", F.lit(True).alias("_cur"), *[F.col(c).alias(f"c_{c}") for c in values])
    inc = incoming.select("path_key", F.lit(True).alias("_inc"), *[F.col(c).alias(f"i_{c}") for c in values])
    j = cur.join(inc, "path_key", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"i_{c}"), F.col(f"c_{c}")) if c in keep else F.when(F.col("_inc").isNotNull(), F.col(f"i_{c}")).otherwise(F.col(f"c_{c}"))
    return j.select("path_key", *[pick(c).alias(c) for c in values])


def asset_usage(assets: DataFrame, clips: DataFrame) -> DataFrame:
    uses = clips.groupBy("asset_id").agg(F.count("*").alias("uses"))
    return assets.select("asset_id").join(uses, "asset_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def resolve_assets(clips: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with their asset columns, clips that name an unknown asset)."""
    return clips.join(assets, "asset_id"), clips.join(assets.select("asset_id"), "asset_id", "left_anti")


def media_paths(assets: DataFrame) -> DataFrame:
    """Every distinct file a project refers to: assets and stems."""
    return assets.select(F.explode(F.array("path", "vocals", "background")).alias("path")).filter(F.col("path").isNotNull() & (F.col("path") != "")).distinct()


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between two versions of a table: added, removed or changed, nulls compared as values."""
    values = [c for c in before.columns if c not in keys]
    b = before.select(*keys, F.struct(*values).alias("_b"))
    a = after.select(*keys, F.struct(*values).alias("_a"))
    j = b.join(a, keys, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return j.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def locate_findings(findings: DataFrame, clips: DataFrame) -> DataFrame:
    """Where a finding (finding_id, project_id, asset_id, source_ms) shows on the timeline: the first video
    clip, in track order, whose source range contains it (both ends included)."""
    v = clips.filter(F.col("kind") == "video").select("project_id", "asset_id", "track_index", "clip_id", "start_ms", "in_ms", "out_ms")
    hit = range_join(findings, v, ["project_id", "asset_id"], "source_ms", "in_ms", "out_ms", BUCKET_MS, closed_end=True)
    m = hit.groupBy("finding_id").agg(F.min(F.struct("track_index", "start_ms", "clip_id", (F.col("start_ms") + F.col("source_ms") - F.col("in_ms")).alias("t"))).alias("m"))
    return m.select("finding_id", F.col("m.clip_id").alias("clip_id"), F.col("m.t").alias("timeline_ms"))


# --------------------------------------------------------------------------- render plan


def frame_plan(clips: DataFrame, fps: float, snaps: DataFrame | None = None, start_ms: float = 0.0) -> DataFrame:
    """One row per (output frame, layer) of the visible video clips.

    Frames are generated from the clip spans themselves, so empty stretches cost nothing. Frames inside a
    camera snap show the picture at the snap's start instead. Clips need factor, freeze_at, freeze_hold, reversed,
    fade_in_ms, fade_out_ms; dur_ms must be the clip's timeline length."""
    video = clips.filter((F.col("kind") == "video") & ~F.col("track_muted") & (F.col("out_ms") > F.col("in_ms")))
    eps = 1e-6
    frame_of = lambda ms: F.greatest(F.lit(0), F.ceil((ms - start_ms) * fps / 1000.0 - eps)).cast("bigint")
    span = lambda df: df.withColumn("_f0", frame_of(F.col("start_ms"))).withColumn("_f1", frame_of(end_ms())).filter(F.col("_f1") > F.col("_f0")).withColumn(
        "frame", F.explode(F.sequence(F.col("_f0"), F.col("_f1") - 1))).withColumn("t", F.lit(start_ms) + F.col("frame") * (1000.0 / fps)).drop("_f0", "_f1")
    direct = span(video).withColumn("video_ms", F.col("t"))
    if snaps is not None:
        cover = snaps.select("project_id", F.col("start_ms").alias("h_start"), end_ms().alias("h_end"))
        direct = range_join(direct, cover, ["project_id"], "t", "h_start", "h_end", BUCKET_MS, how="left_anti")
        held_frames = span(snaps.select("project_id", "start_ms", "dur_ms")).select("project_id", "frame", "t").distinct()
        held = range_join(held_frames, cover, ["project_id"], "t", "h_start", "h_end", BUCKET_MS).groupBy("project_id", "frame", "t").agg(
            F.min("h_start").cast("double").alias("video_ms"))
        shown = range_join(held, video.withColumn("_end", end_ms()), ["project_id"], "video_ms", "start_ms", "_end", BUCKET_MS).drop("_end")
        direct = direct.unionByName(shown.select(*direct.columns))
    m = pb.source_at(F.col("video_ms") - F.col("start_ms"), F.col("in_ms"), F.col("out_ms"), F.col("factor"), F.col("freeze_at"), F.col("freeze_hold"), F.col("reversed"))
    out = direct.withColumn("_m", m)
    return out.select("project_id", "frame", "track_index", "clip_id", "asset_id", "video_ms", F.col("_m.local_ms").alias("local_ms"), F.col("_m.source_ms").alias("source_ms"),
                      F.col("_m.rate").alias("rate"), F.col("_m.frozen").alias("frozen"),
                      pb.video_fade(F.col("_m.local_ms"), F.col("dur_ms"), F.col("fade_in_ms"), F.col("fade_out_ms")).alias("fade"))


def min_rate(plan: DataFrame) -> DataFrame:
    """Slowest moving rate per clip (1 when it never moves)."""
    return plan.groupBy("project_id", "clip_id").agg(F.coalesce(F.min(F.when(~F.col("frozen") & (F.col("rate") > 0), F.col("rate"))), F.lit(1.0)).alias("min_rate"))


def analysis_summary(shots: DataFrame, duplicates: DataFrame, transitions: DataFrame, audio: DataFrame, assets: DataFrame) -> DataFrame:
    """Per project: shots, duplicates, suggested dissolves, mean loudness and media length."""
    by = "project_id"
    parts = [shots.groupBy(by).agg(F.count("*").alias("shots")), duplicates.groupBy(by).agg(F.count("*").alias("duplicates")),
             transitions.groupBy(by).agg(F.count_if(F.col("suggestion") == "dissolve").alias("dissolves")),
             audio.groupBy(by).agg(F.avg("lufs").alias("mean_lufs")), ]
    out = assets.groupBy(by).agg(F.sum("duration_ms").alias("media_ms"))
    for p in parts:
        out = out.join(p, by, "left")
    return out.fillna(0, ["shots", "duplicates", "dissolves"])
