"""Documents and files: reading, writing, round trips."""

import json

from pyspark.sql import functions as F

from mediaframe.sources import documents as d

KEYED = lambda v: {"static": v, "keyframes": []}


def project():
    clip = {"id": "c1", "assetId": "a1", "trackId": "t1", "startMs": -0.0, "inMs": 0.0, "outMs": 1000.0, "speed": {"preset": "normal", "points": [{"t": 0, "speed": 1}], "opticalFlow": True},
            "transform": {"position": KEYED([0.0, 0.0]), "scale": {"static": 1.0, "keyframes": [{"timeMs": 10.0, "value": 2.0, "easing": "easeIn"}]}, "rotation": KEYED(0.0), "opacity": KEYED(1.0), "blur": KEYED(0.0)},
            "audio": {"gainDb": 0.0, "normalize": True, "muted": False, "voice": "original"}, "mask": None, "blendMode": "odd", "freezeFrame": None, "reversed": False, "reframe": None, "linkId": "l1"}
    return {"version": 1, "id": "p1", "name": "P", "fps": 24.0, "width": 1280, "height": 720, "assets": [{"id": "a1", "path": "C:/a.mp4", "name": "a.mp4", "kind": "video", "durationMs": 5000.0, "hasAudio": True}],
            "tracks": [{"id": "t1", "kind": "video", "name": "Video 1", "locked": False, "muted": False, "clips": [clip]}, {"id": "t2", "kind": "audio", "name": "Audio 1", "locked": False, "muted": False, "clips": []}],
            "beatMarkers": [{"timeMs": 5.0, "strength": 0.5, "kind": "beat1"}]}


def test_project_round_trip(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(project()))
    t = d.read_projects(spark, str(tmp_path / "p.json"))
    assert t["clips"].first().clip_id == "c1" and t["tracks"].count() == 2 and t["assets"].first().path == "C:/a.mp4"
    k = t["keyframes"].collect()
    assert [(r.property, r.time_ms, r.value, r.easing) for r in k] == [("scale", 10.0, [2.0], "easeIn")]
    d.write_projects(t, str(tmp_path / "out"))
    doc = json.loads(next((tmp_path / "out").glob("part-*")).read_text())
    clip = doc["tracks"][0]["clips"][0]
    assert clip["mask"] is None and clip["freezeFrame"] is None and clip["reframe"] is None and "effect" not in clip
    assert str(clip["startMs"]) == "0.0" and clip["blendMode"] == "odd" and doc["tracks"][1]["clips"] == [] and doc["beatMarkers"][0]["kind"] == "beat1"


def test_full_document_is_the_same_after_a_round_trip(spark, tmp_path):
    hues = {c: {"h": float(i), "s": -1.5, "l": 0.25} for i, c in enumerate(("red", "orange", "yellow", "green", "cyan", "blue", "purple", "magenta"))}
    line = [[0.0, 0.0], [0.4, 0.5], [1.0, 1.0]]
    color = {k: float(i) for i, k in enumerate("exposure brilliance contrast brightness highlights shadows saturation vibrance sharpness temperature tint".split())}
    color |= {"lift": [0.0, 0.0, 0.1], "gamma": [0.0, 0.2, 0.0], "gain": [0.3, 0.0, 0.0], "offset": [0.0, 0.0, 0.0], "hsl": hues, "curves": {c: line for c in ("master", "r", "g", "b")},
              "lutAssetId": None, "lutIntensity": 0.75, "vignette": 3.0, "grain": 1.0}
    doc = project()
    full = doc["tracks"][0]["clips"][0]
    full["startMs"] = 0.0
    full |= {"color": color, "mask": {"shape": "circle", "feather": 0.37, "rect": KEYED([0.22, 0.31, 0.45, 0.27]), "inverted": False}, "label": "L", "freezeFrame": {"atMs": 730.0, "holdMs": 410.0},
             "reframe": {"sourceWidth": 1408, "sourceHeight": 792, "keyframes": [{"frame": 0, "timeMs": 0.0, "crop": [346.0, 58.0, 1270.0, 577.0], "zoom": 2.08, "tx": 0.31, "ty": -0.17}], "reason": "subject left of the middle"},
             "transitionIn": {"type": "dissolve", "durationMs": 300.0}, "effect": {"type": "shake", "intensity": 0.5, "params": {"speed": 2.0}}}
    full["audio"] |= {"keepPitch": False, "fadeInMs": 5.0, "volume": {"static": 0.0, "keyframes": [{"timeMs": 1.0, "value": -3.0, "easing": "bezier", "bezier": [0.2, 0.0, 0.8, 1.0]}]}}
    doc["tracks"][1]["clips"] = [full | {"id": "c2", "trackId": "t2", "mask": None, "reframe": None, "freezeFrame": None, "color": color | {"lutAssetId": "lut1"}}]
    doc |= {"universalAdjust": {"enabled": True, "name": "U", "values": {"contrast": 5.0, "hsl": hues}}, "frameInterpolation": "none"}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    d.write_projects(d.read_projects(spark, str(tmp_path / "p.json")), str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out").glob("part-*")).read_text()) == doc


def test_cube(spark, tmp_path):
    rows = [f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    (tmp_path / "a.cube").write_text('﻿# c\nTITLE "x"\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\n' + "\n".join(rows))
    (tmp_path / "b.cube").write_text("LUT_3D_SIZE 2\n0 0 0\n")
    (tmp_path / "c.cube").write_text("LUT_1D_SIZE 2\n0 0 0\n")
    lattice, errors = d.read_cube_luts(spark, str(tmp_path))
    got = lattice.collect()
    assert len(got) == 8 and all((r.ir, r.ig, r.ib) == (r.r, r.g, r.b) for r in got)
    assert sorted(r.error for r in errors.collect()) == ["1D LUTs are not supported", "wrong number of rows"]


def test_manifest_and_texts(spark, tmp_path):
    m = {"characters": [{"id": "bunny", "species": "rabbit", "aliases": ["hare"], "features": "long ears", "notLike": "an old rabbit", "references": [{"image": "s.webp"}]}], "negatives": ["a cartoon deer", {"image": "x.webp"}]}
    (tmp_path / "m.json").write_text(json.dumps(m))
    t = d.read_manifest(spark, str(tmp_path / "m.json"))
    texts = {(r.owner, r.text) for r in d.zero_shot_texts(t["characters"], t["negatives"]).collect()}
    assert texts == {("bunny", "a cartoon rabbit character"), ("bunny", "a cartoon hare character"), ("bunny", "a cartoon rabbit character: long ears"), ("-", "a cartoon deer"), ("-", "an old rabbit")}
    assert t["references"].first().image == "s.webp" and t["prompts"].first().prompt == "animal character"


def test_analysis(spark, tmp_path):
    doc = {"version": 1, "clips": [{"path": "a.mp4", "asset": {"id": "a"}, "shots": [{"index": 0, "startFrame": 0, "endFrame": 9, "cast": ["x"]}], "duplicates": [], "reframe": [], "audio": {"integratedLufs": -20.0, "beats": [1.0]}, "transitions": [{"fromShot": 0, "toShot": 1, "suggestion": "dissolve"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    t = d.read_analysis(spark, str(tmp_path / "r.json"))
    assert t["shots"].first().endFrame == 9 and t["audio"].first().integratedLufs == -20.0 and t["transitions"].first().suggestion == "dissolve"


def test_media_scan_and_small_stores(spark, tmp_path):
    for n in ("a.MP4", ".b.mp4", "~$c.mp4", "d.txt", "e.wav"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.mkv").write_bytes(b"xy")
    names = lambda **k: sorted(r.name for r in d.scan_media(spark, str(tmp_path), **k).collect())
    assert names() == ["a.MP4"] and names(recursive=True, kinds=("video", "audio")) == ["a.MP4", "e.wav", "f.mkv"]
    presets = d.read_adjust_presets(spark, str(tmp_path / "adjust"), {"contrast": 5.0})
    assert presets.first()["values"]["contrast"] == 5.0 and presets.first()["values"]["exposure"] is None
    assert d.read_adjust_presets(spark, str(tmp_path / "adjust"), {"contrast": 9.0}).first()["values"]["contrast"] == 5.0
    refs = spark.createDataFrame([(1, "bunny", [1.0])], "ref_id bigint, owner string, embedding array<float>")
    d.save_bank(refs, str(tmp_path / "bank"), "k1", 0.7, 0.06)
    assert d.load_bank(spark, str(tmp_path / "bank"), "k1").count() == 1 and d.load_bank(spark, str(tmp_path / "bank"), "k2").count() == 0
    d.write_shot_list(refs.drop("embedding"), str(tmp_path / "list"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "list")).first().owner == "bunny"


def test_event_lines(spark, tmp_path):
    from mediaframe.streaming.streams import drain, read_event_stream

    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text('{"event":"progress","stage":"shots","pct":1.5,"message":"m"}\nplain text\n{"event":"result","path":"x"}\n')
    rows = {r.event: r for r in drain(read_event_stream(spark, str(tmp_path / "log"))).collect()}
    assert rows["progress"].pct == 1.0 and rows["log"].message == "plain text" and rows["log"].level == "info" and rows["result"].path == "x"


def test_tracker_waits_for_the_rest_of_a_frame(spark, tmp_path):
    from mediaframe.operators import tracking
    from mediaframe.streaming.streams import byte_track_stream, drain

    rows = [(1, 7, f, det, "a", 0.9, 100.0 + 5 * f + 400 * det, 100.0, 200.0 + 5 * f + 400 * det, 300.0) for f in range(12) for det in (0, 1)]
    schema = "asset_id bigint, shot bigint, frame bigint, det bigint, label string, score double, x1 double, y1 double, x2 double, y2 double"
    # the second part starts in the middle of frame 5; the last file only ends the shot
    for n, part in enumerate((rows[:11], rows[11:], [(1, 7, 12, None, None, None, None, None, None, None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        files = sorted((p for p in (tmp_path / "in").glob("part-*.parquet")), key=lambda p: p.stat().st_mtime_ns)
        assert len(files) == n + 1
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    options = tracking.TrackerOptions()
    got = sorted(map(tuple, drain(byte_track_stream(stream, options)).collect()))
    want = sorted(map(tuple, tracking.byte_track(spark.createDataFrame(rows, schema), options).select(*tracking.TRACK_SCHEMA.replace(",", " ").split()[::2]).collect()))
    assert got == want and len({r[2] for r in got}) == 12


def _in_turns(spark, tmp_path, parts, schema):
    """A stream that reads one part in a micro-batch."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))


def _left_in_state(spark, stream, tmp_path):
    """Rows of a stream, and how many keys its state holds at the end."""
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    held = spark.read.format("statestore").load(str(tmp_path / "state")).count()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect(), held


def _at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_tracker_ends_a_silent_shot(spark, tmp_path):
    from mediaframe.operators import tracking
    from mediaframe.streaming.streams import byte_track_stream

    schema = "asset_id bigint, shot bigint, frame bigint, det bigint, label string, score double, x1 double, y1 double, x2 double, y2 double, ts timestamp"
    rows = [(1, 7, f, 0, "a", 0.9, 100.0 + 5 * f, 100.0, 200.0 + 5 * f, 300.0, _at(f)) for f in range(8)]
    # another shot goes on long after, and ends with its own row
    later = [(1, 8, 20, 0, "a", 0.9, 100.0, 100.0, 200.0, 300.0, _at(600)), (1, 8, 21, None, None, None, None, None, None, None, _at(600))]
    stream = _in_turns(spark, tmp_path, (rows[:5], rows[5:], later), schema)
    got, held = _left_in_state(spark, byte_track_stream(stream, tracking.TrackerOptions(), ts="ts", delay="10 minutes", idle_ms=3_600_000), tmp_path)
    want = tracking.byte_track(spark.createDataFrame(rows + later[:1], schema), tracking.TrackerOptions()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.frame for r in got if r.shot == 7} == set(range(8))
    assert held == 0


def test_frame_streams_forget_silent_assets(spark, tmp_path):
    from mediaframe.streaming.streams import ordered_frames_stream, resample_stream

    schema = "asset_id bigint, pts_us bigint, value double, ts timestamp"
    parts = ([(1, 0, 0.0, _at(0)), (1, 10, 1.0, _at(1)), (1, 5, 2.0, _at(1))], [(1, 10, 3.0, _at(2)), (1, 20, 4.0, _at(2))], [(2, 0, 5.0, _at(600))], [(2, 30, 6.0, _at(601))])
    got, held = _left_in_state(spark, ordered_frames_stream(_in_turns(spark, tmp_path / "a", parts, schema), "ts", "10 minutes", 3_600_000), tmp_path / "a")
    assert sorted((r.asset_id, r.pts_us, r.value) for r in got) == [(1, 0, 0.0), (1, 5, 2.0), (1, 10, 1.0), (1, 20, 4.0), (2, 0, 5.0), (2, 30, 6.0)]
    assert held == 1
    got, held = _left_in_state(spark, resample_stream(_in_turns(spark, tmp_path / "b", parts, schema), 10, 1, "ts", "10 minutes", 3_600_000), tmp_path / "b")
    assert sorted((r.asset_id, r.k, r.kind) for r in got) == [(1, 0, "copy"), (1, 1, "copy"), (2, 0, "copy"), (2, 1, "interp"), (2, 2, "interp")]
    assert held == 1
