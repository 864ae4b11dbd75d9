"""Projects, analyses, manifests, probes, presets and 3D tables, read into flat tables and written back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe import schemas
from mediaframe.functions.text import basename, new_id, norm_path

# fixed lists of file endings
EXTENSIONS = {
    "video": ("mp4", "mov", "mkv", "webm", "avi", "m4v", "mpg", "mpeg", "wmv", "ts", "mts"), "audio": ("mp3", "wav", "aac", "flac", "m4a", "ogg", "opus"),
    "image": ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"), "lut": ("cube",)}
STILL_CODECS = ("png", "mjpeg", "bmp", "webp", "tiff", "gif")


def scan_media(spark: SparkSession, path: str, recursive: bool = False, kinds: tuple[str, ...] = ("video",)) -> DataFrame:
    """path, name, kind, size, modified of media files; hidden and temporary names are skipped. The content
    column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext, name = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)), basename(F.col("path"))
    kind = F.lit(None).cast("string")
    for k in kinds:
        kind = F.when(ext.isin(*EXTENSIONS[k]), k).otherwise(kind)
    out = files.select("path", name.alias("name"), kind.alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.filter(F.col("kind").isNotNull() & ~F.col("name").startswith(".") & ~F.col("name").startswith("~$"))


def _rate(text: Column) -> Column:
    num, den = F.split(text, "/")[0].try_cast("double"), F.coalesce(F.get(F.split(text, "/"), 1).try_cast("double"), F.lit(1.0))
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def normalize_probe(df: DataFrame, json_col: str = "probe") -> DataFrame:
    """Probe documents (path, json) to assets: the first real video stream, its average (else nominal) rate,
    the still-image rule, and swapped size for quarter turns."""
    p = df.withColumn("_p", F.from_json(json_col, schemas.PROBE))
    streams = F.coalesce(F.col("_p.streams"), F.array().cast(p.schema["_p"].dataType["streams"].dataType))
    cover = lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 1
    p = p.withColumn("_v", F.try_element_at(F.filter(streams, lambda s: (s["codec_type"] == "video") & ~cover(s)), F.lit(1))).withColumn(
        "_a", F.try_element_at(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(1)))
    v, a = F.col("_v"), F.col("_a")
    dur = F.coalesce(v["duration"].try_cast("double"), F.col("_p.format.duration").try_cast("double"), a["duration"].try_cast("double"), F.lit(0.0))
    still = (v["codec_name"].isin(*STILL_CODECS) & ((F.coalesce(v["nb_frames"].try_cast("int"), F.lit(1)) <= 1) | (dur <= 0.05))) | F.coalesce(F.col("_p.format.format_name"), F.lit("")).rlike("^(image2|png_pipe)")
    kind = F.when(v.isNotNull(), F.when(F.coalesce(still, F.lit(False)), "image").otherwise("video")).when(a.isNotNull(), "audio").otherwise("video")
    fps = F.when(_rate(v["avg_frame_rate"]) > 0, _rate(v["avg_frame_rate"])).otherwise(_rate(v["r_frame_rate"]))
    turn = F.abs(F.coalesce(F.get(v["side_data_list"], 0)["rotation"], F.lit(0.0))) % 180 == 90
    w, h = F.coalesce(v["width"], F.lit(0)), F.coalesce(v["height"], F.lit(0))
    path = norm_path(F.col("path"))
    return p.select(new_id("ast", path).alias("id"), F.translate("path", "\\", "/").alias("path"), basename(F.col("path")).alias("name"), kind.alias("kind"), F.bround(dur * 1000, 3).alias("durationMs"),
                    F.when(turn, h).otherwise(w).alias("width"), F.when(turn, w).otherwise(h).alias("height"), F.when(kind == "image", 0.0).otherwise(F.bround(F.coalesce(fps, F.lit(0.0)), 4)).alias("fps"),
                    a.isNotNull().alias("hasAudio"), F.coalesce(v["codec_name"], a["codec_name"]).alias("codec"))


def read_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """projects, assets, tracks, clips, keyframes, beats. Absent fields stay null; unknown texts are kept."""
    doc = spark.read.schema(schemas.PROJECT).option("multiLine", "true").json(path)
    return _project_tables(doc)


def _project_tables(doc: DataFrame) -> dict[str, DataFrame]:
    pid = F.col("id").alias("project_id")
    tracks = doc.select(pid, F.posexplode("tracks").alias("track_index", "t"))
    clips = tracks.select("project_id", "track_index", F.col("t.id").alias("track_id"), F.col("t.kind").alias("kind"), F.col("t.locked").alias("locked"), F.col("t.muted").alias("track_muted"), F.posexplode("t.clips").alias("clip_index", "c"))
    flat = clips.select("project_id", "track_index", "track_id", "kind", "locked", "track_muted", "clip_index", F.col("c.id").alias("clip_id"), F.col("c.assetId").alias("asset_id"), F.col("c.startMs").alias("start_ms"),
                        F.col("c.inMs").alias("in_ms"), F.col("c.outMs").alias("out_ms"), F.col("c.linkId").alias("link_id"), F.col("c.reversed").alias("reversed"), F.col("c").alias("document"))
    props = {"position": "transform.position", "scale": "transform.scale", "rotation": "transform.rotation", "opacity": "transform.opacity", "blur": "transform.blur", "volume": "audio.volume", "mask": "mask.rect"}
    as_array = lambda k, vector: F.transform(k["keyframes"], lambda q: F.struct(q["timeMs"].alias("time_ms"), (q["value"] if vector else F.array(q["value"])).alias("value"), q["easing"].alias("easing"), q["bezier"].alias("bezier")))
    keys = F.array(*[F.struct(F.lit(n).alias("property"), as_array(F.col(f"c.{f}"), n in ("position", "mask")).alias("keys")) for n, f in props.items()])
    keyed = clips.select("project_id", F.col("c.id").alias("clip_id"), F.explode(keys).alias("p")).select("project_id", "clip_id", "p.property", F.explode("p.keys").alias("k")).select("project_id", "clip_id", "property", "k.*")
    return {"projects": doc.drop("assets", "tracks", "beatMarkers"), "assets": doc.select(pid, F.posexplode("assets").alias("asset_index", "a")).select("project_id", "asset_index", "a.*"),
            "tracks": tracks.select("project_id", "track_index", *[F.col(f"t.{n}").alias(n) for n in ("id", "kind", "name", "locked", "muted", "role")]), "clips": flat, "keyframes": keyed,
            "beats": doc.select(pid, F.explode("beatMarkers").alias("b")).select("project_id", "b.*")}


def _extend(json: Column, *members: Column) -> Column:
    """Append ``"name":value`` members (null = none) to a JSON object text."""
    more = F.concat_ws(",", *members)
    head = F.substr(json, F.lit(1), F.length(json) - 1)
    return F.concat(head, F.when((F.length(head) > 1) & (more != ""), ",").otherwise(""), more, F.lit("}"))


def _json_list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("]"))


def write_projects(tables: dict[str, DataFrame], path: str) -> None:
    """Nest the tables again, one JSON document per line. Optional nulls are left out, the contract's nulls
    (mask, reframe, freezeFrame) are written, and -0.0 becomes 0.0. A project is one document by nature."""
    flat = lambda n: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col(n))
    doc = F.col("document").withField("startMs", flat("start_ms")).withField("inMs", flat("in_ms")).withField("outMs", flat("out_ms"))
    nulls = [F.when(F.col(f"document.{n}").isNull(), F.lit(f'"{n}":null')) for n in ("mask", "reframe", "freezeFrame")]
    color = F.col("document.color")
    no_lut = F.when(color["lutAssetId"].isNull(), F.lit('"lutAssetId":null'))
    nulls.append(F.when(color.isNotNull(), F.concat(F.lit('"color":'), _extend(F.to_json(color), no_lut))))
    doc = doc.dropFields("color")
    ordered = lambda pos, json: F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), json.alias("j")))), lambda s: s["j"])
    clips = tables["clips"].groupBy("project_id", "track_index").agg(ordered("clip_index", _extend(F.to_json(doc), *nulls)).alias("clips"))
    t = tables["tracks"].join(clips, ["project_id", "track_index"], "left")
    track = _extend(F.to_json(F.struct("id", "kind", "name", "locked", "muted", "role")), F.concat(F.lit('"clips":'), _json_list(F.col("clips"))))
    tracks = t.groupBy("project_id").agg(ordered("track_index", track).alias("tracks"))
    names = [n for n in tables["assets"].columns if n not in ("project_id", "asset_index")]
    assets = tables["assets"].groupBy("project_id").agg(ordered("asset_index", F.to_json(F.struct(*names))).alias("assets"))
    beats = tables["beats"].groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("timeMs", "strength", "kind"))), lambda s: F.to_json(s)).alias("beats"))
    p = tables["projects"]
    j = p.withColumn("project_id", F.col("id")).join(tracks, "project_id", "left").join(assets, "project_id", "left").join(beats, "project_id", "left")
    members = [F.concat(F.lit(f'"{n}":'), _json_list(F.col(c))) for n, c in (("assets", "assets"), ("tracks", "tracks"), ("beatMarkers", "beats"))]
    j.select(_extend(F.to_json(F.struct(*p.columns)), *members).alias("value")).write.mode("overwrite").text(path)


def read_analysis(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """assets, shots, duplicates, reframe, audio, transitions per analysed clip (key: source file and path)."""
    doc = spark.read.schema(schemas.ANALYSIS).option("multiLine", "true").json(path).select(F.input_file_name().alias("source"), F.posexplode("clips").alias("pos", "c"))
    key = ["source", "pos", F.col("c.path").alias("path")]
    rows = lambda n: doc.select(*key, F.explode(f"c.{n}").alias("r")).select("source", "pos", "path", "r.*")
    return {"assets": doc.select(*key[:2], F.col("c.path").alias("clip_path"), "c.asset.*"), "shots": rows("shots"), "duplicates": rows("duplicates"), "reframe": rows("reframe"), "transitions": rows("transitions"),
            "audio": doc.select(*key, "c.audio.*").filter(F.col("integratedLufs").isNotNull())}


def read_cube_luts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lattice: lut_id, size, ir, ig, ib, r, g, b; errors: lut_id, error) of .cube files, red running fastest."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("lut_id"), F.split(F.regexp_replace("value", "﻿", ""), r"\r?\n").alias("_l"))
    lines = text.select("lut_id", F.transform("_l", lambda s: F.trim(s)).alias("_l"))
    size = F.regexp_extract(F.try_element_at(F.filter("_l", lambda s: s.startswith("LUT_3D_SIZE")), F.lit(1)), r"LUT_3D_SIZE\s+(\d+)", 1).try_cast("int")
    num = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
    rows = F.filter("_l", lambda s: s.rlike(rf"^{num}\s+{num}\s+{num}(\s|$)"))
    t = lines.select("lut_id", size.alias("size"), F.exists("_l", lambda s: s.startswith("LUT_1D_SIZE")).alias("_one"), rows.alias("_r"))
    error = F.when(F.col("_one"), "1D LUTs are not supported").when(F.col("size").isNull(), "missing LUT_3D_SIZE").when(~F.col("size").between(2, 128), "unsupported size").when(F.size("_r") != F.col("size") * F.col("size") * F.col("size"), "wrong number of rows")
    t = t.withColumn("error", error)
    p = t.filter(F.col("error").isNull()).select("lut_id", "size", F.posexplode("_r").alias("i", "_v")).withColumn("_v", F.split("_v", r"\s+"))
    n = F.col("size")
    lattice = p.select("lut_id", "size", (F.col("i") % n).alias("ir"), (F.floor(F.col("i") / n) % n).alias("ig"), F.floor(F.col("i") / (n * n)).alias("ib"), *[F.col("_v")[k].cast("double").alias(c) for k, c in enumerate("rgb")])
    return lattice, t.filter(F.col("error").isNotNull()).select("lut_id", "error")


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """characters, references, negatives (texts, or image entries as JSON) and generic prompts."""
    doc = spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)
    ch = doc.select(F.posexplode("characters").alias("position", "c")).select("position", "c.*")
    ch = ch.withColumn("name", F.coalesce("name", "id")).withColumn("species", F.coalesce("species", "id")).withColumn("unique", F.coalesce("unique", F.lit(True)))
    neg = doc.select(F.posexplode("negatives").alias("position", "_n"))
    obj = F.from_json("_n", "text string, image string")
    negatives = neg.select("position", F.when(F.col("_n").startswith("{"), obj["text"]).otherwise(F.col("_n")).alias("text"), F.when(F.col("_n").startswith("{"), obj["image"]).alias("image"))
    return {"characters": ch.drop("references"), "references": doc.select(F.explode("characters").alias("c")).select(F.col("c.id").alias("character"), F.explode("c.references").alias("r")).select("character", "r.*"), "negatives": negatives,
            "prompts": doc.select(F.posexplode(F.coalesce("genericPrompts", F.array(F.lit("animal character")))).alias("position", "prompt"))}


def zero_shot_texts(characters: DataFrame, negatives: DataFrame) -> DataFrame:
    """Sentences per owner for the open-set check: one per species and alias, the descriptions, then the
    negatives under the owner ``-``."""
    kinds = F.array_distinct(F.concat(F.array("species"), F.coalesce("aliases", F.array().cast("array<string>"))))
    said = F.transform(kinds, lambda k: F.concat(F.lit("a cartoon "), k, F.lit(" character")))
    own = F.coalesce("zeroShot", F.array().cast("array<string>"))
    desc = F.when(F.size(own) > 0, own).when(F.coalesce("features", F.lit("")) != "", F.array(F.concat(F.lit("a cartoon "), "species", F.lit(" character: "), "features"))).otherwise(F.array().cast("array<string>"))
    cast = characters.select(F.col("id").alias("owner"), F.explode(F.concat(said, desc)).alias("text"))
    neg = negatives.select("text").union(characters.select(F.col("notLike").alias("text"))).filter(F.col("text").isNotNull()).distinct()
    return cast.unionByName(neg.select(F.lit("-").alias("owner"), "text"))


def write_shot_list(shots: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = shots.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)


def fingerprints(inputs: DataFrame, options: str, version: str, bank: str = "none") -> DataFrame:
    """Adds ``key``, the identity of one analysis: path, size, modification time, options, bank and version."""
    return inputs.withColumn("key", F.sha1(F.to_json(F.struct("path", "size", "mtime", F.lit(options).alias("options"), F.lit(bank).alias("bank"), F.lit(version).alias("version")))))


def incremental(inputs: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs whose key is cached, inputs still to do)."""
    keys = cache.select("key").distinct()
    return inputs.join(keys, "key", "left_semi"), inputs.join(keys, "key", "left_anti")


def append_cache(results: DataFrame, path: str, partition: str = "version") -> None:
    results.write.mode("append").partitionBy(partition).parquet(path)


def save_bank(refs: DataFrame, path: str, key: str, threshold: float, margin: float) -> None:
    refs.withColumns({"key": F.lit(key), "threshold": F.lit(threshold), "margin": F.lit(margin)}).write.mode("append").partitionBy("key").parquet(path)


def load_bank(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("key") == key)


def read_adjust_presets(spark: SparkSession, path: str, default: dict[str, object] | None = None) -> DataFrame:
    """Versioned slider presets; the default is written first when nothing is there yet."""
    read = spark.read.schema(schemas.ADJUST)
    try:
        return read.json(path)
    except AnalysisException:
        if default is None:
            raise
    write_adjust_presets(spark.createDataFrame([(1, "Universal adjust", default)], schemas.ADJUST), path)
    return read.json(path)


def write_adjust_presets(presets: DataFrame, path: str) -> None:
    presets.write.mode("overwrite").json(path)
