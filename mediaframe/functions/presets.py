"""Preset dimension tables. All entries are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPEED = {
    "normal": [(0, 1), (1, 1)],
    "montage": [(0, 0.6), (0.2, 2.2), (0.4, 0.6), (0.6, 2.2), (0.8, 0.6), (1, 1.5)],
    "hero_time": [(0, 1), (0.3, 2.5), (0.5, 0.25), (0.7, 0.25), (1, 1.5)],
    "bullet": [(0, 3), (0.35, 3), (0.5, 0.15), (0.65, 3), (1, 3)],
    "jump_cut": [(0, 1), (0.24, 1), (0.26, 5), (0.49, 5), (0.51, 1), (0.74, 1), (0.76, 5), (1, 5)],
    "flash_in": [(0, 4), (0.3, 1.5), (1, 1)],
    "flash_out": [(0, 1), (0.7, 1.5), (1, 4)],
}
TRANSITIONS = ["dissolve", "dipToBlack", "dipToWhite", "wipeLeft", "wipeRight", "wipeUp", "wipeDown", "slideLeft", "slideRight", "pushLeft", "pushRight",
               "zoomIn", "zoomOut", "blurDissolve", "flash", "circleOpen"]
# type: default ms, uses the ramp envelope, parameter defaults
EFFECTS = {
    "cameraSnap": (1500, False, {"border": 0.03, "scale": 0.92}), "fadeFromBlack": (1000, False, {}), "fadeToBlack": (1000, False, {}), "fadeFromWhite": (1000, False, {}),
    "fadeToWhite": (1000, False, {}), "blackAndWhite": (3000, True, {}), "sepia": (3000, True, {}), "letterbox": (3000, True, {"ratio": 2.39}),
    "shake": (1000, True, {"amplitude": 0.01, "frequency": 12.0}), "zoomPunch": (500, False, {}), "blurIn": (1000, False, {}), "blurOut": (1000, False, {}),
    "rgbSplit": (1000, True, {"amount": 0.006}), "vhs": (3000, True, {}), "vignettePulse": (3000, True, {}), "flashWhite": (400, False, {}),
}
COLOUR = {
    "Neutral": {}, "Cinematic_Teal_Orange": {"contrast": 6, "saturation": 3, "temperature": 4, "vignette": 0.25}, "Bleach_Bypass": {"contrast": 14, "saturation": -22, "highlights": 5, "shadows": -6, "grain": 0.25},
    "Warm_Film": {"temperature": 9, "tint": 2, "contrast": 3, "vibrance": 5, "grain": 0.15, "vignette": 0.15}, "Cool_Noir": {"temperature": -8, "saturation": -15, "contrast": 11, "shadows": -10, "vignette": 0.35},
    "Vibrant_Pop": {"saturation": 11, "vibrance": 9, "contrast": 5, "sharpness": 10},
}
COLOUR_WHEELS = {"Cinematic_Teal_Orange": {"lift": [-0.03, 0.01, 0.06], "gain": [0.06, 0.02, -0.05]}}


def speed_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, [(float(t), float(s)) for t, s in v]) for k, v in SPEED.items()], "preset string, points array<struct<x:double,y:double>>")


def transition_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TRANSITIONS)], "type string, code int")


def effect_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i, ms, env, p) for i, (k, (ms, env, p)) in enumerate(EFFECTS.items())], "type string, code int, default_ms int, envelope boolean, params map<string,double>")


def colour_presets(spark: SparkSession) -> DataFrame:
    rows = [(k, {n: float(x) for n, x in v.items()}, COLOUR_WHEELS.get(k, {})) for k, v in COLOUR.items()]
    return spark.createDataFrame(rows, "preset string, sliders map<string,double>, wheels map<string,array<double>>")
