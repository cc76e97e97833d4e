"""What probes of a file print, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Red, green and blue x and y of the mastering display.
CHROMATICITY = {"Display P3": ("0.6800", "0.3200", "0.2650", "0.6900", "0.1500", "0.0600"), "": ("0.7080", "0.2920", "0.1700", "0.7970", "0.1310", "0.0460")}
#: The video stream where a probe gives none: index, width, height.
NO_STREAM = (0, 1920, 1080)

AUDIO_SCHEMA = "streams array<struct<index: int, channels: int, channel_layout: string, tags: struct<language: string, title: string>>>"


def hdr_flags(transfer: Column, formats: Column) -> tuple[Column, Column, Column]:
    return (
        (transfer == "PQ").alias("is_hdr"),
        formats.rlike(r"(?i)HDR10\+").alias("has_hdr10plus"),
        formats.rlike(r"(?i)Dolby Vision").alias("has_dolby_vision"),
    )


#: X and y of the white point, and the codes of BT.2020 primaries, its matrix, limited range and the PQ transfer.
WHITE_POINT = ("0.3127", "0.3290")
PRIMARIES, MATRIX, LIMITED, PQ = 9, 9, 1, 16


def primaries_code(primaries: Column) -> Column:
    return F.when(primaries == "BT.2020", PRIMARIES)


def matrix_code(matrix: Column) -> Column:
    return F.when(matrix == "BT.2020 non-constant", MATRIX)


def range_code(colour_range: Column) -> Column:
    return F.when(colour_range == "Limited", LIMITED)


def light_levels(max_cll: Column, max_fall: Column) -> Column:
    """Both light levels where both are whole numbers, else null."""
    both = max_cll.rlike(r"^\d+$") & max_fall.rlike(r"^\d+$")
    return F.when(both, F.struct(max_cll.try_cast("int").alias("content"), max_fall.try_cast("int").alias("frame")))


def luminance(text: Column) -> Column:
    """(least, most) from ``min: ..., max: ...``; null where either is missing."""
    value = lambda name: F.nullif(F.regexp_extract(text, rf"{name}:\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
    least, most = value("min"), value("max")
    return F.when(least.isNotNull() & most.isNotNull(), F.struct(least.alias("least"), most.alias("most")))


def chromaticity(display: Column) -> Column:
    own, other = (F.array(*(F.lit(float(v)) for v in CHROMATICITY[k])) for k in ("Display P3", ""))
    return F.when(display == "Display P3", own).when(display != "", other)


#: The fields of a media probe's key and value text.
PROBE_FIELDS = (
    "HDR_Format", "transfer_characteristics", "colour_primaries", "matrix_coefficients", "colour_range", "MaxCLL", "MaxFALL",
    "MasteringDisplay_ColorPrimaries", "MasteringDisplay_Luminance",
)


def probe_fields(probes: DataFrame, column: str = "text") -> DataFrame:
    """(file, fields...) from lines ``name: value`` of each probe (file, text); of the light levels the first word only; missing ones are ''."""
    def value(name: str) -> Column:
        found = F.trim(F.regexp_extract(F.coalesce(column, F.lit("")), rf"(?m)^[ \t]*{name}[ \t]*:(.*)$", 1))
        return F.split_part(found, F.lit(" "), F.lit(1)) if name in ("MaxCLL", "MaxFALL") else found

    return probes.select("file", *(value(n).alias(n.lower()) for n in PROBE_FIELDS))


def hdr_metadata(fields: DataFrame) -> DataFrame:
    """(file, transfer, primaries, matrix, range, levels, luminance, chromaticity, white) of what ``probe_fields`` gives."""
    c = F.col
    display = c("masteringdisplay_colorprimaries")
    return fields.select(
        "file", F.when(c("transfer_characteristics") == "PQ", PQ).alias("transfer"), primaries_code(c("colour_primaries")).alias("primaries"),
        matrix_code(c("matrix_coefficients")).alias("matrix"), range_code(c("colour_range")).alias("range"), light_levels(c("maxcll"), c("maxfall")).alias("levels"),
        luminance(c("masteringdisplay_luminance")).alias("luminance"), chromaticity(display).alias("chromaticity"),
        F.when(display != "", F.array(*(F.lit(float(v)) for v in WHITE_POINT))).alias("white"),
    )


def video_streams(probes: DataFrame, column: str = "csv") -> DataFrame:
    """(file, index, width, height) of the widest stream of each probe (file, csv lines ``index,width,height``)."""
    lines = probes.select("file", F.posexplode_outer(F.filter(F.split(column, "\n"), lambda x: F.trim(x) != "")).alias("place", "line"))
    fields = F.split("line", ",")
    numbers = [F.coalesce(F.nullif(F.get(fields, F.lit(i)).try_cast("int"), F.lit(0)), F.lit(0)).alias(n) for i, n in enumerate(("index", "width", "height"))]
    rows = lines.select("file", "place", "line", *numbers)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("width"), "place"))).filter("rank = 1")
    pick = lambda name, default: F.when(F.col("line").isNull(), default).otherwise(F.col(name)).alias(name)
    return ranked.select("file", *(pick(n, d) for n, d in zip(("index", "width", "height"), NO_STREAM, strict=True)))


def audio_streams(probes: DataFrame, column: str = "json") -> DataFrame:
    """(file, place, index, channels, layout, language, title) of each audio stream of a JSON probe; bad JSON has none."""
    rows = probes.select("file", F.posexplode(F.from_json(column, AUDIO_SCHEMA, {"mode": "PERMISSIVE"})["streams"]).alias("place", "s"))
    return rows.select("file", "place", "s.index", "s.channels", F.coalesce("s.channel_layout", F.lit("stereo")).alias("layout"), "s.tags.language", "s.tags.title")
