"""Numeric Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base CRF by quality, for high and other resolutions.
BASE_CRF = {"low": (40.0, 35.0), "medium": (35.0, 30.0), "high": (30.0, 25.0)}
#: Bit rates in kbit/s by channel layout.
LAYOUT_BITRATES = {"mono": 64, "stereo": 128, "2.1": 160, "5.1": 256, "6.1": 320, "7.1": 384, "7.1.4": 512}
#: Other spellings of channel layouts.
LAYOUT_NAMES = {"mono": "mono", "stereo": "stereo", "2.1": "2.1", "5.1": "5.1", "5.1(side)": "5.1", "6.1": "6.1", "7.1": "7.1", "7.1.4": "7.1.4", "dolbyatmos": "7.1.4"}
#: What replaces the codec in a title, by layout.
LAYOUT_LABELS = {"mono": "Opus 1.0", "stereo": "Opus 2.0", "2.1": "Opus 2.1", "5.1": "Opus 5.1", "6.1": "Opus 6.1", "7.1": "Opus 7.1", "7.1.4": "Opus 7.1.4"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def percent(current: Column, total: Column) -> Column:
    """Two-digit per cent; 0 without a positive total."""
    return F.when(total > 0, F.floor(current / total * 10000 + 0.5) / 100.0).otherwise(0.0)


def leading_int(text: Column, default: int) -> Column:
    """The whole number a text begins with; ``default`` where there is none or it is 0."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return F.coalesce(F.nullif(number, F.lit(0).cast("bigint")), F.lit(default).cast("bigint"))


def leading_double(text: Column, default: float) -> Column:
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.coalesce(F.nullif(number, F.lit(0.0)), F.lit(default))


def exclusive_quantile(values: Column, n: int) -> Column:
    """The ``n``-th of 99 cut points of a sorted array of doubles by the exclusive method.

    Cut points may lie outside the values; a single value is its own quantile.
    """
    size = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(n * (size + 1) / 100).cast("int"), size - 1))
    delta = n * (size + 1) - 100 * j
    between = (F.get(values, j - 1) * (100 - delta) + F.get(values, j) * delta) / 100
    return F.when(size == 1, F.get(values, F.lit(0))).when(size > 1, between)


def clamped_score(score: Column) -> Column:
    """Infinite scores are 100, negative ones and NaN are 0."""
    return F.when(F.isnan(score), 0.0).when(score == float("inf"), 100.0).when(score >= 0, score).otherwise(0.0)


def weighted_psnr(y: Column, u: Column, v: Column) -> Column:
    """The PSNR of the mean squared error of three planes, the first weighing 4 of 6."""
    error = lambda s: F.pow(F.lit(10.0), -s / 10.0) * (255.0 * 255.0)
    weighted = (4.0 * error(y) + error(u) + error(v)) / 6.0
    return F.log10(255.0 * 255.0 / weighted) * 10.0


def base_crf(quality: Column, high_resolution: Column) -> Column:
    """By name of the quality, or the number that it is."""
    crf = quality.try_cast("double")
    for name, (large, small) in BASE_CRF.items():
        crf = F.when(quality == name, F.when(high_resolution, large).otherwise(small)).otherwise(crf)
    return crf


def crf_adjustment(p15: Column, mean: Column, strength: float, limit: float) -> Column:
    """How far a scene's low scores lie below the mean, in quarters, within the limit; null for a mean of 0."""
    raw = F.ceil((1.0 - F.try_divide(p15, mean)) * strength * 4.0).cast("double") / 4.0
    return F.when(raw.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), raw)))  # greatest and least pass over nulls


def layout_name(layout: Column) -> Column:
    return F.coalesce(F.element_at(_map(LAYOUT_NAMES), layout), F.lit("stereo"))


def layout_bitrate(layout: Column, bitrates: Column | None = None) -> Column:
    """The layout's bit rate, else that of stereo, else 128."""
    rates = _map(LAYOUT_BITRATES) if bitrates is None else bitrates
    return F.coalesce(F.element_at(rates, layout), F.element_at(rates, F.lit("stereo")), F.lit(128))


def layout_label(layout: Column) -> Column:
    return F.coalesce(F.element_at(_map(LAYOUT_LABELS), layout), F.lit("Opus 2.0"))


def delay_filter(ms: Column) -> Column:
    """An audio delay in whole milliseconds as a filter: negative ones trim by seconds, positive ones pad."""
    trim = F.concat(F.lit("atrim=start="), (F.abs(ms) / 1000.0).cast("string"))
    return F.when(ms < 0, trim).when(ms > 0, F.concat(F.lit("adelay="), ms.cast("bigint").cast("string"), F.lit(":all=1"))).otherwise("")
