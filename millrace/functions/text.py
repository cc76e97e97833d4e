"""Names, paths, titles and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of media that are picked up.
MEDIA_EXTENSIONS = ("mp4", "mkv", "avi", "webm", "flv", "ts", "mov")
#: Source tags in order of priority, with their spelling in names.
SOURCE_TAGS = (("REMUX", "Bluray"), ("WEBDL", "WEBDL"), ("WEBRIP", "WEBRip"), ("BLURAY", "Bluray"), ("HDTV", "HDTV"), ("DVD", "DVD"), ("SDTV", "SDTV"), ("CAM", "CAM"))
DEFAULT_SOURCE_TAG = "Bluray"
#: Resolution tags with the least width or height of each; below them, and without a size.
RESOLUTION_TAGS = (("2160p", 3200, 2100), ("1080p", 1800, 1000), ("720p", 1200, 700), ("576p", 1000, 560))
SMALLEST_TAG, DEFAULT_TAG = "480p", "1080p"
#: Fixed value: the pattern of codec names in audio titles; they become the new codec's name.
CODEC_NAMES = r"(?i)\b(?:TrueHD(?:\s+Atmos)?|E-?AC-?3|DDP?|AC-?3|DTS(?:-?HD(?:[\s-]?MA)?|-?ES|-?X|-?MA)?|FLAC|AAC|L?PCM|MP3|Vorbis|WMA|Opus|Atmos)\b"
#: What each job status is called.
STATUS_LABELS = {"queued": "Queued", "probing": "Analyzing", "encoding_video": "Video", "encoding_audio": "Audio", "muxing": "Muxing", "done": "Done", "error": "Error"}
#: The statuses of a job that is being worked on.
ACTIVE_STATUSES = ("probing", "encoding_video", "encoding_audio", "muxing")


def extension(path: Column) -> Column:
    """The part after the last dot of the last segment, without the dot; empty if there is none."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^/.]*)$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def dirname(path: Column) -> Column:
    """The part before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def normal_path(path: Column, backslashes: bool = False) -> Column:
    """``path`` with single slashes and none at its end; a path that begins with one is absolute and keeps it.

    The roots are ``/`` and, of relative paths, the empty path.  With ``backslashes`` these separate as well.
    """
    plain = F.translate(path, "\\", "/") if backslashes else path
    return F.regexp_replace(plain, "(?s)(?<=.)/+$|(?<=/)/+", "")


def is_root(path: Column) -> Column:
    return path.isin("", "/")


def folder_of(path: Column) -> Column:
    """The folder that holds a normal path: ``/`` of ``/a``, the empty path of ``a``; null of a root."""
    return F.when(~is_root(path), F.regexp_extract(path, "(?s)^(/(?=[^/]+$)|.*(?=/[^/]*$)|)", 1))


def depth_of(folder: Column) -> Column:
    """How many folders a normal path has below its root; 0 of a root."""
    slashes = F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit("")))
    return F.when(is_root(folder), 0).otherwise(F.when(folder.startswith("/"), slashes).otherwise(slashes + 1))


def ancestor(folder: Column, depth: Column) -> Column:
    """The folder at ``depth`` on the way from the root to a normal path."""
    absolute = folder.startswith("/")
    below = F.call_function("substring_index", folder, F.lit("/"), depth + F.when(absolute, 1).otherwise(0))
    return F.when(depth > 0, below).otherwise(F.when(absolute, "/").otherwise(""))


def is_media(path: Column) -> Column:
    return F.lower(extension(path)).isin(*MEDIA_EXTENSIONS)


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def already_encoded(name: Column, organisation: str) -> Column:
    """Whether the stem ends with ``-organisation`` (case matters)."""
    return stem(name).endswith(f"-{organisation}")


def source_tag(name: Column) -> Column:
    """The tag of the first source word in order of priority; a word is bounded as in regular expressions."""
    upper = F.upper(name)
    tag = F.lit(DEFAULT_SOURCE_TAG)
    for word, label in reversed(SOURCE_TAGS):
        tag = F.when(upper.rlike(rf"\b{word}\b"), label).otherwise(tag)
    return tag


def release_group(name: Column) -> Column:
    """What follows ``]-`` at the end of a name, or null."""
    return F.nullif(F.regexp_extract(name, r"\]-([A-Za-z0-9_]+)$", 1), F.lit(""))


def base_title(name: Column) -> Column:
    """The name up to the first bracket, without dashes before it."""
    return F.trim(F.regexp_replace(name, r"(?s)\s*[-–—]*\s*\[.*$", ""))


def sanitized_title(title: Column) -> Column:
    """Codec names become Opus, dashes get one blank on both sides, runs of blanks become one."""
    named = F.regexp_replace(title, CODEC_NAMES, "Opus")
    dashed = F.regexp_replace(named, r"\s*-\s*", " - ")
    return F.trim(F.regexp_replace(dashed, r"\s{2,}", " "))


def resolution_tag(width: Column, height: Column) -> Column:
    tag = F.when((width > 0) & (height > 0), SMALLEST_TAG).otherwise(DEFAULT_TAG)
    for label, least_width, least_height in reversed(RESOLUTION_TAGS):
        tag = F.when((width >= least_width) | (height >= least_height), label).otherwise(tag)
    return tag


def frames_label(current: Column, total: Column) -> Column:
    """``1,234 / 5,678 frames``."""
    return F.concat(F.format_number(current, 0), F.lit(" / "), F.format_number(total, 0), F.lit(" frames"))


def output_name(title: Column, tag: Column, resolution: Column, audio: Column, organisation: str) -> Column:
    return F.format_string(f"%s [%s-%s][%s][AV1]-{organisation}.mkv", title, tag, resolution, audio)


def xml_escaped(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def human_size(size: Column, digits: int = 2) -> Column:
    """Bytes with the largest unit of 1024 that fits, to TiB; halves of the last digit go up, in whole numbers."""
    scale = 10**digits
    unit, power = F.lit("B"), F.lit(1).cast("bigint")
    for k, name in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        unit, power = F.when(size >= 1024**k, name).otherwise(unit), F.when(size >= 1024**k, F.lit(1024**k)).otherwise(power)
    whole, rest = F.floor(size / power).cast("bigint"), F.pmod(size.cast("bigint"), power)
    part = F.floor((rest.cast("decimal(38,0)") * (2 * scale) + power) / (2 * power)).cast("bigint")
    whole, part = whole + F.when(part >= scale, 1).otherwise(0), F.pmod(part, F.lit(scale))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"), F.lit(" "), unit)


def duration(ms: Column) -> Column:
    """Whole hours, minutes and seconds: ``1h 2m 3s``, ``2m 3s`` or ``3s``."""
    seconds = F.floor(ms / 1000)
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def short_duration(ms: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds."""
    seconds = F.floor(ms / 1000)
    h, m = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, seconds % 60)).otherwise(F.format_string("%ds", seconds % 60))


def status_label(status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(labels, status), status)


def natural_key(name: Column) -> Column:
    """Sorts names with their digit runs as numbers of any length: each run follows the number of its digits without leading zeros."""
    pieces = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def sized(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), sized(p)).otherwise(p)), "")


def split_trim(text: Column, separator: str = ",") -> Column:
    """The parts of ``text`` without blanks at their ends; empty ones go."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.trim(p)), lambda p: p != "")


def last_characters(text: Column, n: int = 500) -> Column:
    """The end of a long message."""
    return F.right(text, F.lit(n))


def short_id(*parts: Column) -> Column:
    """Eight hexadecimal digits that depend on the parts only, so that a task that runs again gives the same."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8)
