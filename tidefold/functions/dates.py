"""Wall-clock dates and the rules that rank where a date comes from.

Dates stay text in their own zone (``yyyy-MM-dd HH:mm:ss``). Turning a tag such
as ``2024-01-31T23:30:00-05:00`` into an instant would file it under the month
of the session zone, not of the camera's clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, LOW, MEDIUM, HIGH = range(4)

# Confidence ranks and their labels.
CONFIDENCE_LABELS = {NONE: "none", LOW: "low", MEDIUM: "medium", HIGH: "high"}

# The zero date, which counts as no date.
ZERO_DATE = "0001-01-01 00:00:00"

_DAY = r"\d{4}-\d{2}-\d{2}"
_COLON_DAY = r"\d{4}:\d{2}:\d{2}"
# An hour may have one digit and a fraction of a second may follow, as lenient
# layout parsers accept them; a run of spaces counts as one.
_CLOCK = r"(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?"
_ZONE = r"(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))"

# The layouts of tag dates.
LAYOUTS = {
    "rfc3339": f"{_DAY}T{_CLOCK}{_ZONE}",
    "iso": f"{_DAY}T{_CLOCK}",
    "spaced": f"{_DAY} +{_CLOCK}",
    "colon": f"{_COLON_DAY} +{_CLOCK}",
}


def parse_wall(value: Column, layouts=tuple(LAYOUTS)) -> Column:
    """Wall clock of a tag date as TIMESTAMP_NTZ, or null if no layout fits or
    no such day exists. Fractions of a second are dropped."""
    shape = "|".join(LAYOUTS[name] for name in layouts)
    day = F.replace(F.substring(value, 1, 10), F.lit(":"), F.lit("-"))
    clock = F.regexp_extract(value, r"[T ](\d{1,2}:\d{2}:\d{2})", 1)
    wall = F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")
    return F.when(value.rlike(rf"\A(?:{shape})\z"), wall)


def parse_tag_date(value: Column, layouts=tuple(LAYOUTS)) -> Column:
    """The same as text."""
    return parse_wall(value, layouts).cast("string")


def wall_clock(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss")


def month_of(wall: Column) -> Column:
    return F.substring(wall, 1, 7)


def confidence_label(rank: Column) -> Column:
    label = None
    for value, text in CONFIDENCE_LABELS.items():
        label = F.when(rank == value, text) if label is None else label.when(rank == value, text)
    return label.otherwise("unknown")


@dataclass(frozen=True)
class TagRule:
    """One tag a date may be read from.

    ``rank`` orders the extractors, ``order`` the tags of one extractor. Files
    of the ``weak`` extensions carry the tag at medium confidence only. More
    sources are added by adding rules.
    """

    extractor: str
    rank: int
    order: int
    scope: str
    tag: str
    source: str
    extensions: tuple[str, ...]
    layouts: tuple[str, ...] = tuple(LAYOUTS)
    weak: tuple[str, ...] = ()


# Extractors in order of precedence and the extensions they read;
# None stands for any.
EXTRACTORS = {
    "EXIF": (".jpg", ".jpeg", ".heic", ".heif"),
    "Video": (".mp4", ".mov", ".mkv", ".webm", ".avi"),
    "PNG": (".png",),
    "Filesystem": None,
}
MTIME_SOURCE = "Filesystem mtime"

# The tags of each extractor, best first.
EXIF_TAGS = ("DateTimeOriginal", "DateTimeDigitized", "DateTime")
VIDEO_TAGS = (
    ("format", "creation_time", "Video creation_time"),
    ("format", "date", "Video date"),
    ("format", "com.apple.quicktime.creationdate", "Video com.apple.quicktime.creationdate"),
    ("stream", "creation_time", "Video stream creation_time"),
)
WEAK_CONTAINERS = (".avi", ".webm")

EXIF_RULES = tuple(
    TagRule("EXIF", 0, order, "exif", tag, f"EXIF {tag}", EXTRACTORS["EXIF"], ("colon",))
    for order, tag in enumerate(EXIF_TAGS)
)
VIDEO_RULES = tuple(
    TagRule("Video", 1, order, scope, tag, source, EXTRACTORS["Video"], weak=WEAK_CONTAINERS)
    for order, (scope, tag, source) in enumerate(VIDEO_TAGS)
)
# PNG files carry no date tag that could be read; they fall through to mtime.
DATE_RULES = EXIF_RULES + VIDEO_RULES


def tag_confidence(ext: Column, weak: tuple[str, ...] = WEAK_CONTAINERS) -> Column:
    if not weak:
        return F.lit(HIGH)
    return F.when(ext.isin(*weak), MEDIUM).otherwise(HIGH)


def eligible_extractors(ext: Column) -> Column:
    """Array of the extractors that read this extension, in precedence order."""
    names = [
        F.lit(name) if extensions is None else F.when(ext.isin(*extensions), name)
        for name, extensions in EXTRACTORS.items()
    ]
    return F.array_compact(F.array(*names))
