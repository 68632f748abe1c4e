"""The best date of each row, out of ranked sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.dates import (
    DATE_RULES,
    EXIF_RULES,
    HIGH,
    LOW,
    MTIME_SOURCE,
    NONE,
    VIDEO_RULES,
    ZERO_DATE,
    TagRule,
    confidence_label,
    eligible_extractors,
    parse_wall,
    tag_confidence,
    wall_clock,
)
from tidefold.functions.paths import extension


# A date as 14 digits leaves room above it for a rank, so that "the best ranked
# date" is the minimum of one DECIMAL, which aggregates in place and has room for
# any number of rules and streams.
_DIGITS = 10**14
_UNREADABLE = _DIGITS - 1


def _packed(high: Column, digits: Column) -> Column:
    shifted = high.cast("decimal(19,0)") * F.lit(_DIGITS).cast("decimal(15,0)")
    return (shifted + digits.cast("decimal(19,0)")).cast("decimal(38,0)")


def _low(packed: Column) -> Column:
    return (packed % F.lit(_DIGITS).cast("decimal(15,0)")).cast("bigint")


def _high(packed: Column) -> Column:
    return F.call_function("div", packed, F.lit(_DIGITS).cast("decimal(15,0)")).cast("bigint")


def _digits(wall: Column) -> Column:
    return F.translate(wall.cast("string"), "-: ", "").cast("bigint")


def _text(digits: Column) -> Column:
    padded = F.lpad(digits.cast("string"), 14, "0")
    shape = r"(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)"
    return F.regexp_replace(padded, shape, "$1-$2-$3 $4:$5:$6")


def _rule_of(ext: Column, rules: tuple[TagRule, ...]) -> Column:
    """Position of the rule a tag row falls under, or null."""
    reads = {}
    found = None
    for at, rule in enumerate(rules):
        extensions = reads.setdefault(rule.extensions, ext.isin(*rule.extensions))
        fits = (F.col("scope") == rule.scope) & (F.col("tag") == rule.tag) & extensions
        found = F.when(fits, at) if found is None else found.when(fits, at)
    return found


def _wall_by_rule(rules: tuple[TagRule, ...]) -> Column:
    """The tag's date, by the layouts of its rule."""
    groups: dict[tuple[str, ...], list[int]] = {}
    for at, rule in enumerate(rules):
        groups.setdefault(rule.layouts, []).append(at)
    wall = None
    for layouts, members in groups.items():
        test, parsed = F.col("rule").isin(*members), parse_wall(F.col("value"), layouts)
        wall = F.when(test, parsed) if wall is None else wall.when(test, parsed)
    return wall


def best_tag_date(tags: DataFrame, rules: tuple[TagRule, ...] = DATE_RULES) -> DataFrame:
    """``path, date_wall, confidence, source`` of the paths some tag dates.

    The surest date wins, then the earlier extractor, then its earlier tag. One
    aggregation by path over fixed-width values, combined before its shuffle.
    A stream tag is the first non-empty one of all streams: if that one cannot
    be read, no later stream is tried.
    """
    rules = tuple(sorted(rules, key=lambda rule: (rule.rank, rule.order)))
    at = range(len(rules))
    step = len(rules) + 1
    streams = [i for i in at if rules[i].scope == "stream"]

    def weakness(rule: Column, ext: Column) -> Column:
        """How far a rule stays below the highest confidence for this file."""
        found = None
        for weak in {one.weak for one in rules if one.weak}:
            members = [i for i in at if rules[i].weak == weak]
            test, below = rule.isin(*members), F.lit(HIGH) - tag_confidence(ext, weak)
            found = F.when(test, below) if found is None else found.when(test, below)
        return F.lit(0) if found is None else found.otherwise(0)

    rows = (
        # A plain test on the tag's name is one the scan can take over.
        tags.where(F.col("tag").isin(*sorted({rule.tag for rule in rules})))
        .withColumn("ext", extension(F.col("path")))
        .withColumn("rule", _rule_of(F.col("ext"), rules))
        .where("rule is not null")
        .withColumn("digits", _digits(_wall_by_rule(rules)))
    )
    is_stream = F.col("rule").isin(*streams) if streams else F.lit(False)
    rank = weakness(F.col("rule"), F.col("ext")) * step + F.col("rule")
    packed = [F.min(F.when(~is_stream, _packed(rank, F.col("digits")))).alias("direct")]
    for i in streams:
        filled = (F.col("rule") == i) & (F.col("value") != "")
        first = _packed(F.col("stream_index"), F.coalesce("digits", F.lit(_UNREADABLE)))
        packed.append(F.min(F.when(filled, first)).alias(f"stream{i}"))

    ranked = [F.col("direct")]
    for i in streams:
        digits = _low(F.col(f"stream{i}"))
        rank = weakness(F.lit(i), extension(F.col("path"))) * step + i
        ranked.append(F.when(digits != _UNREADABLE, _packed(rank, digits)))
    best = F.least(*ranked) if streams else ranked[0]
    rank = _high(F.col("best")).cast("int")
    sources = F.array(*[F.lit(rule.source) for rule in rules])
    return (
        rows.groupBy("path")
        .agg(*packed)
        .select("path", best.alias("best"))
        .where("best is not null")
        .select("path", _low(F.col("best")), rank)
        .toDF("path", "digits", "rank")
        .select(
            "path",
            _text(F.col("digits")).alias("date_wall"),
            (F.lit(HIGH) - F.call_function("div", F.col("rank"), F.lit(step))).cast("int")
            .alias("confidence"),
            F.element_at(sources, F.col("rank") % step + 1).alias("source"),
        )
    )


def exif_date(tags: DataFrame) -> DataFrame:
    return best_tag_date(tags, EXIF_RULES)


def video_date(tags: DataFrame) -> DataFrame:
    return best_tag_date(tags, VIDEO_RULES)


def mtime_date(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("mtime").isNotNull()).select(
        "path",
        wall_clock(F.col("mtime")).alias("date_wall"),
        F.lit(LOW).alias("confidence"),
        F.lit(MTIME_SOURCE).alias("source"),
    )


def extractor_eligibility(inventory: DataFrame) -> DataFrame:
    """One row per path and extractor that reads its extension."""
    ext = extension(F.col("path"))
    return inventory.select(
        "path", ext.alias("ext"), F.explode(eligible_extractors(ext)).alias("extractor")
    )


def best_date(
    inventory: DataFrame, tags: DataFrame, rules: tuple[TagRule, ...] = DATE_RULES
) -> DataFrame:
    """The inventory with ``date_wall, confidence, source``.

    mtime has the lowest confidence and the last extractor, so it stands exactly
    where no tag does: one left join on the unique path, on the partitioning the
    tag aggregation has made anyway.
    """
    mtime = F.col("mtime")
    return inventory.join(best_tag_date(tags, rules), "path", "left").withColumns({
        "date_wall": F.coalesce("date_wall", wall_clock(mtime)),
        "confidence": F.coalesce("confidence", F.when(mtime.isNotNull(), LOW).otherwise(NONE)),
        "source": F.coalesce("source", F.when(mtime.isNotNull(), MTIME_SOURCE)),
    })


def effective_date(dated: DataFrame) -> DataFrame:
    """Replace a missing or zero date by mtime, or by null if that is none either."""

    def usable(wall: Column) -> Column:
        return F.when(wall != ZERO_DATE, wall)

    return dated.withColumn(
        "date_wall",
        F.coalesce(usable(F.col("date_wall")), usable(wall_clock(F.col("mtime")))),
    )


def date_source_profile(dated: DataFrame) -> DataFrame:
    return dated.groupBy("source", confidence_label(F.col("confidence")).alias("confidence")).agg(
        F.count(F.lit(1)).alias("files")
    )
