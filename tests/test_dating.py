from datetime import datetime, timezone

from helpers import values
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions.dates import DATE_RULES, HIGH, LOW, MEDIUM, NONE, TagRule
from tidefold.operators import dating
from tidefold.sources.tags import flatten_tags

COLON, WALL = "2023:06:15 10:30:45", "2023-06-15 10:30:45"
MTIME = datetime(2023, 4, 20, 14, 15, 30, tzinfo=timezone.utc)
MTIME_WALL = "2023-04-20 14:15:30"


def tag_table(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.TAGS)


def files(spark, *paths, mtime=MTIME):
    return spark.createDataFrame([(p, mtime, 1) for p in paths], schemas.INVENTORY)


def best(spark, path, *tags, mtime=MTIME):
    rows = [(path, *tag) for tag in tags]
    dated = dating.best_date(files(spark, path, mtime=mtime), tag_table(spark, *rows))
    return values(dated, "date_wall", "confidence", "source")[0]


def test_exif_takes_the_first_tag_that_parses(spark):
    got = best(
        spark, "/s/a.JPG",
        ("exif", "DateTimeOriginal", -1, "0000:00:00 00:00:00"),
        ("exif", "DateTime", -1, "2022:01:01 00:00:00"),
        ("exif", "DateTimeDigitized", -1, COLON),
    )
    assert got == (WALL, HIGH, "EXIF DateTimeDigitized")


def test_exif_reads_only_the_colon_layout(spark):
    got = best(spark, "/s/a.jpg", ("exif", "DateTimeOriginal", -1, WALL))
    assert got == (MTIME_WALL, LOW, "Filesystem mtime")


def test_tags_of_another_kind_of_file_are_not_read(spark):
    assert best(spark, "/s/a.png", ("exif", "DateTime", -1, COLON))[2] == "Filesystem mtime"
    assert best(spark, "/s/a.mp4", ("exif", "DateTime", -1, COLON))[2] == "Filesystem mtime"


def test_video_order_of_tags(spark):
    got = best(
        spark, "/s/a.mp4",
        ("stream", "creation_time", 0, "2020-01-01 00:00:00"),
        ("format", "com.apple.quicktime.creationdate", -1, "2021-01-01 00:00:00"),
        ("format", "date", -1, WALL),
        ("format", "creation_time", -1, "2023"),
    )
    assert got == (WALL, HIGH, "Video date")


def test_video_in_weak_containers_is_medium(spark):
    for name in ("/s/a.avi", "/s/a.webm"):
        assert best(spark, name, ("format", "date", -1, WALL)) == (WALL, MEDIUM, "Video date")
        stream = best(spark, name, ("stream", "creation_time", 0, WALL))
        assert stream == (WALL, MEDIUM, "Video stream creation_time")


def test_first_filled_stream_decides_even_if_it_does_not_parse(spark):
    filled = ("stream", "creation_time", 1, COLON)
    empty = ("stream", "creation_time", 0, "")
    broken = ("stream", "creation_time", 0, "yesterday")
    assert best(spark, "/s/a.mkv", empty, filled)[2] == "Video stream creation_time"
    assert best(spark, "/s/a.mkv", filled, broken)[2] == "Filesystem mtime"


def test_month_stays_that_of_the_camera(spark):
    got = best(spark, "/s/a.mov", ("format", "creation_time", -1, "2024-01-31T23:30:00-05:00"))
    assert got[0] == "2024-01-31 23:30:00"


def test_unknown_files_fall_back_to_mtime(spark):
    assert best(spark, "/s/fallback.unknown") == (MTIME_WALL, LOW, "Filesystem mtime")
    assert best(spark, "/s/fake.jpg") == (MTIME_WALL, LOW, "Filesystem mtime")
    assert best(spark, "/s/a.jpg", mtime=None) == (None, NONE, None)


def test_zero_date_counts_as_none(spark):
    zero = ("exif", "DateTime", -1, "0001:01:01 00:00:00")
    for mtime, wall in ((MTIME, MTIME_WALL), (None, None)):
        dated = dating.best_date(
            files(spark, "/s/a.jpg", mtime=mtime), tag_table(spark, ("/s/a.jpg", *zero))
        )
        assert values(dating.effective_date(dated), "date_wall") == [(wall,)]


def test_an_added_rule_is_ranked_with_the_others(spark):
    sidecar = TagRule("Sidecar", 0, -1, "xmp", "CreateDate", "Sidecar CreateDate", (".jpg",))
    tags = tag_table(
        spark,
        ("/s/a.jpg", "exif", "DateTimeOriginal", -1, COLON),
        ("/s/a.jpg", "xmp", "CreateDate", -1, "2020-02-02 00:00:00"),
    )
    got = dating.best_tag_date(tags, DATE_RULES + (sidecar,))
    assert values(got, "date_wall", "source") == [("2020-02-02 00:00:00", "Sidecar CreateDate")]


def test_flatten_tags(spark):
    docs = spark.createDataFrame(
        [
            ("/s/a.mp4", '{"format":{"tags":{"date":"x"}},"streams":[{"tags":{"creation_time":""}},'
             '{"index":1},{"tags":{"creation_time":"y"}}]}'),
            ("/s/b.mp4", '{"format":{}}'),
            ("/s/c.mp4", "not json"),
        ],
        "path string, metadata string",
    )
    assert sorted(values(flatten_tags(docs), *schemas.TAGS.names)) == [
        ("/s/a.mp4", "format", "date", -1, "x"),
        ("/s/a.mp4", "stream", "creation_time", 0, ""),
        ("/s/a.mp4", "stream", "creation_time", 2, "y"),
    ]


def test_profile(spark):
    dated = dating.best_date(
        files(spark, "/s/a.jpg", "/s/b.jpg", "/s/c.txt"),
        tag_table(spark, ("/s/a.jpg", "exif", "DateTime", -1, COLON)),
    )
    got = dating.date_source_profile(dated).orderBy(F.desc("files"))
    assert values(got, "source", "confidence", "files") == [
        ("Filesystem mtime", "low", 2), ("EXIF DateTime", "high", 1),
    ]


def test_any_number_of_rules_and_streams(spark):
    like = next(rule for rule in DATE_RULES if rule.scope == "exif")
    from dataclasses import replace

    many = tuple(replace(like, tag=f"T{i}", order=i, source=f"S{i}") for i in range(1_001))
    tags = tag_table(spark, ("/s/a.jpg", "exif", "T1000", -1, COLON), ("/s/b.jpg", "exif", "T3", -1, COLON))
    got = dict(values(dating.best_tag_date(tags, many), "path", "source"))
    assert got == {"/s/a.jpg": "S1000", "/s/b.jpg": "S3"}
    late = best(spark, "/s/a.mp4", ("stream", "creation_time", 100_000, WALL))
    assert late[0] == WALL
