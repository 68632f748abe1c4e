import pytest
from helpers import apply
from pyspark.sql import functions as F

from tidefold.functions import dates, paths, states, text


def test_extension_is_the_lowered_suffix_of_the_last_name(spark):
    cases = {
        "/a/b.JPG": ".jpg", "/a.d/b": "", "/a/.png": ".png", "x.tar.GZ": ".gz",
        "/a/b.": ".", "/a/line\n.mp4": ".mp4", "": "",
    }
    assert apply(spark, paths.extension, cases) == cases


def test_basename(spark):
    cases = {"/a/b.jpg": "b.jpg", "b.jpg": "b.jpg", "/a/b c": "b c"}
    assert apply(spark, paths.basename, cases) == cases


def test_walk_key_sorts_level_by_level(spark):
    names = ["/s/a-b/x", "/s/a/z", "/s/a/b/c", "/s/a.txt", "/s/b", "/s/a", "/s/é/x", "/s/z"]
    keys = apply(spark, paths.walk_key, names)
    by_key = sorted(names, key=lambda name: keys[name].encode())
    assert by_key == sorted(names, key=lambda name: [p.encode() for p in name.split("/")])


def test_destination_is_null_without_a_month(spark):
    df = spark.createDataFrame([("/s/a.jpg", "2024-01"), ("/s/a.jpg", None)], "p string, m string")
    got = df.select(paths.destination("/d/", F.col("m"), F.col("p"))).collect()
    assert [row[0] for row in got] == ["/d/2024-01/a.jpg", None]


@pytest.mark.parametrize(
    "root, cases",
    [
        ("/home/u/photos", {
            "/home/u/photos/a.jpg": "photos/a.jpg", "/home/u/photos": "photos",
            "/home/u/photos/x//./y.jpg": "photos/x/y.jpg", "/home/u/other/b.jpg": "other/b.jpg",
            "/home/v/b.jpg": "../v/b.jpg", "/home/u": ".", "rel/a.jpg": "rel/a.jpg", "": "",
            "/home/u/photos2/a.jpg": "photos2/a.jpg",
        }),
        ("/", {"/a/b": "/a/b", "/": "/"}),
        ("", {"/a/b": "/a/b"}),
        ("rel/root", {"rel/root/a": "root/a", "/abs/a": "/abs/a", "rel/b": "b"}),
    ],
)
def test_relative_path(spark, root, cases):
    assert apply(spark, lambda c: paths.relative_path(c, root), cases) == cases


def test_state_labels_and_statuses(spark):
    got = apply(spark, states.state_label, list(range(12)), "int")
    assert got == {**states.STATE_LABELS, 11: "unknown"}
    assert set(apply(spark, states.status_of, states.STATE_LABELS.values()).values()) == set(
        states.STATUSES
    )


def test_messages(spark):
    split = {"/a: denied: again": ("/a", "denied: again"), "plain": ("plain", "plain")}
    for message, (path, detail) in split.items():
        assert apply(spark, states.message_path, [message]) == {message: path}
        assert apply(spark, states.message_detail, [message]) == {message: detail}


def test_human_size(spark):
    cases = {
        None: "-", 0: "-", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB",
        1536: "1.5 KB", 1048575: "1024.0 KB", 1048576: "1.0 MB", 5 * 2**30: "5.0 GB",
        2**50: "1.0 PB", 2**63 - 1: "8.0 EB",
    }
    assert apply(spark, text.human_size, cases, "bigint") == cases


def test_parse_size(spark):
    cases = {
        "-": 0.0, "12 B": 12.0, "1.5 KB": 1536.0, "2.0 PB": 2.0 * 2**50, "1.0 EB": 2.0**60,
        "nonsense": 0.0, "1.2.3 KB": 0.0,
    }
    assert apply(spark, text.parse_size, cases) == cases


def test_human_duration_rounds_as_c_does(spark):
    seconds = [0, 59, 60, 63, 69, 3599, 3600, 3780, 4140, 86399]
    spans = {3600: "h", 60: "m", 1: "s"}
    expected = {}
    for s in seconds:
        step = next(step for step in (3600, 60, 1) if s >= step or step == 1)
        expected[s] = f"{s / step:.1f}{spans[step]}"
    assert apply(spark, text.human_duration, seconds, "bigint") == expected


def test_human_age(spark):
    day = 86400
    cases = {
        0: "moments", 3600: "moments", 3601: "1 hour", 7200: "2 hours", day: "1 day",
        30 * day: "30 days", 31 * day: "1 month", 365 * day: "12 months", 366 * day: "1 year",
        800 * day: "2 years",
    }
    assert apply(spark, text.human_age, cases, "bigint") == cases


def test_ago_text(spark):
    cases = {
        0: "just now", 59: "just now", 60: "1 minutes ago", 3660: "1 hours, 1 minutes ago",
        90060: "1 days, 1 hours, 1 minutes ago",
    }
    assert apply(spark, text.ago_text, cases, "bigint") == cases


def test_parse_tag_date(spark):
    good = "2023-06-15 10:30:45"
    cases = {
        "2023-06-15T10:30:45.000000Z": good,
        "2023-06-15T10:30:45": good,
        "2023-06-15 10:30:45": good,
        "2023:06:15 10:30:45": good,
        "2023-06-15 10:30:45,25": good,
        "2023:06:15   9:30:45": "2023-06-15 09:30:45",
        "2023-07-01T00:30:00+02:00": "2023-07-01 00:30:00",
        "2024-01-31T23:30:00-05:00": "2024-01-31 23:30:00",
        "0000:01:01 00:00:00": "0000-01-01 00:00:00",
        "2023-06-15T10:30:45+0200": None, "2023-06-15T10:30:45+25:00": None,
        "2023": None, "2023-06-15": None, "0000:00:00 00:00:00": None,
        "2023:02:30 00:00:00": None, "2023-13-01 00:00:00": None, "": None,
        "2023-06-15 24:00:00": None, "2023-06-15 10:30:60": None,
        "2023-06-15 10:30:45Z": None, "2023-06-15 10:30:45\n": None, " 2023-06-15 10:30:45": None,
    }
    assert apply(spark, dates.parse_tag_date, cases) == cases
    only_colon = apply(spark, lambda c: dates.parse_tag_date(c, ("colon",)), cases)
    assert {v for v, wall in only_colon.items() if wall} == {
        "2023:06:15 10:30:45", "2023:06:15   9:30:45", "0000:01:01 00:00:00",
    }


def test_confidence_labels(spark):
    cases = {0: "none", 1: "low", 2: "medium", 3: "high", 4: "unknown"}
    assert apply(spark, dates.confidence_label, cases, "int") == cases


def test_extractors_by_extension(spark):
    exif, video, png = ["EXIF"], ["Video"], ["PNG"]
    cases = {
        ".jpg": exif, ".jpeg": exif, ".heic": exif, ".heif": exif, ".mp4": video, ".mov": video,
        ".mkv": video, ".webm": video, ".avi": video, ".png": png, ".txt": [], "": [],
    }
    expected = {ext: names + ["Filesystem"] for ext, names in cases.items()}
    assert apply(spark, dates.eligible_extractors, cases) == expected
