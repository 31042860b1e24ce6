"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.identity import content_identifier, digest, human_readable, media_type, stem, usable, uuid_name
from lumenfold.functions.unicode import collision_key


def one(spark, values, function, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    cols = [F.col(c) for c in df.columns[1:]]
    return [r.x for r in df.select("i", function(*cols).alias("x")).orderBy("i").collect()]


def test_identity(spark):
    d = "ab" * 32
    assert one(spark, [d, f" SHA256:{d.upper()}\n", f"sha-256={d}", f"0x{d}", "", None, "xyz", d[:-1]], digest) == [d, d, d, d, None, None, None, None]
    assert one(spark, [" {ABC-1} ", "\x00{}\x00", "", None, "abc"], content_identifier) == ["abc-1", None, None, None, "abc"]
    assert one(spark, ["Canon", "N/A", "--", "?", " ", None, "Unknown  make", "(null)", "X-7"], usable) == [True] + [False] * 7 + [True]
    assert one(spark, [("IMAGE", ".mov"), (None, ".MOV"), ("", ".jpg"), ("doc", ".ts"), (None, None)], media_type, "a string, b string") == ["image", "video", "image", "video", "image"]
    assert one(spark, ["a.b.jpg", ".hidden", "name.", "plain", ".a.b"], stem) == ["a.b", ".hidden", "name.", "plain", ".a"]
    names = ["d1e3f440-1dc7-40b9-a4fa-86bdb83463fa.jpg", "d1e3f440-1dc7-70b9-a4fa-86bdb83463fa.jpg", "2019.jpg", "方.jpg"]
    assert one(spark, names, uuid_name) == [True, False, False, False]
    assert one(spark, names, human_readable) == [False, True, False, True]


def test_paths(spark):
    assert one(spark, ["/a/b.jpg", "b", "/b", None], T.path_parent) == ["/a", "", "", None]
    assert one(spark, ["x.JPG", ".x", "x.", "a.b.c"], T.path_suffix) == [".JPG", "", "", ".c"]
    assert one(spark, ["IMG_E123", "img_123", "IMG_E12x"], T.normalised_stem) == ["img_123", "img_123", "img_e12x"]
    assert one(spark, ["a/b", "/a", "a/../b", "a/..", "./a", "a//b"], T.safe_relative) == [True] + [False] * 5
    assert one(spark, [("/a/b", "/a/b"), ("/a/b", "/a/c"), ("/a/b", "/c/b")], T.nearby, "a string, b string") == [True, True, False]
    assert one(spark, ["a/b\\c\x07.jpg", "  ", "..", "x" * 40 + ".jpeg"], lambda c: T.sanitise_component(c, 20)) == ["a_b_c.jpg", "unnamed", "unnamed", "x" * 15 + ".jpeg"]
    assert one(spark, ["photo.jpg", "x" * 30 + ".jpg"], lambda c: T.disambiguate(c, F.lit(7), 20)) == ["photo__a7.jpg", "x" * 12 + "__a7.jpg"]
    assert one(spark, ["photo.jpg"], lambda c: T.disambiguate(c, F.lit(7), 8)) == [None]
    assert one(spark, ["a.jpg"], lambda c: T.import_name(c, F.lit(42), F.lit(2))) == ["a__import_00000042_1_1.jpg"]
    assert one(spark, ["Straße", "é", None, "ﬀ"], collision_key) == ["strasse", "é", None, "ff"]


def test_evidence_and_formats(spark):
    ev = ["a=1;b=2;a=3", "b=x", "", None, "xa=5"]
    assert one(spark, ev, lambda c: T.evidence_value(c, "a")) == ["1", None, None, None, None]
    sizes = [0, 1023, 1024, 1536, 4 * 1024**4]
    assert one(spark, sizes, T.format_bytes, "v long") == ["0 B", "1023 B", "1.00 KiB", "1.50 KiB", "4.00 TiB"]
    assert one(spark, [12, 65, 13320, -5], T.format_duration, "v long") == ["12s", "1m 05s", "3h 42m", "0s"]
    rates = one(spark, ["30000/1001", "0/0", "25", "x", "1/2/3", None], T.frame_rate)
    assert rates[0] == pytest.approx(29.97003, abs=1e-4) and rates[1:] == [None, 25.0, None, None, None]


def test_gps(spark):
    f = lambda d, m, s, h: T.gps_degrees(d, m, s, h, 180.0)
    got = one(spark, [(40.0, 30.0, 0.0, "N"), (73.0, 59.0, 0.0, "W"), (73.0, 61.0, 0.0, "W"), (200.0, 0.0, 0.0, "E"), (None, 0.0, 0.0, "E")], f, "d double, m double, s double, h string")
    assert got[0] == 40.5 and got[1] < 0 and got[2:] == [None, None, None]


CASES = [
    ("2020-01-01T12:00:00+06:00", "2020-01-01T06:00:00Z", "exact_within_3_seconds"),
    ("2020-01-01T12:00:00", "2020-01-01T12:00:03", "exact_within_3_seconds"),
    ("2020-01-01T12:00:00", "2020-01-01T12:00:00Z", "same_wall_clock_within_3_seconds"),
    ("2020-01-01T12:00:00", "2020-01-01T06:00:00Z", "timezone_offset_compatible"),
    ("2020:01:01 12:00:00", "2020-01-01T12:00:04", "incompatible"),
    ("2020-01-01T12:00:00", "2020-01-02T12:00:00Z", "incompatible"),
    (None, "2020-01-01T06:00:00Z", "unavailable"), ("not-a-date", "2020-01-01T06:00:00Z", "unavailable"),
    ("2020-02-30T12:00:00", "2020-01-01T06:00:00Z", "unavailable"),
]


def test_timestamp_classes(spark):
    f = lambda a, b: T.timestamp_class(T.wall_and_offset(a), T.wall_and_offset(b))
    assert one(spark, [c[:2] for c in CASES], f, "a string, b string") == [c[2] for c in CASES]
