"""Scalar functions on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import scalars as X
from spindrift.functions import values as V


def one(spark, f, kind, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_durations(spark):
    assert one(spark, X.iso_seconds, "string", "PT1M30S", "PT2H", "PT", "", None, "P1D", "PT1H2M3S", "PT99999999999S") == [90, 7200, 0, 0, 0, 0, 3723, 0]
    assert one(spark, X.clock, "long", 0, 59_499, 59_500, 3_599_500) == ["0:00", "0:59", "1:00", "60:00"]


def test_rounding(spark):
    assert one(spark, X.half_up, "double", -2.5, 2.5, -0.5, 0.49, None) == [-2, 3, 0, 0, None]
    assert one(spark, X.clamp10, "double", -1.0, 11.5, 2.5, None) == [0, 10, 3, 0]
    assert one(spark, X.snap16, "double", 7.0, 8.0, 24.0, -8.0) == [0, 16, 32, 0]


def test_compact(spark):
    assert one(spark, X.compact, "double", 9_999.0, 10_000.0, 15_500.0, 99_999_999.0, 123_450_000.0, None) == ["9,999", "1만", "1.6만", "10000만", "1.2억", "0"]
    assert one(spark, lambda c: X.compact(c, True), "double", 999.0, 1000.0, 1500.0) == ["999", "1천", "1.5천"]
    assert one(spark, X.won, "double", 150_000_000.0, 15_000.0, 20_500_000.0, 900.4) == ["1.5억원", "2만원", "2,050만원", "900원"]


def test_grades_and_types(spark):
    assert one(spark, X.grade, "long", None, 0, 99_999, 100_000, 300_000, 1_000_000, 5_000_000) == ["", "D", "D", "C", "B", "A", "S"]
    assert one(spark, X.channel_type, "double", None, 0.2, 0.21, 0.8) == [V.NONE, V.LONG, V.MIXED, V.SHORT]
    assert one(spark, lambda c: X.revenue(c, F.lit(V.LONG)), "double", None, 0.0, -1.0, 100.0) == [None, None, None, 250.0]


def test_texts(spark):
    assert one(spark, X.category, "string", None, "", "기타/혼합", "lol 하이라이트", "해외 반응", "축구 게임", "xyz") == [None, None, None, "게임", "국뽕·해외반응", "게임", None]
    assert one(spark, X.unescape_html, "string", "&amp;lt;", "a &amp; b", None) == ["&lt;", "a & b", None]
    assert one(spark, X.escape_html, "string", "<&>") == ["&lt;&amp;&gt;"]
    assert one(spark, X.tidy, "string", "  a \n b ", None) == ["a b", None]
    assert one(spark, X.wrapped, "string", "aa bb cc dd ee", "", "averyveryverylongword x", None) == ["aa bb cc dd\nee", "", "averyveryverylongword\nx", None]
    assert one(spark, X.letters_only, "string", "a-1 가!", "") == ["a1가", ""]
    assert one(spark, X.percent_encoded, "string", "a b+c") == ["a%20b%2Bc"]
    assert one(spark, X.handle, "string", "x", "@x") == ["@x", "@x"]
    assert one(spark, X.frame_rate, "string", "30000/1001", "25", "0/0", "240", None) == [pytest.approx(29.97, abs=0.01), 25.0, 30.0, 30.0, 30.0]
    assert one(spark, X.extension, "string", "a.MP4", "b", "c.tar.gz") == ["mp4", "mp4", "gz"]
    assert one(spark, X.json_between_braces, "string", 'x {"a":{"b":1}} y', "none") == ['{"a":{"b":1}}', None]


def test_addresses(spark):
    assert one(spark, X.video_id, "string", "https://youtu.be/abcdefghijk?t=1", "abcdefghijk", "https://www.youtube.com/shorts/ABCDEFGHIJ_", "no") == ["abcdefghijk", "abcdefghijk", "ABCDEFGHIJ_", None]
    assert one(spark, X.host, "string", "https://www.a.b/c", "bad", None) == ["a.b", None, None]
    assert one(spark, X.is_listing, "string", "https://www.tiktok.com/@a/video/12", "https://tiktok.com/@a", "https://vm.tiktok.com/Z1", "https://reddit.com/r/x/", "https://reddit.com/r/x/comments", None) == [False, True, False, True, False, False]
    assert one(spark, X.is_video_site, "string", "https://b23.tv/x", "https://news.x", None) == [True, False, False]
    assert one(spark, lambda c: X.platform(F.lit(""), c), "string", "https://v.douyin.com/1", "https://baike.baidu.com", "https://www.z.org/a", "??") == ["더우인", "바이두", "z.org", V.NO_PLATFORM]


def test_clocks(spark):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 14:59:59' t UNION ALL SELECT timestamp_ntz'2024-01-01 15:00:00'")
    got = [(str(r.d), str(r.s)) for r in rows.select(X.local_date(F.col("t")).alias("d"), X.local_day_start(F.col("t")).alias("s")).collect()]
    assert got == [("2024-01-01", "2023-12-31 15:00:00"), ("2024-01-02", "2024-01-01 15:00:00")]


def test_bits_and_boxes(spark):
    row = spark.sql("SELECT transform(sequence(1, 64), i -> CASE WHEN i IN (1, 3, 64) THEN 1.0F ELSE -1.0F END) v, transform(sequence(0, 71), i -> cast(-i AS double)) g")
    got = row.select(X.sign_bits(F.col("v")).alias("b"), X.difference_hash(F.col("g")).alias("h")).first()
    assert got.b == 5 - (1 << 63) and got.h == -1
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(F.lit, v)))
    assert spark.range(1).select(X.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), X.iou(box(0, 0, 1, 1), box(1, 0, 2, 1)).alias("b")).first() == (pytest.approx(1 / 7), 0.0)
