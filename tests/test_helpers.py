"""Helpers that no query uses: batched look-ups, clocks, page numbers, kernels on media columns, streams on liveness."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import external as E
from spindrift.functions import imaging as G
from spindrift.functions import scalars as X
from spindrift.operators import relational as R
from spindrift.operators import similarity as M
from spindrift.sources import tables
from spindrift.streaming import jobs


def test_batches_hold_so_many_rows(spark):
    df = spark.range(0, 230, 1, 3)
    got = M.in_batches(df, lambda pdf: pd.DataFrame({"n": [len(pdf)], "first": [int(pdf["id"].iloc[0])]}), "n long, first long", 50).collect()
    assert sum(r.n for r in got) == 230 and max(r.n for r in got) == 50 and len({r["first"] for r in got}) == len(got)


def test_first_of_ordered_sources(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None)], "k string, o int, v string")
    assert {r.k: r.v for r in R.first_by(df, ["k"], [F.col("o")]).collect()} == {"a": "x", "b": None}


def test_numbers_days_and_pages(spark):
    row = spark.range(1).select(
        X.numbers_after(F.lit("pts_time:1.5 x pts_time=-2 pts_time:z"), "pts_time").alias("a"), R.pages(F.lit(0), 50).alias("b"), R.pages(F.lit(101), 50).alias("c")).first()
    assert row.a == [1.5, -2.0] and (row.b, row.c) == (1, 3)
    days = spark.createDataFrame([("2024-01-03 11:00:00", "2024-01-01 00:00:00")], "a string, b string").select(F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b"))
    row = days.select(X.days_between(F.col("a"), F.col("b")).alias("r"), X.days_between(F.col("a"), F.col("b"), False).alias("f"), X.warnings(short=F.lit(True), tall=F.lit(False), odd=F.lit(None).cast("boolean")).alias("w")).first()
    assert (row.r, row.f, row.w) == (2, 2, ["short"])


def test_media_columns(spark):
    samples = np.array([0, 16384, -32768], "<i2")
    mask = np.zeros((5, 6), np.uint8)
    mask[2, 3] = 255
    frame, restored = np.full((2, 2, 3), 100, np.uint8), np.full((2, 2, 3), 200, np.uint8)
    alpha = np.array([[0, 255], [51, 0]], np.uint8)
    df = spark.createDataFrame([(bytearray(b"\0" * 44 + samples.tobytes() + b"x"), bytearray(mask.tobytes()), bytearray(frame.tobytes()), bytearray(restored.tobytes()), bytearray(alpha.tobytes()))], "w binary, m binary, f binary, r binary, a binary")
    row = df.select(G.samples_udf("w").alias("s"), G.dilate_udf("m", F.lit(5), F.lit(6), F.lit(1)).alias("d"), G.blend_udf("f", "r", "a", F.lit(2), F.lit(2)).alias("b")).first()
    assert row.s == [0.0, 0.5, -1.0]
    grown = np.frombuffer(row.d, np.uint8).reshape(5, 6)
    assert (grown[1:4, 2:5] == 255).all() and grown.sum() == 9 * 255
    assert np.frombuffer(row.b, np.uint8).reshape(2, 2, 3)[..., 0].tolist() == [[100, 200], [120, 100]]


def test_glyph_lines_of_frames(spark):
    frame = np.full((120, 400, 3), 20, np.uint8)
    for x in range(100, 280, 40):
        frame[40:70, x : x + 20] = 250
    blank = np.full((120, 400, 3), 20, np.uint8)
    df = spark.createDataFrame([(1, bytearray(frame.tobytes())), (2, bytearray(blank.tobytes()))], "k int, rgb binary")
    got = {r.k: r.lines for r in df.select("k", G.text_lines_udf("rgb", F.lit(120), F.lit(400)).alias("lines")).collect()}
    assert len(got[1]) == 1 and (got[1][0].x0, got[1][0].y0, got[1][0].y1) == (100, 40, 69) and got[2] == []


def test_hues_and_zones():
    colours = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [9, 9, 9], [255, 255, 0]]], np.uint8)
    assert G.hues(colours).tolist() == [[0, 60, 120, 0, 30]]
    frame = np.zeros((40, 40, 3), np.uint8)
    frame[:, :20] = (0, 0, 255)
    mask = G.zone_fill(frame, (0, 0, 39, 39), 118)
    assert mask.sum() == 800 * 255 and G.zone_fill(frame, (0, 0, 39, 39), 60) is None and G.zone_fill(frame, (0, 0, 1, 1), 118) is None


def test_tables_are_appended_and_written_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tables.append(df, str(tmp_path / "t"))
    tables.append(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    tables.artifact(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"v":"a"}', '{"k":2}']


def test_liveness_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:20"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "k string, at string").select("k", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.parquet(str(tmp_path / "beats"))
    stream = lambda: spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "beats"))
    last = jobs.run_available(jobs.latest_beats(stream(), ["k"], "at"), spark)
    assert {r.k: str(r["at"]) for r in last.collect()} == {"a": "2024-01-01 00:00:20", "b": "2024-01-01 00:00:00", "c": "2024-01-01 00:20:00"}
    alarms = jobs.run_available(jobs.stall_alarms(stream(), "k", "at"), spark, "append")
    assert {r.key for r in alarms.collect()} == {"a", "b"}


def test_jobs_are_polled_and_calls_repeated():
    slept, clock, states = [], [0.0], {"a": iter([("queued", None), ("completed", "A")]), "b": iter([("error", "broken")] * 9), "c": iter([("queued", None)] * 999)}

    def sleep(s):
        slept.append(s)
        clock[0] += s

    model = E.polled(lambda p: p, lambda job: next(states[job]), sleep=sleep, now=lambda: clock[0])
    assert model(["a"]) == ["A"] and slept == [3.0, 3.0]
    with pytest.raises(RuntimeError, match="broken"):
        model(["b"])
    with pytest.raises(TimeoutError):
        model(["c"])
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return ["ok"]

    slept.clear()
    assert E.retried(flaky, 4, 3.0, 3.0, sleep)(["x"]) == ["ok"] and slept == [3.0, 9.0]
    with pytest.raises(OSError):
        calls.clear()
        E.retried(flaky, 2, 8.0, sleep=sleep)(["x"])
