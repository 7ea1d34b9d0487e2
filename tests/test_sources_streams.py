"""Sources, sinks, streams, model calls and kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import external as E
from spindrift.functions import imaging as G
from spindrift.sources import tables as K
from spindrift.streaming import jobs


def test_tables(spark, tmp_path):
    assert K.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    K.replace_partitions(df, str(tmp_path / "t"), "k")
    K.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), str(tmp_path / "t"), "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "a"), (2, "c")]
    assert K.one_row(df.where("k = 1")).v == "a" and K.one_row(df.where("k = 9")) is None
    with pytest.raises(ValueError):
        K.one_row(df)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.jpg").write_bytes(b"abc")
    assert K.media(spark, str(tmp_path / "m")).first().content == "YWJj"
    got = K.parsed(spark.createDataFrame([('{"a":1}',), ("{bad",)], "j string"), "j", "a int").collect()
    assert got[0].value.a == 1 and got[0].error is None and got[1].error == "{bad"
    assert K.digest(spark.createDataFrame([("b", 2), ("a", 1)], "name string, n long")).first().report == "a: 1\nb: 2"


def test_paged_source(spark):
    def fetch(key, token):
        page = int(token or 0)
        return [(f"{key}{page}", page)], (str(page + 1) if page < 5 else None)

    spark.dataSource.register(K.paged_source("test_pages", "k string, id string, page int", fetch, ["a", "b"], 2))
    assert sorted(r.id for r in spark.read.format("test_pages").load().collect()) == ["a0", "a1", "b0", "b1"]


def events(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "id long, user string, t string").withColumn("t", F.to_timestamp("t"))
    for i, part in enumerate(df.randomSplit([1.0, 1.0], 1)):
        part.write.mode("append").parquet(str(tmp_path / "e"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))


ROWS = [(i, "ab"[i % 2], f"2024-01-0{1 + i // 6} {10 + i:02d}:{i:02d}:00") for i in range(12)]


def test_streaming_usage_equals_batch(spark, tmp_path):
    got = jobs.run_available(jobs.daily_usage(events(spark, tmp_path, ROWS), "t", "user", hours=9), spark)
    batch = spark.read.parquet(str(tmp_path / "e")).groupBy(F.to_date(F.col("t") + F.expr("INTERVAL 9 HOURS")).alias("day"), F.col("user").alias("key")).agg(F.count(F.lit(1)).alias("used"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_streaming_admission(spark, tmp_path):
    got = jobs.run_available(jobs.admitted(events(spark, tmp_path, ROWS), "user", "t", "id", 2), spark, "append").collect()
    assert len(got) == 12 and sum(r.admitted for r in got) == 8


def test_streaming_locks(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 10:00:00"), (2, "a", "2024-01-01 10:00:30"), (3, "b", "2024-01-01 10:00:10")]
    assert jobs.run_available(jobs.once_per_key(events(spark, tmp_path, rows), "user", "t"), spark, "append").count() == 2


def test_salvage():
    assert E.salvaged('```json\n{"a": 1}\n```') == {"a": 1}
    assert E.salvaged('[{"a": 1}, {"b": 2}, {"c": ') == [{"a": 1}, {"b": 2}]
    assert E.salvaged('so: {"a": 1} done') == {"a": 1}
    assert E.salvaged("none") is None and E.salvaged(None) is None and E.salvaged("[1, 2") is None


def test_model_calls(spark):
    class Busy(Exception):
        code = 503

    def down(_):
        raise Busy

    assert E.with_fallback([down, E.stub])(["x"]) == E.stub(["x"])
    with pytest.raises(Busy):
        E.with_fallback([down])(["x"])
    df = spark.createDataFrame([(i, f"channel {i}") for i in range(40)], "id int, name string")
    got = E.classified(E.asked(df, F.col("name"))).collect()
    assert all(not r.faceless for r in got if r.confidence == "하") and {r.confidence for r in got} <= {"상", "중", "하"}
    again = E.recategorised(E.asked(df.withColumn("category", F.lit("게임")), F.col("name"))).collect()
    assert all((r.category != "게임") == r.changed for r in again)
    ranking = spark.createDataFrame([(3, 1, "A", "x"), (99, 2, "B", "y")], "id int, place int, grade string, reason string")
    assert [r.id for r in E.ranked_or_first(df, ranking, "id", "id").collect()] == [3]
    assert [r.grade for r in E.ranked_or_first(df, ranking.where("id = 99"), "id", "id").collect()] == ["참고"] * 5


def test_masks():
    rng = np.random.default_rng(0)
    m = (rng.random((5, 7, 9)) < 0.3).astype(np.uint8) * 255
    assert np.array_equal(G.unpacked(G.packed(m)), m)
    import zlib

    old = zlib.compress(np.array(m.shape, ">u4").tobytes() + np.packbits(m > 0).tobytes())
    assert np.array_equal(G.unpacked(old), m)
    for r in (0, 1, 3):
        want = np.zeros(m[0].shape, bool)
        for y, x in zip(*np.nonzero(m[0])):
            want[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
        assert np.array_equal(G.dilated(m[0] > 0, r), want)
    steady = G.steady(m, 1)
    assert np.array_equal(steady[2] > 0, (m[1:4] > 0).any(axis=0))


def test_components_and_lines():
    m = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)
    labels = G.components(m)
    assert labels.max() == 3 and labels[0, 0] == labels[0, 2] and labels[4, 0] != labels[4, 2]
    frame = np.full((120, 400, 3), 128, np.uint8)
    for k in range(5):
        x = 60 + 40 * k
        frame[40:70, x - 2 : x + 22] = 0
        frame[44:66, x + 2 : x + 18] = 255
    (line,) = G.text_lines(G.glyphs(frame), 400)
    assert (line["y0"], line["y1"], line["x0"], line["x1"]) == (44, 65, 62, 237)
    assert G.rasterised([line], 120, 400).sum() == 255 * 22 * 176


def test_static_pattern_and_blend():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (8, 80, 120)).astype(np.uint8)
    grey[:, 30:40, 30:44] = np.where(np.add.outer(np.arange(10), np.arange(14)) % 2, 200, 100)
    got = G.static_pattern(grey)
    assert got is not None and got[35, 37] == 255 and got[0, 0] == 0 and G.static_pattern(grey[:5]) is None
    f, r = np.zeros((2, 2, 3), np.uint8), np.full((2, 2, 3), 200, np.uint8)
    assert G.blended(f, r, np.array([[0, 255], [128, 0]], np.uint8))[:, :, 0].tolist() == [[0, 200], [100, 0]]


def test_a_file_for_each_row(spark, tmp_path):
    """Suppliers that share a key, or have none, have files of their own; files lie in folders of tasks, not in one each."""
    import base64

    from spindrift.plans import kernels

    rows = [(i % 90, f"s{i}") for i in range(100)] + [(None, "no key"), (-7, "x")]
    spark.createDataFrame(rows, "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = kernels.media_files(spark, str(tmp_path)).collect()
    assert sorted((r.s_suppkey or 0, r.content, r.length) for r in got) == sorted((k or 0, base64.b64encode(f"{n}\n".encode()).decode(), len(n) + 1) for k, n in rows)
    assert sum(r.s_suppkey is None for r in got) == 1
