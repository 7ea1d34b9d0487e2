"""The record service: pushed filters, pruned pages, streams, repeated tasks and batches, parallel writers and claimers."""

import os
import threading

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from spindrift.sources import service as S

COLUMNS = "k long, name string, v double"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "service")


def rows(spark, lo, hi, parts=4):
    return spark.range(lo, hi, 1, parts).select(F.col("id").alias("k"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), (F.col("id") / 2).alias("v"))


def reader(spark, root):
    return spark.read.format(S.registered(spark)).option("path", root).option("columns", COLUMNS)


def write(df, root, mode="append", **options):
    df.write.format(S.registered(df.sparkSession)).option("path", root).options(**options).mode(mode).save()


def test_round_trip_and_pushdown(spark, root):
    write(rows(spark, 0, 1000), root)
    write(rows(spark, 1000, 1100), root)
    df = reader(spark, root).load()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, rows(spark, 0, 1100).collect()))
    few = df.where("k >= 990 and k < 1010 and name = 'n3'")
    assert sorted(r.k for r in few.collect()) == [k for k in range(990, 1010) if k % 7 == 3]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    assert few.rdd.getNumPartitions() == 2  # of eight pages those that can hold such rows
    assert df.where("name in ('n1', 'n2') and v > 10.5 and k is not null").count() == sum(1 for k in range(1100) if k % 7 in (1, 2) and k / 2 > 10.5)
    write(rows(spark, 5, 8), root, mode="overwrite")
    assert sorted(r.k for r in reader(spark, root).load().collect()) == [5, 6, 7]
    write(rows(spark, 0, 0), root, mode="overwrite")
    assert reader(spark, root).load().count() == 0 and reader(spark, root + "-none").load().count() == 0


def test_repeated_and_failed_tasks(spark, root, tmp_path):
    mark = str(tmp_path / "died")

    def once(batches):
        for b in batches:
            yield b
        if TaskContext.get().partitionId() == 1 and not os.path.exists(mark):
            open(mark, "w").close()
            S.staged(root, [b])  # as a task that dies after it has written
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        write(rows(spark, 0, 100).mapInArrow(once, COLUMNS), root)
    assert S.entries(root) == [] and reader(spark, root).load().count() == 0
    for _ in range(2):  # a job that is run again with its tag
        write(rows(spark, 0, 100).mapInArrow(once, COLUMNS), root, tag="job 7")
    assert sorted(r.k for r in reader(spark, root).load().collect()) == list(range(100))


def test_stream_in_and_out(spark, root, tmp_path):
    out, progress = root + "-out", str(tmp_path / "progress")

    def run():
        q = (spark.readStream.format(S.registered(spark)).option("path", root).option("columns", COLUMNS).load().where("k % 2 = 0")
             .writeStream.format(S.NAME).option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start())
        q.awaitTermination()

    write(rows(spark, 0, 50), root)
    run()
    write(rows(spark, 50, 80), root)
    run()
    run()
    assert sorted(r.k for r in reader(spark, out).load().collect()) == list(range(0, 80, 2))
    number = S.latest(out)
    files = S.entries(out)[-1]
    assert S.logged(out, [{"name": "pages/again", "extremes": {}}], tag=files["tag"]) == number == S.latest(out)  # a batch once more


def test_writers_and_claimers_at_once(root):
    numbers, won, lock = [], [], threading.Lock()

    def work(i):
        for j in range(5):
            n = S.logged(root, [{"name": f"{i}-{j}", "extremes": {}}])
            mine = S.claim(root, [f"chunk{(i + k) % 30:02d}" for k in range(30)], f"w{i}", tries=30)
            with lock:
                numbers.append(n)
                won.append(mine)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(numbers) == list(range(40)) and len(S.current(S.entries(root))) == 40
    got = [w for w in won if w]
    assert len(got) == len(set(got)) == 30 and set(S.claims(root)) == set(got)
    assert S.claim(root, [f"chunk{k:02d}" for k in range(30)], "late") is None


def test_locks_go_on_after_a_restart(spark, tmp_path):
    import random

    from spindrift.sources.scratch import Scratch
    from spindrift.streaming import jobs

    rng = random.Random(4)
    base = 1_700_000_000_000
    asks = [(i, "ab"[rng.randrange(2)], base + rng.randrange(20) * 1000 + i * 9_000) for i in range(60)]
    asks.sort(key=lambda a: a[2])
    schema = "id long, user string, ms long"
    stamp = lambda part: spark.createDataFrame(part, schema).select("id", "user", F.timestamp_millis("ms").alias("t")).coalesce(1)
    scratch, folder = Scratch(spark), str(tmp_path / "asks")
    for part in (asks[:35], asks[35:]):  # the second run begins with what the first one kept
        stamp(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("id long, user string, t timestamp").parquet(folder)
        got = jobs.run_available(jobs.lock_grants(stream, "user", "id", "t", 30_000, "500 milliseconds"), spark, "append", scratch=scratch)
        beats = jobs.run_available(jobs.beat_upserts(stream, "user", "t"), spark, "update", "key", scratch=Scratch(spark))
    want = set()
    for user in "ab":
        free, own = 0, [a for a in asks if a[1] == user]
        for i, _, at in own:
            free = max(free, at)
            if free <= max(own[-1][2], asks[-1][2] - 501):
                want.add((user, i, at, free))
            free += 30_000
    assert {tuple(r) for r in got.collect()} == want and any(g > a for _, _, a, g in want)
    assert {tuple(r) for r in beats.collect()} == {(u, max(a[2] for a in asks if a[1] == u)) for u in "ab"}
