"""Rules, feeds and folds on small tables: nulls, ties, empties."""

import random

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import rules as L
from spindrift.operators import relational as R
from spindrift.operators import sequences as Q
from spindrift.operators import similarity as M
from spindrift.operators import state as S
from spindrift.sources import feeds


def test_running_totals_and_medians(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), rng.randrange(6), i) for i in range(200)] + [("c", None, 900), (None, 3, 901)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = {r.id: r.before for r in R.running(df, ["g"], [F.col("v"), F.col("id")], {"id": "before"}).collect()}
    for g in {r[0] for r in rows}:
        total = 0
        for _, _, i in sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            assert got[i] == total
            total += i
    medians = {r.g: (r.median, r.n) for r in R.upper_medians(df, ["g"], "v").collect()}
    for g in "ab":
        v = sorted(r[1] for r in rows if r[0] == g)
        assert medians[g] == (v[len(v) // 2], len(v))
    pct = {r.id: r.pct for r in R.percentile_ranks(df.where("g = 'a'"), ["g"], "v").collect()}
    a = [r for r in rows if r[0] == "a"]
    assert all(abs(pct[i] - sum(x[1] <= v for x in a) / len(a)) < 1e-12 for _, v, i in a)
    assert sorted(r.rank for r in R.ranked(df, [F.col("v"), F.col("id")]).collect()) == list(range(1, len(rows) + 1))
    assert R.upper_medians(df.limit(0), ["g"], "v").count() == 0


def test_keep_first_by_hand(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), i, rng.getrandbits(12)) for i in range(150)] + [("x", 500, None)]
    df = spark.createDataFrame(rows, "g string, id int, h long")
    kept = {"x": [], "y": []}
    for g, i, h in rows:
        if h is None or all(bin(h ^ k).count("1") > 2 for _, k in kept[g] if k is not None):
            kept[g].append((i, h))
    assert sorted(r.id for r in M.keep_first(df, ["g"], "id", "h", 2, 12).collect()) == sorted(i for v in kept.values() for i, _ in v)
    assert M.keep_first(df.limit(0), ["g"], "id", "h", 2, 12).count() == 0


def test_support_forms_agree(spark):
    rng = random.Random(5)
    rows = list({(rng.choice("ab"), rng.randrange(40), rng.randrange(3)) for _ in range(150)})
    df = spark.createDataFrame(rows, "g string, f int, k int")
    one = {tuple(r) for r in Q.support(df, ["g"], "f", equal=["k"], reach=4, least=3).collect()}
    assert one == {tuple(r) for r in Q.support(df, ["g"], "f", lambda a, b: a("k") == b("k"), reach=4, least=3).collect()} and one


def test_tail_chunks(spark):
    got = {n: [tuple(c) for c in spark.range(1).select(Q.tail_chunks(F.lit(n)).alias("c")).first().c] for n in (1, 401, 402, 790, 791, 1200)}
    assert got[1] == [(0, 0, 0)] and got[401] == [(0, 0, 400)] and got[402] == [(0, 0, 400), (1, 1, 401)]
    assert got[790] == [(0, 0, 400), (1, 389, 789)] and [c[2] for c in got[791]] == [400, 789, 790] and got[1200][-1][2] == 1199


def test_shots_are_capped(spark):
    df = spark.createDataFrame([("g", float(3 * i), 3000.0) for i in range(1, 1000)], "g string, at double, d double")
    assert Q.shots(df, ["g"], "at", "d").count() == 600 and Q.shots(df, ["g"], "at", "d", cap=7).count() == 7


def test_rules(spark):
    row = spark.range(1).select(
        L.probe(F.lit(200)).alias("a"), L.probe(F.lit(301)).alias("b"), L.probe(F.lit(None).cast("int")).alias("c"), L.trending_short(F.lit(None).cast("boolean"), F.lit(61)).alias("d"),
        L.eta_text(F.lit(0)).alias("e"), L.eta_text(F.lit(3600)).alias("f"), L.length_bar(F.lit(0), F.lit(5)).alias("g"), L.medal(F.lit(2)).alias("h"), L.medal(F.lit(11)).alias("i"),
        L.not_itself(F.lit("x/abc"), F.lit("")).alias("j"), L.progress(F.lit(5.0), F.lit(1.0)).alias("k"), L.same_letters(F.lit("!!"), F.lit("a")).alias("l")).first()
    assert tuple(row) == (True, False, None, False, "", "약 1시간~2시간", 100, "🥈 2위", "11위", True, 99, False)
    jobs = spark.createDataFrame([("probe", "desilence", False, 0), ("probe", "", False, 0), ("probe", "", True, 0), ("transcribe", "", True, 9), ("transcribe", "", True, 10)], "d string, o string, a boolean, s int")
    assert [r[0] for r in jobs.select(S.next_job(F.col("d"), F.col("o"), F.col("a"), F.col("s"))).collect()] == ["desilence", None, "transcribe", None, "analyze"]


def test_feeds_of_bad_answers(spark):
    df = spark.createDataFrame([(1, '{"items":[{"id":"a","title":"x"},{"id":"b"}]}'), (2, "no json"), (3, None), (4, '{"items":[]}')], "k int, body string")
    assert [tuple(r) for r in feeds.items(df, "k", "body", "id string, title string").collect()] == [(1, 0, "a", "x"), (1, 1, "b", None)]
    assert feeds.kinds(df, "k", "body", ["full"]).count() == 0
    facts = spark.createDataFrame([('{"streams":[],"format":{}}',), ("x",), ('{"streams":[{"codec_type":"video","width":4,"height":2,"r_frame_rate":"0/0"}],"format":{"duration":"1.5"}}',)], "b string")
    got = [tuple(r.f) for r in facts.select(feeds.media_facts(F.col("b")).alias("f")).collect()]
    assert got[0][1:4] == (None, None, 0.0) and got[2] == (30.0, 4, 2, 1.5, False)


def test_frames_and_regions(spark):
    raw = np.arange(2 * 3 * 4, dtype=np.uint8)
    clips = spark.createDataFrame([(1, bytearray(raw.tobytes() + b"cut")), (2, bytearray(b"short")), (3, None)], "c int, raw binary")
    out = feeds.regions(feeds.frames(clips, "c", "raw", 4, 3), 4, {0: (1, 1, 2, 2)}).collect()
    assert [(r.c, r.frame, list(r.pixels)) for r in out] == [(1, f, raw.reshape(2, 3, 4)[f, 1:3, 1:3].ravel().tolist()) for f in (0, 1)]


def test_claims_and_gates(spark):
    chunks = spark.createDataFrame([("p", 3, "todo"), ("p", 1, "done"), ("p", 2, "todo"), ("q", 1, "todo")], "p string, c int, status string")
    workers = spark.createDataFrame([("p", "w1"), ("p", "w2"), ("p", "w3"), ("q", "w4")], "p string, w string")
    assert {tuple(r) for r in S.claimed(chunks, workers, ["p"], "c", "w").collect()} == {("p", "w1", 2), ("p", "w2", 3), ("q", "w4", 1)}
    requests = spark.createDataFrame([("a", None), ("b", False), ("c", True), ("d", False)], "f string, admin boolean")
    flags = spark.createDataFrame([("a", True), ("b", None)], "f string, is_public boolean")
    assert {r.f: r.allowed for r in R.gated(requests, flags, "f", "admin").collect()} == {"a": True, "b": False, "c": True, "d": False}
