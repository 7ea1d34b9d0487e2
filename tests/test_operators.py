"""Operators against independent sequential renderings on random inputs."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import relational as R
from spindrift.operators import sequences as Q
from spindrift.operators import similarity as M
from spindrift.operators import state as S


def test_kept_ranges(spark):
    rng = random.Random(1)
    groups = {}
    for g in range(40):
        at, out = 0.0, []
        for _ in range(rng.randrange(0, 6)):
            at += rng.choice([0.0, 0.4, 3.0])
            end = at + rng.choice([0.1, 0.34, 0.5, 2.0])
            out.append((at, end))
            at = end
        groups[g] = (out, at + rng.choice([0.0, 1.0, 5.0]))
    rows = [(g, s, e, d) for g, (xs, d) in groups.items() for s, e in (xs or [(None, None)])]
    got = {}
    for r in Q.kept_ranges(spark.createDataFrame(rows, "g int, start double, end double, d double"), ["g"], "d", pad=0.15).collect():
        got.setdefault(r.g, []).append((round(r.start, 6), round(r.end, 6)))
    for g, (xs, d) in groups.items():
        cuts = [(s + 0.15, e - 0.15) for s, e in xs if e - s - 0.3 > 0.05]
        pos, want = 0.0, []
        for s, e in cuts:
            if s > pos:
                want.append((round(pos, 6), round(s, 6)))
            pos = e
        if pos < d:
            want.append((round(pos, 6), round(d, 6)))
        assert got.get(g, []) == want, g


def test_silence_events(spark):
    df = spark.createDataFrame([("silence_start: 1.5\nx silence_end: 2.25 | silence_start: 9",), ("silence_end: 3",), ("",)], "t string")
    got = [[tuple(x) for x in r.o] for r in df.select(Q.silence_events(F.col("t"), F.lit(10.0)).alias("o")).collect()]
    assert got == [[(1.5, 2.25), (9.0, 10.0)], [], []]


def test_hysteresis(spark):
    rng = random.Random(7)
    window, silence, speech, pad = 512, 1600, 1100, 320
    groups = {g: [rng.choice([0.1, 0.2, 0.3, 0.4, 0.45, 0.6, 0.9]) for _ in range(rng.randrange(1, 40))] for g in range(150)}
    rows = [(g, i, p, len(ps) * window) for g, ps in groups.items() for i, p in enumerate(ps)]
    got = {}
    for r in Q.hysteresis(spark.createDataFrame(rows, "g int, i int, p double, n int"), ["g"], "i", "p", 0.5, 0.35, window, silence, speech, pad, "n").collect():
        got.setdefault(r.g, []).append((r.s, r.e))
    for g, ps in groups.items():
        segments, begin, low = [], None, None
        for i, p in enumerate(ps):
            s = i * window
            if p >= 0.5:
                low = None
                begin = s if begin is None else begin
            elif p < 0.35 and begin is not None:
                low = s if low is None else low
                if s - low >= silence:
                    segments.append((begin, low))
                    begin = low = None
        if begin is not None:
            segments.append((begin, len(ps) * window))
        want = []
        for a, b in segments:
            if b - a >= speech:
                a, b = max(0, a - pad), min(len(ps) * window, b + pad)
                if want and a <= want[-1][1]:
                    want[-1] = (want[-1][0], b)
                else:
                    want.append((a, b))
        assert sorted(got.get(g, [])) == want, (g, ps)


def test_greedy_budget(spark):
    rng = random.Random(3)
    groups = {g: [(k, rng.random(), rng.uniform(2, 30)) for k in range(rng.randrange(1, 15))] for g in range(60)}
    rows = [(g, *x) for g, xs in groups.items() for x in xs]
    got = {}
    for r in Q.greedy_budget(spark.createDataFrame(rows, "g int, k int, score double, d double"), ["g"], "score", "d", "k").collect():
        got.setdefault(r.g, []).append(r.k)
    for g, xs in groups.items():
        picked, total = [], 0.0
        for k, _, d in sorted(xs, key=lambda x: -x[1]):
            if total + d <= 65:
                picked.append(k)
                total += d
                if total >= 50 or len(picked) >= 8:
                    break
        assert sorted(got.get(g, [])) == (sorted(picked) if len(picked) >= 3 and total >= 25 else [])


def test_balanced(spark):
    rng = random.Random(5)
    tasks = [(0, k, float(rng.randrange(1, 9))) for k in range(30)]
    got = {r.k: r.part for r in Q.balanced(spark.createDataFrame(tasks, "g int, k int, c double"), ["g"], "k", "c", 4).collect()}
    loads, want = [0.0] * 4, {}
    for _, k, c in sorted(tasks, key=lambda t: (-t[2], t[1])):
        p = loads.index(min(loads))
        want[k] = p
        loads[p] += c
    assert got == want


def test_shots(spark):
    rng = random.Random(9)
    groups = {g: sorted(rng.uniform(0, 58) for _ in range(rng.randrange(1, 12))) for g in range(50)}
    rows = [(g, x, 60.0) for g, xs in groups.items() for x in xs]
    got = {}
    for r in Q.shots(spark.createDataFrame(rows, "g int, at double, d double"), ["g"], "at", "d").orderBy("g", "index").collect():
        got.setdefault(r.g, []).append((r.s, r.e))
    for g, xs in groups.items():
        want, bounds = [], [0.0, *xs, 60.0]
        for a, b in zip(bounds, bounds[1:]):
            if b - a < 2.5:
                if want:
                    want[-1] = (want[-1][0], b)
                continue
            while b - a > 13:
                want.append((a, a + 12))
                a += 12
            want.append((a, b))
        assert got.get(g, []) == [pytest.approx(w) for w in want]


def test_frame_chunks(spark):
    rng = random.Random(11)
    total = 900
    groups = {g: sorted(set(rng.sample(range(total), rng.randrange(1, 8))) | set(range(a := rng.randrange(0, 600), a + rng.randrange(1, 250)))) for g in range(60)}
    rows = [(g, f) for g, fs in groups.items() for f in fs]
    got = {}
    for r in Q.frame_chunks(spark.createDataFrame(rows, "g int, f int"), ["g"], "f", total).collect():
        got.setdefault(r.g, []).append((r.s, r.e))
    for g, fs in groups.items():
        runs = [[fs[0], fs[0]]]
        for f in fs[1:]:
            if f - runs[-1][1] <= 24:
                runs[-1][1] = f
            else:
                runs.append([f, f])
        want = []
        for a, b in runs:
            a, b = max(0, a - 4), min(total - 1, b + 4)
            s = a
            while True:
                e = min(b, s + 80)
                if e - s + 1 < 9:
                    s = max(0, e - 8)
                e = min(total - 1, s + (e - s) // 4 * 4)
                want.append((s, e))
                if e >= b - 3:
                    break
                s = e - 11
        assert sorted(got[g]) == sorted(want), g


def test_ownership_covers_each_frame_once(spark):
    chunks = [(0, s, s + 80) for s in range(0, 700, 69)]
    own = Q.ownership(spark.createDataFrame(chunks, "g int, s int, e int"), ["g"]).collect()
    frames = [f for r in own for f in range(r.own_s, r.own_e + 1)]
    assert sorted(frames) == list(range(0, 690 + 81))


def test_lines(spark):
    rows = [(1, 0, "1", 0, 500, "Hel"), (1, 1, "1", 500, 900, "lo "), (1, 2, None, 2100, None, "there"), (1, 3, "1", 3301, 3400, "x"), (1, 4, "2", 3400, 3500, "y"), (1, 5, "2", 3500, 3600, " ")]
    got = [(r.ms, r.end_ms, r.speaker, r.text) for r in Q.lines(spark.createDataFrame(rows, "g int, i int, speaker string, start_ms long, end_ms long, text string"), ["g"], "i").orderBy("ms").collect()]
    assert got == [(0, 2100, "1", "Hello there"), (3301, 3400, "1", "x"), (3400, 3500, "2", "y")]


def test_overlapping_equals_theta_join(spark):
    rng = random.Random(2)
    a = [(rng.randrange(3), i, x := rng.uniform(0, 50), x + rng.uniform(0, 20)) for i in range(80)]
    b = [(rng.randrange(3), i, x := rng.uniform(0, 50), x + rng.uniform(0, 20)) for i in range(80)]
    got = Q.overlapping(spark.createDataFrame(a, "g int, i int, s double, e double"), spark.createDataFrame(b, "g int, j int, s2 double, e2 double"), ["g"], ("s", "e"), ("s2", "e2"), 7)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for g, i, s, e in a for h, j, u, v in b if g == h and s < v and e > u)


def test_hamming(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    bits = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 12))) for b in base for _ in range(4)]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame(list(enumerate(signed)), "id int, h long")
    near = lambda i, j: bin(bits[i] ^ bits[j]).count("1") <= 8
    assert sorted((r.a, r.b) for r in M.hamming_pairs(df, "id", "h").collect()) == [(i, j) for i in range(120) for j in range(i + 1, 120) if near(i, j)]
    kept = []
    for i in range(120):
        if not any(near(i, k) for k in kept):
            kept.append(i)
    assert sorted(r.id for r in M.keep_first(df.withColumn("g", F.lit(1)), ["g"], "id", "h").collect()) == kept


def test_delta_needs_the_day_before(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 5), (1, "2024-01-02", 9), (1, "2024-01-04", 4), (2, "2024-01-02", 1)], "k int, d string, v int").withColumn("d", F.to_date("d"))
    assert [r.daily_v for r in R.daily_delta(df, "k", "d", ["v"]).orderBy("k", "d").collect()] == [None, 4, None, None]


def test_ranked_equals_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["rank"] == r.v + 1 for r in R.ranked(df, [F.col("v")]).collect())


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", None)], "id int, v string, found string")
    new = spark.createDataFrame([(2, None, "t2"), (3, "c", None), (1, "z", None)], "id int, v string, found string")
    assert sorted(map(tuple, R.merged_upsert(old, new, ["id"], ["found"]).collect())) == [(1, "z", "t1"), (2, None, "t2"), (3, "c", None)]
    assert sorted(r.id for r in R.insert_new(old, new, ["id"]).collect()) == [1, 2, 3]
    assert R.updated(old, F.col("found") == "t1", v=F.lit("q")).where("v = 'q'").count() == 1
    assert R.deleted(old, F.col("found") == "t1").count() == 1


def test_upgrade(spark):
    df = spark.createDataFrame([("u", 1, "OTHER", "s1", "i1"), ("u", 3, "SAME", "s3", "i3"), ("u", 2, "SAME", "s2", "i2"), ("w", 4, "OTHER", "s4", "i4")], "url string, ord int, cate string, scene string, img string")
    got = {r.url: (r.cate, r.scene, r.img) for r in R.upgraded(df, "url", "ord", "cate", "SAME", ["scene"]).collect()}
    assert got == {"u": ("SAME", "s2", "i1"), "w": ("OTHER", "s4", "i4")}


def test_zip_by_key_then_place(spark):
    left = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "k int, pos int")
    right = spark.createDataFrame([(2, 0, "two"), (None, 1, "one")], "k int, pos int, v string")
    assert [(r.k, r.v) for r in R.zipped(left, right, "k", "pos").orderBy("k").collect()] == [(0, None), (1, "one"), (2, "two")]


def test_quota_and_outcomes(spark):
    df = spark.createDataFrame([(1, i, f"2024-01-01 0{i}:00:00") for i in range(4)], "u int, id int, t string").withColumn("t", F.to_timestamp("t"))
    assert [r.admitted for r in S.admitted(df, ["u"], "t", "id", F.lit(2)).orderBy("id").collect()] == [True, True, False, False]
    calls = spark.createDataFrame([(True, True, None), (False, True, None), (False, False, "QUOTA_USER_DAILY_FREE"), (None, None, "E")], "blocked boolean, ok boolean, code string")
    assert tuple(S.outcomes(calls, "blocked", "ok", "code").first()) == (1, 1, 1, 1, 4, 25)
    assert S.outcomes(calls.limit(0), "blocked", "ok", "code").first().fail_rate == 0


def test_upper_median_deadline(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 0.001)], "s string, v double")
    got = {r.s: (r.median, r.deadline_ms) for r in S.deadlines(df, "s", "v", F.lit(100)).collect()}
    assert got == {"a": (3.0, 750_000), "b": (0.001, 180_000)}


def test_row_rules_and_settings(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, owner string")
    assert R.visible_to(df, "owner", "x").count() == 2 and R.visible_to(df, "owner", "x", "update").count() == 1
    kv = spark.createDataFrame([("a", "7"), ("b", "bad"), ("c", "99")], "key string, value string")
    assert tuple(R.settings(kv, {"a": 1, "b": 2, "c": 3, "d": 4}, high={"c": 10}).first()) == (7.0, 2.0, 3.0, 4.0)
