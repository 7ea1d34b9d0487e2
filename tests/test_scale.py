"""Operators at groups of any length: results against plain renderings, and the rows that their joins make."""

import heapq
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.operators import sequences as Q
from spindrift.operators import similarity as M


def near_prints(rng, n, flips):
    out = []
    for _ in range(n):
        h = rng.getrandbits(64)
        out.append(h)
        for _ in range(3):
            out.append(h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips))))
    return [h - (1 << 64) if h >> 63 else h for h in out]


@pytest.mark.parametrize("most,width,reach", [(8, 64, 1), (8, 64, 2), (4, 24, 1), (3, 64, 1), (0, 64, 1)])
def test_hamming_pairs(spark, most, width, reach):
    rng = random.Random(most)
    prints = near_prints(rng, 60, 12)
    prints = [h & ((1 << width) - 1) if width < 64 else h for h in prints + prints[:5]]
    rows = [(i % 2 if i % 7 else None, i, h) for i, h in enumerate(prints)] + [(0, 900, None)]
    got = M.hamming_pairs(spark.createDataFrame(rows, "g int, id long, h long"), "id", "h", most, width, ["g"], reach).collect()
    bits = lambda x, y: bin((x ^ y) & ((1 << 64) - 1)).count("1")
    want = Counter((g, a, b, bits(x, y)) for g, a, x in rows for k, b, y in rows if g == k and a < b and x is not None and y is not None and bits(x, y) <= most)
    assert Counter((r.g, r.a, r.b, r.distance) for r in got) == want and want


def test_hamming_candidates(spark):
    """Uniform fingerprints: rows meet by far fewer than all numbers."""
    n = 60_000
    df = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("h"))
    assert M.hamming_pairs(df, "id", "h").count() < 5  # by chance
    edges = [0, 21, 42, 64]
    met = 0
    for p in M._blocks(F.col("h"), edges):
        met += df.groupBy(p.alias("p")).count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met * 23 * 23 < n * n / 1000


def test_keep_first(spark):
    rng = random.Random(5)
    prints = near_prints(rng, 40, 14)
    prints += prints[10:30] * 3
    rng.shuffle(prints)
    rows = [(i % 3 or None, i, h, "x") for i, h in enumerate(prints)] + [(1, 1000 + i, None, "y") for i in range(3)]
    got = {(r.g, r.id) for r in M.keep_first(spark.createDataFrame(rows, "g int, id long, h long, other string"), ["g"], "id", "h").collect()}
    kept = defaultdict(list)
    for g, i, h, _ in rows:
        if h is None or not any(k is not None and bin((h ^ k) & ((1 << 64) - 1)).count("1") <= 8 for _, k in kept[g]):
            kept[g].append((i, h))
    assert got == {(g, i) for g, v in kept.items() for i, _ in v}


@pytest.mark.parametrize("small", [64, 3, 0])
def test_overlaps_of_mixed_lengths(spark, small):
    rng = random.Random(small)
    length = lambda: rng.choice([0, 0.5, 1, 3, 40, 900, 5000])
    a = [(g, i, s, s + length()) for g in (1, 2, 3) for i in range(4 ** g) for s in [rng.randrange(-2000, 4000) / 4]] + [(None, 0, 0.0, 9.0), (3, 900, None, 5.0), (3, 901, 9.0, 2.0)]
    b = [(g, i, s, s + length()) for g in (1, 2, 3) for i in range(60) for s in [rng.randrange(-2000, 4000) / 4]] + [(None, 0, 0.0, 9.0), (2, 900, 7.0, None)]
    got = Q.overlapping(spark.createDataFrame(a, "g int, i int, s double, e double"), spark.createDataFrame(b, "g int, j int, s2 double, e2 double"), ["g"], ("s", "e"), ("s2", "e2"), 2.0, small)
    want = Counter((g, i, j) for g, i, s, e in a for k, j, s2, e2 in b if g is not None and g == k and None not in (s, e, s2, e2) and s < e2 and e > s2)
    assert Counter((r.g, r.i, r.j) for r in got.collect()) == want and want


def test_one_long_group_of_ranges(spark):
    """A hundred thousand ranges of one group, some of them long: pairs by counting starts."""
    n = 100_000
    a = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") % 20_000 == 0, 5000).otherwise(4)).alias("e"))
    b = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("j"), (F.col("id") * 10 + 5).alias("s2"), (F.col("id") * 10 + F.when(F.col("id") % 30_000 == 0, 7000).otherwise(9)).alias("e2"))
    ra, rb = ([tuple(r) for r in df.drop("g").collect()] for df in (a, b))
    ends = lambda rows, k: sorted(r[k] for r in rows)
    import bisect

    s2, e2 = ends(rb, 1), ends(rb, 2)
    want = sum(bisect.bisect_left(s2, e) - bisect.bisect_right(e2, s) for _, s, e in ra)
    assert Q.overlapping(a, b, ["g"], ("s", "e"), ("s2", "e2"), 4.0).count() == want


def test_folds_of_one_long_group(spark):
    n = 100_000
    tasks = [(1, i, float((i * 7919) % 1000)) for i in range(n)] + [(2, i, float(i % 3)) for i in range(10)] + [(None, 1, 5.0), (3, 1, None)]
    got = Q.balanced(spark.createDataFrame(tasks, "g int, id long, c double").repartition(5), ["g"], "id", "c", 7).collect()
    want = set()
    for g in (1, 2, None, 3):
        heap = [(0.0, p) for p in range(7)]
        for c, i in sorted((-(c if c is not None else -1), i) for k, i, c in tasks if k == g):
            load, part = heap[0]
            heapq.heapreplace(heap, (load + (-c if c < 1 else 0.0), part))
            want.add((g, i, part, load))
    assert {(r.g, r.id, r.part, r.before) for r in got} == want and len(got) == len(tasks)
    items = [(1, i, float((i * 7919) % n), float(20 + i % 9), f"k{i}") for i in range(n)] + [(2, 1, 1.0, 99.0, "long"), (2, 2, 0.5, 9.0, "one")]
    got = Q.greedy_budget(spark.createDataFrame(items, "g int, i long, score double, len double, key string").repartition(5), ["g"], "score", "len", "key", least_picks=2).collect()
    total, keys = 0.0, []
    for score, key, d in sorted((-s, k, d) for g, _, s, d, k in items if g == 1):
        if total + d <= 65 and total < 50 and len(keys) < 8:
            total += d
            keys.append(key)
    assert [(r.g, r.key) for r in got] == [(1, k) for k in keys]


def test_support_meets_near_frames_only(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.randrange(80), rng.randrange(30), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, frame int, x int, id int")
    got = {(r.id, r.support) for r in Q.support(df, ["g"], "frame", lambda a, b: F.abs(a("x") - b("x")) < 6).collect()}
    want = set()
    for g, f, x, i in rows:
        n = len({k for h, k, y, _ in rows if h == g and k != f and abs(k - f) <= 6 and abs(x - y) < 6})
        if n >= 5:
            want.add((i, n))
    assert got == want and want


def test_deep_pages_and_changes(spark, monkeypatch):
    from spindrift.operators import relational as R

    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 7 % 100).alias("v"))
    order = [F.desc("v"), F.col("k")]
    shallow = [tuple(r) for r in R.page(df, order, 7, 40).orderBy("rank").collect()]
    monkeypatch.setattr(R, "DEEP", 10)
    assert [tuple(r) for r in R.page(df, order, 7, 40).orderBy("rank").collect()] == shallow and len(shallow) == 40
    rng = random.Random(9)
    steps = [(rng.randrange(4), i, rng.choice([1, -1, -1, 0])) for i in range(300)]
    view, want = spark.createDataFrame([(0, 5), (9, 2)], "g int, n long"), {0: 5, 9: 2}
    for i, part in enumerate((steps[:140], steps[140:150], steps[150:])):
        view = R.maintained(view, spark.createDataFrame(part, "g int, at int, step int").repartition(3), ["g"], [F.col("at")], "step", "n")
        for g, _, s in part:
            want[g] = max(0, want.get(g, 0) + s)
    assert {r.g: r.n for r in view.collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_percentile_ranks_with_long_ties(spark, parts):
    from spindrift.operators import relational as R

    rng = random.Random(parts)
    rows = [(g, i, v) for i in range(900) for g, v in [(rng.choice([1, 1, 1, 2, None]), rng.choice([5.0, 5.0, 5.0, float(rng.randrange(40)), None, float("nan")]))]]
    df = spark.createDataFrame(rows, "g int, id int, v double").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.id: r.pct for r in R.percentile_ranks(df, ["g"], "v").collect()}
        one = {r.id: r.pct for r in R.percentile_ranks(df.select("id", F.lit(5.0).alias("v")), [], "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda v: (v != v, 0.0 if v != v else v)
    of = defaultdict(list)
    for g, _, v in rows:
        if v is not None:
            of[g].append(key(v))
    assert got == {i: sum(k <= key(v) for k in of[g]) / len(of[g]) for g, i, v in rows if v is not None}
    assert set(one.values()) == {1.0} and len(one) == 900


def test_lines_of_one_long_group(spark):
    """Thirty thousand items of one group: a fold over all lines so far and an array of all items took their square."""
    n = 30_000
    rng = random.Random(3)
    items = [(1, i, rng.choice([rng.random() * 3000, float(rng.randrange(3000))])) for i in range(n)] + [(2, 0, 5.0), (2, 1, 5.0), (2, 2, None), (2, 3, float("nan")), (2, 4, None), (2, 5, float("nan")), (None, 0, 1.0), (None, 1, 30.0), (2, 6, float("-inf")), (2, 7, float("inf"))]
    df = spark.createDataFrame(items, "g int, id int, c double").repartition(3)
    key = lambda r: (r[2] is not None, (r[2] != r[2], 0.0 if r[2] != r[2] else r[2]) if r[2] is not None else (False, 0.0), r[1])
    want = set()
    for g in (1, 2, None):
        lines = []
        for _, i, c in sorted((r for r in items if r[0] == g), key=key):
            at = next((k for k, (s, m) in enumerate(lines) if s is not None and c is not None and abs(s / m - c) < 25), len(lines))
            if at == len(lines):
                lines.append((c, 1))
            else:
                lines[at] = (lines[at][0] + c, lines[at][1] + 1)
            want.add((g, i, at))
    began = time.time()
    got = M.grouped_lines(df, "g", "c").collect()
    assert {(r.g, r.id, r.line) for r in got} == want and len(got) == len(items)
    assert time.time() - began < 30


def test_bands_of_one_long_group(spark):
    n = 32_400
    hits = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 900).cast("double").alias("y0"), (F.col("id") * 7919 % 900 + 30).cast("double").alias("y1"))
    few = hits.distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4))))  # as many lines, each with as large a share
    began = time.time()
    got = {tuple(r) for r in M.packed_bands(hits, "g", 720, 1280).collect()}
    assert time.time() - began < 30
    assert got == {tuple(r) for r in M.packed_bands(few.drop("k"), "g", 720, 1280).collect()} and got


def test_support_of_equal_boxes(spark):
    """Four hundred equal rows a frame: as pairs they took the square of that, thirteen million of them."""
    df = spark.range(40_000).select(F.lit(1).alias("g"), F.col("id"), (F.col("id") % 100).alias("frame"), F.when(F.col("id") % 400 < 300, F.col("id") % 3 * 2).alias("x"))
    seen: list = []

    def near(a, b):
        seen.append(1)
        return F.abs(a("x") - b("x")) < 2

    found = Q.support(df, ["g"], "frame", near)
    got = {(r.id, r.support) for r in found.collect()}
    rows = [tuple(r) for r in df.collect()]
    at = defaultdict(set)
    for _, _, f, x in rows:
        at[x].add(f)
    n = {(f, x): sum(1 for k in at[x] if k != f and abs(k - f) <= 6) for _, _, f, x in rows if x is not None}
    assert got == {(i, n[f, x]) for _, i, f, x in rows if x is not None and n[f, x] >= 5} and got
    assert most_rows(found) <= 100_000


def test_ready_counts_instead_of_pairs(spark):
    from spindrift.operators import state as S

    rng = random.Random(8)
    n = 3000
    segments = [(g, i, f, f + rng.choice([10, 40, 500])) for i in range(n) for g, f in [(rng.choice([1, 1, 1, 2, None]), rng.randrange(900))]] + [(2, 9000, 50, 50), (2, 9001, 60, 20), (3, 9002, 1, 5), (1, 9003, None, 4)]
    chunks = [(g, s, s + rng.choice([0, 5, 300]), rng.choice(["done"] * 90 + ["todo", None])) for _ in range(n) for g, s in [(rng.choice([1, 1, 1, 2, None]), rng.randrange(3000))]] + [(2, 30, 10, "todo"), (2, 51, 50, "todo"), (1, 5, None, "todo"), (4, 1, 2, "done")]
    found = S.ready(spark.createDataFrame(segments, "g int, i int, f0 int, f1 int"), spark.createDataFrame(chunks, "g int, s int, e int, status string"), ["g"], "i")
    of = defaultdict(list)
    for g, i, f0, f1 in segments:
        for k, s, e, status in chunks:
            if g is not None and g == k and None not in (f0, f1, s, e) and s < f1 and e + 1 > f0:
                of[g, i].append(status)
    want = {(g, i, False if "todo" in v else True if "done" in v else None) for (g, i), v in of.items()}
    assert {tuple(r) for r in found.collect()} == want and {w[2] for w in want} >= {True, False}
    plain = lambda rows: [r for r in rows if r[2] is not None and r[1] is not None]
    ok = [r for r in plain(segments) if r[3] > r[2]], [r for r in plain(chunks) if r[2] >= r[1]]
    assert most_rows(S.ready(spark.createDataFrame(ok[0], "g int, i int, f0 int, f1 int"), spark.createDataFrame(ok[1], "g int, s int, e int, status string"), ["g"], "i")) <= 8 * n


def test_label_groups_of_equal_pieces(spark, monkeypatch):
    """A frame of 6,000 pieces at 60 places: pairs of places, not of pieces, are linked."""
    made: list = []
    plain = M.connected
    monkeypatch.setattr(M, "connected", lambda links, by: made.append(links.count()) or plain(links, by))
    rng = random.Random(4)
    at = [(rng.randrange(500) * 1.0, rng.randrange(500) * 1.0, rng.choice([12.0, 16.0]), rng.randrange(30) * 6.0) for _ in range(60)]
    rows = [(g, i, *at[i % 60]) for g in (1, 2, None) for i in range(6000)] + [(1, 7000 + i, 1.0, 1.0, s, h) for i, (s, h) in enumerate([(0.0, 5.0), (0.0, 5.0), (12.0, None), (12.0, None), (None, 5.0), (12.0, float("nan")), (12.0, float("nan"))])]
    got = M.label_groups(spark.createDataFrame(rows, "f int, id long, x double, y double, size double, hue double").repartition(3), "f").collect()
    assert made[0] <= 2 * 80 * 80 and len(got) == len(rows)
    near = lambda a, b: None not in (a[5], b[5], a[4], b[4]) and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 < 2.5 * max(a[4], b[4]) and min(abs(a[5] - b[5]), 180 - abs(a[5] - b[5])) < 16
    for g in (1, 2, None):
        own = [r for r in rows if r[0] == g and (r[1] < 60 or r[1] >= 7000)]
        group = {r[1]: r[1] for r in own}
        if g is not None:
            for _ in own:
                for a in own:
                    for b in own:
                        if a is not b and near(a, b):
                            group[a[1]] = group[b[1]] = min(group[a[1]], group[b[1]])
        want = {(r[1], r[1] if g is None else group[r[1] if r[1] >= 7000 else r[1] % 60]) for r in rows if r[0] == g}
        assert {(r.id, r.group) for r in got if r.f == g} == want
    assert len({r.group for r in got if r.f == 1}) > 5


def test_labels_send_no_table_around(spark, monkeypatch):
    """Spark takes the size of files, or of rows before an explode, for that of a table; the joins of pieces don't rely on it."""
    plans = written_plans(monkeypatch)
    k = F.col("id")
    pieces = spark.range(400).select(F.floor(k / 8).alias("frame"), "id", (k % 4 * 70).alias("x0"), (k % 2 * 70).alias("y0"), (k % 4 * 70 + 50).alias("x1"), (k % 2 * 70 + 50).alias("y1"), (k % 50 * 20 + 400).alias("area"), (k % 3 * 40).cast("double").alias("hue"), F.lit(0.5).alias("white"))
    out = M.decorative_labels(pieces, "frame")
    assert len(plans) > 2 and not [p for p in [*plans, plan_of(out)] if "BroadcastExchange" in p]


def test_near_dedup_sends_no_bands_around(spark, monkeypatch):
    """28 bands a document, exploded from an array that Spark sizes as one number."""
    from spindrift.llm import common, minhash
    from spindrift.llm.components import components

    plans = written_plans(monkeypatch)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2 * 31 + j) % 997}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    out = minhash.near_groups(docs, common.Scratch(spark))
    assert out.where("doc_id % 2 = 1 and component_id = doc_id - 1").count() == 30
    banded = [p for p in plans if "bucket#" in p and "explode(bands" in p]
    assert banded and not [p for p in banded if "BroadcastExchange" in p]
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    plans.clear()
    found = components(spark.createDataFrame([(3, 2), (2, 1), (9, 8), (8, 8)], "a long, b long"), common.Scratch(spark))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)} and not [p for p in plans if "BroadcastExchange" in p]


def test_keep_first_sends_no_prints_around(spark, monkeypatch):
    """A fingerprint stands under 67 numbers, exploded from an array that Spark sizes as one."""
    plans = written_plans(monkeypatch)
    out = M.keep_first(spark.createDataFrame([(1, 1, 7), (1, 2, 6), (2, 3, 7), (1, 4, -1)], "g int, id long, h long"), ["g"], "id", "h")
    assert len(plans) > 3 and not [p for p in [*plans, plan_of(out)] if "BroadcastExchange" in p]
    assert {r.id for r in out.collect()} == {1, 3, 4}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written_plans(monkeypatch):
    """Plans of the tables that operators write, as they come."""
    from spindrift.sources.scratch import Scratch

    plans, keep = [], Scratch.keep

    def kept(self, df, *args):
        plans.append(plan_of(df))
        return keep(self, df, *args)

    monkeypatch.setattr(Scratch, "keep", kept)
    return plans


def most_rows(df):
    """The most rows that an operator of a plan gives, as its run counts them."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.alias("again").select("*")._jdf.queryExecution().executedPlan()
        plan.execute().count()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most
