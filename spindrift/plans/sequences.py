"""Queries on ordered sequences and intervals: line items by ship date, events of a user, vectors and their bits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..operators import relational as R
from ..operators import sequences as Q
from ..operators import similarity as M
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
DAY = "date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spans(spark, d):
    """By order: intervals of days that begin at a ship date and last for the quantity."""
    start = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), start.alias("s"), (start + F.col("l_quantity").cast("int")).alias("e")).distinct()


SPAN_SQL = f"SELECT DISTINCT l_orderkey AS g, {DAY} AS s, {DAY} + l_quantity::INT AS e FROM lineitem"


@query("SELECT o_orderkey, cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS pct FROM orders")
def percentile_rank(spark, d):
    return R.percentile_ranks(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice").select("o_orderkey", "pct")


@query("""
WITH s AS (SELECT *, o_orderkey % 10 AS event FROM orders)
SELECT o_orderkey, 0.45::DOUBLE * event / 10 + 0.2::DOUBLE * cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + 0.2::DOUBLE * cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderdate)
       + 0.15::DOUBLE * CASE WHEN contains(o_orderpriority, 'URGENT') THEN 1 ELSE 0 END AS score FROM s""")
def highlight_score(spark, d):
    pct = lambda c: F.cume_dist().over(Window.partitionBy("o_custkey").orderBy(c))
    hot = F.when(F.contains("o_orderpriority", F.lit("URGENT")), 1).otherwise(0)
    score = F.lit(0.45) * (F.col("o_orderkey") % 10) / 10 + F.lit(0.2) * pct("o_totalprice") + F.lit(0.2) * pct("o_orderdate") + F.lit(0.15) * hot
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"))


@query("""
WITH RECURSIVE i AS (SELECT DISTINCT l_orderkey AS g, l_extendedprice::DOUBLE AS score, l_quantity::DOUBLE AS d, '{' || l_partkey || ', ' || l_suppkey || '}' AS key FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, key, d) AS n FROM i),
f AS (SELECT DISTINCT g, 0::BIGINT AS n, 0::DOUBLE AS total, 0 AS picks, false AS done, NULL::VARCHAR AS key FROM i
  UNION ALL SELECT g, n, CASE WHEN take THEN total + d ELSE total END, CASE WHEN take THEN picks + 1 ELSE picks END, done OR (take AND (total + d >= 50 OR picks + 1 >= 8)), CASE WHEN take THEN k END
  FROM (SELECT r.g, r.n, f.total, f.picks, f.done, r.d, r.key AS k, NOT f.done AND f.total + r.d <= 65 AS take FROM f JOIN r ON r.g = f.g AND r.n = f.n + 1))
SELECT g AS l_orderkey, key FROM f WHERE key IS NOT NULL AND g IN (SELECT g FROM f GROUP BY g HAVING max(picks) >= 3 AND max(total) >= 25)""")
def highlight_pick(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("length"), F.struct("l_partkey", "l_suppkey").cast("string").alias("key")).distinct()
    return Q.greedy_budget(items, ["l_orderkey"], "score", "length", "key")


@query("""
WITH t AS (SELECT conv_id, turn, role AS speaker, turn * 1000 + (turn % 3) * 700 AS start_ms, turn * 1000 + 400 AS end_ms, text FROM conversations WHERE trim(text, ' ') <> ''),
n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(end_ms) OVER w <= 1200 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT conv_id, island::BIGINT AS island, arg_min(start_ms, turn) AS ms, arg_max(end_ms, turn) AS end_ms, arg_min(speaker, turn) AS speaker, count(*) AS turns FROM i GROUP BY conv_id, island""")
def line_islands(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), (F.col("turn") * 1000 + F.col("turn") % 3 * 700).alias("start_ms"), (F.col("turn") * 1000 + 400).alias("end_ms"), "text").where(F.trim("text") != "")
    w = Window.partitionBy("conv_id").orderBy("turn")
    runs = Q.islands(t, ["conv_id"], ["turn"], ~((F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= 1200)))
    return runs.groupBy("conv_id", "island").agg(F.min_by("start_ms", "turn").alias("ms"), F.max_by("end_ms", "turn").alias("end_ms"), F.min_by("speaker", "turn").alias("speaker"), F.count(F.lit(1)).alias("turns"))


@query(f"""
WITH x AS ({SPAN_SQL}), n AS (SELECT *, CASE WHEN s - max(e) OVER w >= 10 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT g, min(s) AS s, max(e) AS e, count(*) AS parts FROM i GROUP BY g, k""")
def interval_union(spark, d):
    return Q.merge_close(spans(spark, d), ["g"], "s", "e", 10).select("g", F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"), "parts")


@query(f"""
WITH x AS (SELECT DISTINCT g, s, s + 3 AS e FROM ({SPAN_SQL})), c AS (SELECT g, s + 0.5::DOUBLE AS cs, e - 0.5::DOUBLE AS ce FROM x),
c2 AS (SELECT g, cs, lead(cs) OVER (PARTITION BY g ORDER BY cs, ce) AS ncs, lag(ce) OVER (PARTITION BY g ORDER BY cs, ce) AS pce, ce, sum(ce - cs) OVER (PARTITION BY g) AS cut_total FROM c),
k AS (SELECT g, cut_total, coalesce(pce, 0.0::DOUBLE) AS "start", cs AS "end" FROM c2 UNION ALL SELECT g, cut_total, ce, 5000.0::DOUBLE FROM c2 WHERE ncs IS NULL)
SELECT g, cut_total, "start", "end" FROM k WHERE "end" > "start" """)
def keep_complement(spark, d):
    silences = spans(spark, d).select("g", F.col("s").cast("double").alias("start"), (F.col("s") + 3).cast("double").alias("end")).distinct().withColumn("duration", F.lit(5000.0))
    return Q.kept_ranges(silences, ["g"], "duration", pad=0.5)


@query(f"""
WITH x AS ({SPAN_SQL}), b AS (SELECT g, unnest(range(0, 100)) AS bin, s, e FROM x)
SELECT g, bin::INT AS bin, sum(greatest(0.0::DOUBLE, least(e::DOUBLE, (bin + 1) * 50.0) - greatest(s::DOUBLE, bin * 50.0)) / 50.0 * 100)::DOUBLE AS covered FROM b WHERE bin BETWEEN floor(s / 50) AND least(99, floor(e / 50)) GROUP BY g, bin""")
def cutmap_hist(spark, d):
    return Q.cut_map(spans(spark, d).withColumn("d", F.lit(5000.0)), ["g"], "s", "e", "d")


@query(f"WITH x AS ({SPAN_SQL}) SELECT a.g, a.s, a.e, b.s AS s2, b.e AS e2 FROM x a JOIN (SELECT DISTINCT g, s + 15 AS s, s + 25 AS e FROM x) b ON a.g = b.g AND a.s < b.e AND a.e > b.s")
def interval_overlap(spark, d):
    a = spans(spark, d)
    b = a.select("g", (F.col("s") + 15).alias("s2"), (F.col("s") + 25).alias("e2")).distinct()
    out = Q.overlapping(a, b, ["g"], ("s", "e"), ("s2", "e2"), small=None)  # an order has seven lines at most
    return out.select("g", *[F.col(c).cast("bigint").alias(c) for c in ("s", "e", "s2", "e2")])


@query("""
WITH a AS (SELECT o_orderstatus AS g, o_orderkey AS i, o_orderkey * 10 AS s, o_orderkey * 10 + CASE WHEN o_custkey % 97 = 0 THEN 3000 ELSE o_custkey % 13 END AS e FROM orders),
b AS (SELECT o_orderstatus AS g, o_orderkey AS j, o_orderkey * 10 + 5 AS s2, o_orderkey * 10 + 5 + CASE WHEN o_custkey % 89 = 0 THEN 2000 ELSE o_custkey % 11 END AS e2 FROM orders)
SELECT a.g, i, j FROM a JOIN b ON a.g = b.g AND s < e2 AND e > s2""")
def long_group_overlap(spark, d):
    """Ranges of few and very long groups, some of them long: by dyadic nodes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, d, "orders")
    a = orders.select(F.col("o_orderstatus").alias("g"), k.alias("i"), (k * 10).alias("s"), (k * 10 + F.when(c % 97 == 0, 3000).otherwise(c % 13)).alias("e"))
    b = orders.select(F.col("o_orderstatus").alias("g"), k.alias("j"), (k * 10 + 5).alias("s2"), (k * 10 + 5 + F.when(c % 89 == 0, 2000).otherwise(c % 11)).alias("e2"))
    return Q.overlapping(a, b, ["g"], ("s", "e"), ("s2", "e2"), 8.0).select("g", "i", "j")


@query(f"WITH x AS (SELECT DISTINCT l_suppkey AS g, {DAY} AS f, l_linenumber AS k FROM lineitem) SELECT a.g, a.f, a.k, count(DISTINCT b.f) AS support FROM x a JOIN x b ON a.g = b.g AND a.f <> b.f AND b.f BETWEEN a.f - 60 AND a.f + 60 AND a.k = b.k GROUP BY a.g, a.f, a.k HAVING count(DISTINCT b.f) >= 5")
def support_count(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("f"), F.col("l_linenumber").alias("k")).distinct()
    return Q.support(x, ["g"], "f", equal=["k"], reach=60).select("g", F.col("f").cast("bigint").alias("f"), "k", "support")


@query("SELECT event_id, bit_or(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS bits_or FROM events")
def sliding_or(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("bits"))
    return Q.sliding_or(e, ["user_id"], "event_id", "bits").select("event_id", "bits_or")


@query("SELECT event_id, floor(value)::BIGINT AS restored, xor(floor(value)::BIGINT, coalesce(lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS delta FROM events")
def delta_round_trip(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("bigint").alias("bits"))
    return Q.xor_restore(Q.xor_delta(e, ["user_id"], "event_id", "bits").drop("bits"), ["user_id"], "event_id").select("event_id", "restored", "delta")


@query(f"""
WITH x AS ({SPAN_SQL}), w AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written FROM x),
u AS (SELECT *, CASE WHEN written IS NULL OR s > written THEN s ELSE greatest(s, written - 5) END AS own_s FROM w),
o AS (SELECT g, s, e, own_s, least(e, coalesce(lead(own_s) OVER (PARTITION BY g ORDER BY s, e) - 1, e)) AS own_e FROM u)
SELECT g, s, e, own_s, own_e FROM o WHERE own_e >= own_s""")
def ownership_ranges(spark, d):
    out = Q.ownership(spans(spark, d), ["g"])
    return out.select("g", *[F.col(c).cast("bigint").alias(c) for c in ("s", "e", "own_s", "own_e")])


@query(f"""
WITH RECURSIVE x AS (SELECT DISTINCT l_suppkey AS g, {DAY} AS f FROM lineitem), n AS (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY g ORDER BY f) <= 24 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY f ROWS UNBOUNDED PRECEDING) AS k FROM n), r AS (SELECT g, k, greatest(0, min(f) - 4) AS a, least(3999, max(f) + 4) AS b FROM i GROUP BY g, k),
c AS (SELECT g, k, a AS pos, b FROM r UNION ALL SELECT g, k, pos + 69, b FROM c WHERE pos + 80 < b - 3),
e AS (SELECT g, least(b, pos + 80) AS e, CASE WHEN least(b, pos + 80) - pos + 1 < 9 THEN greatest(0, least(b, pos + 80) - 8) ELSE pos END AS s FROM c)
SELECT g, s::BIGINT AS s, least(3999, s + (e - s) // 4 * 4)::BIGINT AS e FROM e""")
def gap_chunks(spark, d):
    frames = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).alias("f")).distinct()
    return Q.frame_chunks(frames, ["g"], "f", 4000)


@query("""
WITH RECURSIVE p AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value % 1.0::DOUBLE AS p, count(*) OVER (PARTITION BY user_id) * 512 AS total FROM events),
f AS (SELECT DISTINCT u, -1::BIGINT AS i, -1::BIGINT AS began, -1::BIGINT AS quiet, NULL::BIGINT AS s, NULL::BIGINT AS e, total FROM p
  UNION ALL SELECT p.u, p.i, CASE WHEN p.p >= 0.5 AND began < 0 THEN p.i * 512 WHEN p.p < 0.35 AND began >= 0 AND quiet >= 0 AND p.i * 512 - quiet >= 1600 THEN -1 ELSE began END,
    CASE WHEN p.p >= 0.5 THEN -1 WHEN p.p < 0.35 AND began >= 0 AND quiet < 0 THEN p.i * 512 WHEN p.p < 0.35 AND began >= 0 AND p.i * 512 - quiet >= 1600 THEN -1 ELSE quiet END,
    CASE WHEN p.p < 0.35 AND began >= 0 AND quiet >= 0 AND p.i * 512 - quiet >= 1600 THEN began END, CASE WHEN p.p < 0.35 AND began >= 0 AND quiet >= 0 AND p.i * 512 - quiet >= 1600 THEN quiet END, p.total
  FROM f JOIN p ON p.u = f.u AND p.i = f.i + 1),
g AS (SELECT u, s, e, total FROM f WHERE s IS NOT NULL UNION ALL SELECT u, began, total, total FROM f WHERE began >= 0 AND (i + 1) * 512 = total),
d AS (SELECT u, greatest(0, s - 320) AS s, least(total, e + 320) AS e FROM g WHERE e - s >= 1024),
n AS (SELECT *, CASE WHEN s - max(e) OVER w <= 0 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY u ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT u AS user_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM k GROUP BY u, k""")
def hysteresis_segments(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("i", F.row_number().over(w) - 1).withColumn("p", F.pmod(F.col("value"), F.lit(1.0))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")) * 512)
    return Q.hysteresis(e, ["user_id"], "i", "p", 0.5, 0.35, 512, 1600, 1024, 320, "total")


def prints(spark, d):
    """Signs of a vector's first 24 numbers as a fingerprint."""
    first = F.concat(F.slice("embedding", 1, 24), F.array_repeat(F.lit(-1.0), 40))
    return table(spark, d, "embeddings").select("label", "vec_id", X.sign_bits(first).alias("h"))


PRINT_SQL = "SELECT label, vec_id, list_sum(list_transform(embedding[1:24], lambda x, i: CASE WHEN x > 0 THEN 1::BIGINT << (i - 1)::BIGINT ELSE 0 END))::BIGINT AS h FROM embeddings"


@query(f"WITH b AS ({PRINT_SQL}) SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM b a JOIN b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 4")
def hamming_pairs(spark, d):
    return M.hamming_pairs(prints(spark, d), "vec_id", "h", 4, 24)


@query(f"""
WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM ({PRINT_SQL})),
f AS (SELECT DISTINCT label, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id FROM b
  UNION ALL SELECT label, n, CASE WHEN near THEN kept ELSE list_append(kept, h) END, CASE WHEN NOT near THEN v END
  FROM (SELECT b.label, b.n, kept, b.h, b.vec_id AS v, len(list_filter(kept, lambda k: bit_count(xor(k, b.h)) <= 6)) > 0 AS near FROM f JOIN b ON b.label = f.label AND b.n = f.n + 1))
SELECT label, vec_id FROM f WHERE vec_id IS NOT NULL""")
def near_dup_keep_first(spark, d):
    return M.keep_first(prints(spark, d), ["label"], "vec_id", "h", 6, 24).select("label", "vec_id")


@query("""
WITH RECURSIVE t AS (SELECT o_custkey AS g, o_orderkey, o_totalprice::DOUBLE AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders),
f AS (SELECT DISTINCT g, 0::BIGINT AS n, [0, 0, 0]::DOUBLE[] AS loads, NULL::BIGINT AS o_orderkey, 0 AS part, 0::DOUBLE AS before FROM t
  UNION ALL SELECT t.g, t.n, list_transform(loads, lambda v, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN v + t.c ELSE v END), t.o_orderkey, list_position(loads, list_min(loads))::INT - 1, list_min(loads) FROM f JOIN t ON t.g = f.g AND t.n = f.n + 1)
SELECT g AS o_custkey, o_orderkey, part, before FROM f WHERE n > 0""")
def lpt_buckets(spark, d):
    tasks = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return Q.balanced(tasks, ["o_custkey"], "o_orderkey", "o_totalprice", 3)


@query("SELECT p_partkey, i::INT AS index, (i * 7)::DOUBLE AS start, least((i + 1) * 7, p_size)::DOUBLE AS \"end\" FROM part, unnest(range(0, ceil(p_size / 7)::INT)) r(i) WHERE p_size > 0")
def fixed_chunks(spark, d):
    return table(spark, d, "part").select("p_partkey", F.inline(Q.fixed_chunks(F.col("p_size"), 7)))


@query("SELECT p_partkey, k::INT AS part, floor(k * p_size / 4)::BIGINT AS lo, floor((k + 1) * p_size / 4)::BIGINT AS hi FROM part, unnest(range(0, 4)) r(k)")
def even_parts(spark, d):
    lo, hi = Q.even_range(F.col("part"), F.col("p_size"), 4)
    return table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")).select("p_partkey", "part", lo.alias("lo"), hi.alias("hi"))


@query(f"""
WITH c AS (SELECT DISTINCT l_orderkey AS g, {DAY} / 100 AS pos FROM lineitem), b AS (SELECT g, pos FROM c UNION ALL SELECT DISTINCT g, 0.0::DOUBLE FROM c UNION ALL SELECT DISTINCT g, 60.0::DOUBLE FROM c),
o AS (SELECT g, pos, row_number() OVER (PARTITION BY g ORDER BY pos) AS n FROM b), t AS (SELECT a.g, a.n, a.pos AS s, z.pos AS e, z.pos - a.pos >= 2.5::DOUBLE AS long FROM o a JOIN o z ON z.g = a.g AND z.n = a.n + 1),
k AS (SELECT *, count(*) FILTER (WHERE long) OVER (PARTITION BY g ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM t),
m AS (SELECT g, k, min(CASE WHEN long THEN s END) AS s, min(CASE WHEN long THEN e END) AS e, max(e) AS last FROM k WHERE k > 0 GROUP BY g, k),
p AS (SELECT *, greatest(0, ceil((e - s - 13::DOUBLE) / 12::DOUBLE))::INT AS more FROM m), q AS (SELECT *, unnest(range(0, more + 1)) AS j FROM p)
SELECT g, (row_number() OVER (PARTITION BY g ORDER BY s, j) - 1)::INT AS index, s + j * 12::DOUBLE AS s, CASE WHEN j < more THEN s + (j + 1) * 12::DOUBLE ELSE last END AS e FROM q""")
def shot_stretches(spark, d):
    cuts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) / 100).alias("at")).distinct().withColumn("d", F.lit(60.0))
    return Q.shots(cuts, ["g"], "at", "d")


@query("SELECT c_custkey, greatest(0, least(10, floor(c_acctbal % 10 + 2 + 0.5)))::INT AS a FROM customer")
def clamped_score(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.clamp10(F.col("c_acctbal") % 10 + 2).alias("a"))


@query("""
WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT a.o_custkey, a.o_orderkey, coalesce(b.o_orderkey, -1) AS follows FROM h a LEFT JOIN h b ON a.o_custkey = b.o_custkey AND a.r = b.r + 3""")
def lag_three(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lag("o_orderkey", 3).over(w), F.lit(-1)).alias("follows"))


@query("""
WITH RECURSIVE b AS (SELECT p_size AS g, (p_retailprice % 720)::DOUBLE AS cy, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice % 720, p_partkey) AS n FROM part),
f AS (SELECT DISTINCT g, 0::BIGINT AS n, []::DOUBLE[] AS sums, []::DOUBLE[] AS counts, 0 AS line, NULL::DOUBLE AS cy, NULL::BIGINT AS p_partkey FROM b
  UNION ALL SELECT g, n, CASE WHEN pos = 0 THEN list_append(sums, y) ELSE list_transform(sums, lambda v, i: CASE WHEN i = pos THEN v + y ELSE v END) END,
    CASE WHEN pos = 0 THEN list_append(counts, 1) ELSE list_transform(counts, lambda v, i: CASE WHEN i = pos THEN v + 1 ELSE v END) END, CASE WHEN pos = 0 THEN len(sums) ELSE pos - 1 END::INT, y, k
  FROM (SELECT b.g, b.n, sums, counts, b.cy AS y, b.p_partkey AS k, coalesce(list_position(list_transform(sums, lambda v, i: abs(v / counts[i] - b.cy) < 25), true), 0) AS pos FROM f JOIN b ON b.g = f.g AND b.n = f.n + 1))
SELECT g, cy, p_partkey, line FROM f WHERE n > 0""")
def grouped_lines(spark, d):
    boxes = table(spark, d, "part").select(F.col("p_size").alias("g"), (F.col("p_retailprice") % 720).alias("cy"), "p_partkey")
    return M.grouped_lines(boxes, "g", "cy")
