"""More queries on joins, guards and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..operators import relational as R
from ..operators import sequences as Q
from ..operators import state as S
from ..sources.tables import row_count, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS n FROM lineitem")
def count_only(spark, d):
    return row_count(table(spark, d, "lineitem"))


@query("SELECT o_custkey, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def favourites(spark, d):
    marks = table(spark, d, "orders").where("o_orderstatus = 'P'")
    return marks.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_name")


@query("""
WITH s AS (SELECT p_partkey AS segment, p_size AS g, (p_partkey % 10) * 10 AS f0, (p_partkey % 10) * 10 + 10 AS f1 FROM part),
c AS (SELECT p_size AS g, (p_partkey * 7) % 100 AS s, (p_partkey * 7) % 100 + 5 AS e, CASE WHEN p_partkey % 50 = 0 THEN 'todo' ELSE 'done' END AS status FROM part)
SELECT s.g, segment, bool_and(status = 'done') AS ready FROM s JOIN c ON s.g = c.g AND c.s <= f1 - 1 AND c.e >= f0 GROUP BY s.g, segment""")
def segments_ready(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    segments = p.select(k.alias("segment"), F.col("p_size").alias("g"), (k % 10 * 10).alias("f0"), (k % 10 * 10 + 10).alias("f1"))
    chunks = p.select(F.col("p_size").alias("g"), (k * 7 % 100).alias("s"), (k * 7 % 100 + 5).alias("e"), F.when(k % 50 == 0, "todo").otherwise("done").alias("status"))
    return S.ready(segments, chunks, ["g"], "segment")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 90 MINUTE THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'done' END AS status FROM orders")
def stuck_jobs(spark, d):
    jobs = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "running").otherwise("done"))
    return S.failed_stuck(jobs, "o_orderdate", F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'working' ELSE o_orderpriority END AS detail FROM orders")
def guarded_detail(spark, d):
    rows = table(spark, d, "orders").withColumn("detail", F.col("o_orderpriority"))
    return S.guarded(rows, "detail", F.lit("working"), "o_orderstatus", ["O", "P"]).select("o_orderkey", "detail")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'AUTO' ELSE c_mktsegment END AS segment FROM customer WHERE NOT (c_acctbal > 9000)")
def patch_and_delete(spark, d):
    rows = table(spark, d, "customer").withColumn("segment", F.col("c_mktsegment"))
    return R.deleted(R.updated(rows, F.col("c_acctbal") < 0, segment=F.lit("AUTO")), F.col("c_acctbal") > 9000).select("c_custkey", "segment")


@query("""
WITH l AS (SELECT turn AS k, conv_id AS g, turn AS pos, text FROM conversations), r AS (SELECT conv_id AS g, turn AS pos, CASE WHEN turn % 2 = 0 THEN turn END AS k, role AS v FROM conversations)
SELECT l.g, l.pos, coalesce(n.v, p.v) AS v FROM l LEFT JOIN r n ON n.k = l.k AND n.g = l.g LEFT JOIN r p ON p.k IS NULL AND p.pos = l.pos AND p.g = l.g""")
def keyed_or_placed(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    left = c.select(key.alias("k"), key.alias("pos"), F.col("conv_id").alias("g"), F.col("turn").alias("t"))
    right = c.select(F.when(F.col("turn") % 2 == 0, key).alias("k"), key.alias("pos"), F.col("role").alias("v"))
    return R.zipped(left, right, "k", "pos").select("g", F.col("t").alias("pos"), "v")


@query("SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views, greatest(0, sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END))::BIGINT AS comments FROM events GROUP BY user_id")
def derived_counters(spark, d):
    t = F.col("event_type")
    step = F.when(t == "click", 1).when(t == "error", -1).otherwise(0)
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(t == "view").alias("views"), F.greatest(F.lit(0), F.sum(step)).cast("bigint").alias("comments"))


@query("SELECT event_type, min(ts) AS first FROM events GROUP BY event_type ORDER BY first, event_type")
def first_appearance(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first")).orderBy("first", "event_type")


@query("SELECT p_size, (o.f - i.f)::BIGINT AS between FROM (SELECT p_size, count(*) AS f FROM part WHERE p_retailprice <= 1500 GROUP BY p_size) o JOIN (SELECT p_size, count(*) AS f FROM part WHERE p_retailprice <= 1000 GROUP BY p_size) i USING (p_size)")
def prefix_range_count(spark, d):
    w = Window.partitionBy("p_size").orderBy("p_retailprice").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = table(spark, d, "part").select("p_size", "p_retailprice", F.count(F.lit(1)).over(w).alias("n"))
    upto = lambda x: F.max(F.when(F.col("p_retailprice") <= x, F.col("n")))
    out = running.groupBy("p_size").agg(upto(1500).alias("hi"), upto(1000).alias("lo"))
    return out.where("hi IS NOT NULL AND lo IS NOT NULL").select("p_size", (F.col("hi") - F.col("lo")).alias("between"))


@query("""
WITH b AS (SELECT p_size AS g, p_partkey AS id, p_partkey % 500 AS frame, p_partkey % 50 AS x0, 0 AS y0, p_partkey % 50 + 40 AS x1, 20 AS y1 FROM part),
z AS (SELECT p_size AS g, p_partkey AS zone, p_partkey % 450 AS lo, p_partkey % 450 + 30 AS hi, 20 AS x0, 0 AS y0, 60 AS x1, 20 AS y1 FROM part WHERE p_partkey % 11 = 0)
SELECT b.id, min(zone) AS zone FROM b JOIN z ON b.g = z.g AND frame BETWEEN lo - 36 AND hi + 36
WHERE greatest(0, least(b.x1, z.x1) - greatest(b.x0, z.x0)) * 20 / (40.0 * 20 * 2 - greatest(0, least(b.x1, z.x1) - greatest(b.x0, z.x0)) * 20) > 0.3 GROUP BY b.id""")
def zone_of_boxes(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    boxes = p.select(F.col("p_size").alias("g"), k.alias("id"), (k % 500).alias("frame"), (k % 50).alias("x0"), F.lit(0).alias("y0"), (k % 50 + 40).alias("x1"), F.lit(20).alias("y1"))
    zones = p.where(k % 11 == 0).select(F.col("p_size").alias("g"), k.alias("zone"), (k % 450).alias("lo"), (k % 450 + 30).alias("hi"), F.lit(20).alias("x0"), F.lit(0).alias("y0"), F.lit(60).alias("x1"), F.lit(20).alias("y1"))
    return Q.in_zones(boxes, zones, ["g"]).select("id", "zone")


@query("SELECT p_partkey, frame::BIGINT AS frame FROM part, unnest(range(greatest(0, floor((p_size - 0.25) * 10)::BIGINT), ceil((p_size + 1 + 0.25) * 10)::BIGINT + 1)) r(frame)")
def masked_frames(spark, d):
    rects = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("start"), (F.col("p_size") + 1).cast("double").alias("end"))
    return Q.time_masks(rects, ["p_partkey"], 10.0).select("p_partkey", "frame")


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 50")
def case_ranked(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return R.page(table(spark, d, "customer"), [kind, F.desc("c_acctbal"), F.col("c_custkey")], 1, 50).select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey, floor(0.30::DOUBLE * h * 100 + 0.70::DOUBLE * n * 100 + 0.5) / 100 AS score FROM (SELECT c_custkey, (c_custkey % 11)::DOUBLE AS h, (c_custkey % 7)::DOUBLE AS n FROM customer)")
def weighted_score(spark, d):
    h, n = (F.col("c_custkey") % 11).cast("double"), (F.col("c_custkey") % 7).cast("double")
    return table(spark, d, "customer").select("c_custkey", (X.half_up(F.lit(0.30) * h * 100 + F.lit(0.70) * n * 100) / 100).alias("score"))


@query("SELECT label, count(*) FILTER (WHERE b >= 0) AS n, max(b)::BIGINT AS top FROM (SELECT label, floor((embedding[1] + 1) * 90) AS b FROM embeddings) GROUP BY label")
def value_bins(spark, d):
    b = F.floor((F.element_at("embedding", 1).cast("float") + F.lit(1).cast("float")) * F.lit(90).cast("float"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count_if(b >= 0).alias("n"), F.max(b).cast("bigint").alias("top"))


@query("SELECT count(*) AS members, sum(n)::BIGINT AS rows FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 2 AND 6)")
def cardinality_gate(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 6")
    return g.agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("rows"))
