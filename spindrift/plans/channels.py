"""Queries on entities, their children and their daily snapshots: customers stand for channels, orders for videos,
events for snapshots and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..functions import values as V
from ..operators import relational as R
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
#: The same expressions for DuckDB.
TYPE_SQL = "CASE WHEN share IS NULL THEN '' WHEN share >= 0.8 THEN '숏폼' WHEN share <= 0.2 THEN '롱폼' ELSE '혼합' END"
GRADE_SQL = "CASE WHEN daily IS NULL THEN '' WHEN daily >= 5000000 THEN 'S' WHEN daily >= 1000000 THEN 'A' WHEN daily >= 300000 THEN 'B' WHEN daily >= 100000 THEN 'C' ELSE 'D' END"
VIDEO_SQL = "SELECT o_custkey, count(*) AS videos, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS share, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS views FROM orders GROUP BY o_custkey"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def videos(spark: SparkSession, d: str) -> DataFrame:
    """By channel: number of videos, share of shorts, views."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("videos"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("views"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their videos' figures; views of all videos count as a day's."""
    both = table(spark, d, "customer").join(videos(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.withColumns({"type": X.channel_type(F.col("share")), "daily": F.col("views"), "grade": X.grade(F.col("views"))})


CHANNEL_SQL = f"SELECT c.*, v.videos, v.share, v.views, v.views AS daily, {TYPE_SQL} AS type FROM customer c LEFT JOIN ({VIDEO_SQL}) v ON c.c_custkey = v.o_custkey"


@query(f"""
WITH c AS ({CHANNEL_SQL}), g AS (SELECT *, {GRADE_SQL} AS grade FROM c WHERE c_acctbal >= 0 AND c_acctbal < 5000)
SELECT row_number() OVER (ORDER BY coalesce(daily, 0) DESC, c_custkey) AS rank, c_custkey, c_name, type, grade, daily,
       CASE WHEN daily > 0 THEN daily * CASE type WHEN '숏폼' THEN 0.15::DOUBLE WHEN '롱폼' THEN 2.5::DOUBLE ELSE 0.8::DOUBLE END END AS money
FROM g ORDER BY rank LIMIT 50""")
def today_ranking(spark, d):
    rows = channels(spark, d).where((F.col("c_acctbal") >= 0) & (F.col("c_acctbal") < 5000))
    first = R.page(rows, [F.coalesce("daily", F.lit(0)).desc(), F.col("c_custkey")], 1, 50)
    return first.select(F.col("rank").cast("long").alias("rank"), "c_custkey", "c_name", "type", "grade", "daily", X.revenue(F.col("daily"), F.col("type")).alias("money"))


@query(f"SELECT type, count(*) AS channels FROM ({CHANNEL_SQL}) GROUP BY type")
def type_share(spark, d):
    return channels(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("channels"))


@query(f"SELECT grade, count(*) AS channels FROM (SELECT {GRADE_SQL} AS grade FROM ({CHANNEL_SQL})) GROUP BY grade")
def grade_counts(spark, d):
    return channels(spark, d).groupBy("grade").agg(F.count(F.lit(1)).alias("channels"))


@query("""
WITH f AS (SELECT max(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS daily FROM orders)
SELECT c_custkey, count(o_orderkey) AS video_count, count(*) FILTER (WHERE CASE WHEN f.daily = 1 THEN o_totalprice >= 100000 ELSE o_totalprice >= 500000 END) AS rocket,
       avg(CASE WHEN o_orderstatus = 'F' THEN date_part('day', o_orderdate) END)::DOUBLE AS short_avg, avg(CASE WHEN o_orderstatus <> 'F' THEN date_part('day', o_orderdate) END)::DOUBLE AS long_avg
FROM customer LEFT JOIN orders ON c_custkey = o_custkey, f GROUP BY c_custkey""")
def rocket_metrics(spark, d):
    orders = table(spark, d, "orders")
    any_daily = R.any_row(orders, F.col("o_totalprice") > 450000)
    fast = F.col("o_totalprice") >= F.col("least")
    orders = orders.withColumn("least", F.when(any_daily, V.ROCKET_DAILY).otherwise(V.ROCKET_TOTAL))
    short, length = F.col("o_orderstatus") == "F", F.dayofmonth("o_orderdate")
    own = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("video_count"), F.count_if(fast).alias("rocket"), F.avg(F.when(short, length)).alias("short_avg"), F.avg(F.when(~short, length)).alias("long_avg"))
    both = table(spark, d, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.select("c_custkey", F.coalesce("video_count", F.lit(0)).alias("video_count"), F.coalesce("rocket", F.lit(0)).alias("rocket"), "short_avg", "long_avg")


def snapshots(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(18,4)").alias("views"), F.count(F.lit(1)).alias("n"))


SNAPSHOT_SQL = "SELECT user_id, ts::DATE AS day, sum(value::DECIMAL(18,4))::DECIMAL(18,4) AS views, count(*) AS n FROM events GROUP BY user_id, ts::DATE"


@query(f"WITH s AS ({SNAPSHOT_SQL}) SELECT t.user_id, t.day::VARCHAR AS day, t.n, (t.n - y.n)::DOUBLE AS daily_n, (t.views - y.views)::DOUBLE AS daily_views FROM s t LEFT JOIN s y ON y.user_id = t.user_id AND y.day = t.day - 1")
def snapshot_delta(spark, d):
    return R.daily_delta(snapshots(spark, d), "user_id", "day", ["views", "n"]).select("user_id", F.col("day").cast("string").alias("day"), "n", F.col("daily_n").cast("double").alias("daily_n"), F.col("daily_views").cast("double").alias("daily_views"))


@query(f"WITH s AS ({SNAPSHOT_SQL}) SELECT count(*) AS rows, count(*) FILTER (WHERE y.n IS NULL) AS without_yesterday FROM s t LEFT JOIN s y ON y.user_id = t.user_id AND y.day = t.day - 1")
def snapshot_delta_gap_null(spark, d):
    out = R.daily_delta(snapshots(spark, d), "user_id", "day", ["n"])
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("daily_n").isNull()).alias("without_yesterday"))


@query(f"WITH s AS ({SNAPSHOT_SQL}) SELECT user_id, day::VARCHAR AS day, n FROM s WHERE day = (SELECT max(day) FROM s)")
def latest_day_rows(spark, d):
    return R.latest(snapshots(spark, d), "day").select("user_id", F.col("day").cast("string").alias("day"), "n")


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def topn_children(spark, d):
    return R.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, o_orderkey, (CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE -((rank - 1) // 2) END)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5")
def center_out(spark, d):
    top = R.top_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return top.select("o_custkey", "o_orderkey", R.centre_out(F.col("rank")).alias("place"))


@query(f"WITH s AS ({SNAPSHOT_SQL}) SELECT user_id, day::VARCHAR AS day, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS r FROM s) WHERE r <= 3")
def oldest_n_snapshots(spark, d):
    return R.top_n(snapshots(spark, d), ["user_id"], [F.col("day")], 3).select("user_id", F.col("day").cast("string").alias("day"), "n")


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal > 0 THEN false END) IS NOT TRUE")
def not_true_filter(spark, d):
    locked = F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") > 0, False)
    return table(spark, d, "customer").where(~F.coalesce(locked, F.lit(False))).select("c_custkey")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END, ''), '기타') AS category FROM customer WHERE coalesce(nullif(CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END, ''), '기타') IN ('기타', 'BUILDING')")
def default_category_filter(spark, d):
    category = X.falsy(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise(""), V.OTHER_CATEGORY)
    return table(spark, d, "customer").select("c_custkey", category.alias("category")).where(F.col("category").isin(V.OTHER_CATEGORY, "BUILDING"))


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN c_mktsegment END) IS DISTINCT FROM 'BUILDING'")
def null_safe_exclude(spark, d):
    status = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return table(spark, d, "customer").where(~status.eqNullSafe("BUILDING")).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR contains(lower(p_type), 'st')")
def ilike_search(spark, d):
    return table(spark, d, "part").where(F.col("p_name").ilike("%re%") | F.contains(F.lower("p_type"), F.lit("st"))).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 500 AND c_acctbal < 5000")
def bucket_filter(spark, d):
    low, high = map(float, "500-5000".split("-"))
    return table(spark, d, "customer").where((F.col("c_acctbal") >= low) & (F.col("c_acctbal") < high)).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer QUALIFY rank BETWEEN 21 AND 40")
def page_band(spark, d):
    out = R.page(table(spark, d, "customer"), [F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey")], 2, 20)
    return out.select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT c_custkey, row_number() OVER (ORDER BY (CASE WHEN (SELECT max(c_acctbal) FROM customer) > 100000 THEN c_acctbal ELSE c_custkey END) DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 100""")
def fallback_sort(spark, d):
    customers = table(spark, d, "customer")
    has_daily = R.any_row(customers, F.col("c_acctbal") > 100000)
    keyed = customers.withColumn("key", F.when(has_daily, F.col("c_acctbal")).otherwise(F.col("c_custkey")))
    return R.page(keyed, [F.desc("key"), F.col("c_custkey")], 1, 100).select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""
WITH t AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS tier FROM customer),
p AS (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN -c_acctbal ELSE c_acctbal END, c_custkey) AS place FROM t)
SELECT c_custkey, tier, place FROM p WHERE place <= 200""")
def tiered_fill(spark, d):
    building = F.col("c_mktsegment") == "BUILDING"
    out = R.tiered(table(spark, d, "customer"), "c_custkey", [(building & (F.col("c_acctbal") > 9000), [F.col("c_acctbal"), F.col("c_custkey")]), (building, [F.desc("c_acctbal"), F.col("c_custkey")]), (F.lit(True), [F.col("c_acctbal"), F.col("c_custkey")])], 200)
    return out.select("c_custkey", "tier", F.col("place").cast("long").alias("place"))


def _scores(spark, d):
    line = table(spark, d, "lineitem")
    return R.term_scores(line.withColumn("term", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey") % 40)), "term", F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", True))


SCORE_SQL = "SELECT term, count(*) AS found, count(*) FILTER (WHERE l_linestatus = 'F') AS faceless, count(*) FILTER (WHERE l_returnflag = 'A') AS approved FROM (SELECT *, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 40 END AS term FROM lineitem) WHERE term IS NOT NULL GROUP BY term"


@query(f"SELECT *, (approved * 3 + faceless)::DOUBLE / (found + 4) AS score FROM ({SCORE_SQL})")
def term_score(spark, d):
    return _scores(spark, d)


@query(f"""
WITH s AS (SELECT term, (approved * 3 + faceless)::DOUBLE / (found + 4) AS score FROM ({SCORE_SQL})), t AS (SELECT range::BIGINT AS term FROM range(60)),
a AS (SELECT t.term, s.score, row_number() OVER (PARTITION BY s.score IS NULL ORDER BY s.score DESC NULLS LAST, t.term) - 1 AS i FROM t LEFT JOIN s ON s.term = t.term),
n AS (SELECT count(score) AS tried, count(*) - count(score) AS untried FROM a),
p AS (SELECT term, CASE WHEN score IS NOT NULL AND i < least(tried, 13) THEN 0 WHEN score IS NULL AND ((i - 20000) % untried + untried) % untried < 16 - least(tried, 13) THEN 1 WHEN score IS NOT NULL THEN 2 ELSE 3 END AS step,
        CASE WHEN score IS NULL AND ((i - 20000) % untried + untried) % untried < 16 - least(tried, 13) THEN ((i - 20000) % untried + untried) % untried ELSE i END AS place FROM a, n)
SELECT term, step FROM p ORDER BY step, place LIMIT 16""")
def explore_exploit_terms(spark, d):
    return R.explore_exploit(spark.range(60).withColumnRenamed("id", "term"), _scores(spark, d), "term", "term", 20000).select("term", "step")


@query("SELECT l_suppkey, arg_min(l_partkey, (l_partkey % 40, l_partkey)) AS found_by, count(*) AS hits FROM lineitem GROUP BY l_suppkey")
def first_found_by(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_partkey", F.struct(F.col("l_partkey") % 40, "l_partkey")).alias("found_by"), F.count(F.lit(1)).alias("hits"))


@query("SELECT l_partkey % 40 AS term, count(DISTINCT l_suppkey) AS hits, count(DISTINCT CASE WHEN s_acctbal IS NULL OR s_acctbal <= 0 THEN l_suppkey END) AS new FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 GROUP BY term")
def new_by_term(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_acctbal")
    pairs = table(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("term"), "l_suppkey").distinct()
    return pairs.join(known, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("s_suppkey").isNull()).alias("new"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def fk_semi(spark, d):
    owners = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def candidate_anti(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey, c_name AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def embed_parent(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.col("c_name").alias("title"))


@query("SELECT p_partkey, coalesce(likes, 0) AS likes, row_number() OVER (ORDER BY coalesce(likes, 0) DESC, p_partkey DESC) AS rank FROM part LEFT JOIN (SELECT l_partkey, count(*) AS likes FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) ON p_partkey = l_partkey QUALIFY rank <= 30")
def likes_rank(spark, d):
    likes = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("likes"))
    out = R.with_default_count(table(spark, d, "part").select("p_partkey"), likes, "p_partkey", "likes")
    return R.page(out, [F.desc("likes"), F.desc("p_partkey")], 1, 30).select("p_partkey", "likes", F.col("rank").cast("long").alias("rank"))


@query("SELECT v.value, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(value) LEFT JOIN orders ON o_orderstatus = v.value GROUP BY v.value")
def status_counts_zero_fill(spark, d):
    return R.domain_counts(table(spark, d, "orders"), F.col("o_orderstatus"), ["F", "O", "P", "X"], "O")


@query("""
WITH s AS (SELECT c_custkey AS id, c_acctbal AS v, c_mktsegment AS found FROM customer), n AS (SELECT c_custkey + 100 AS id, c_acctbal + 1 AS v, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS found FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE s.v END AS v, coalesce(n.found, s.found) AS found FROM s FULL JOIN n ON s.id = n.id""")
def merge_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("found"))
    new = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + 100).alias("id"), (F.col("c_acctbal") + 1).alias("v"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("found"))
    return R.merged_upsert(old, new, ["id"], ["found"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def replace_by_key(spark, d):
    o = table(spark, d, "orders")
    return R.replaced(o.select("o_custkey", "o_orderkey"), o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'new' END AS segment FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0")
def insert_ignore(spark, d):
    """A third of the customers is stored; the even ones come, each twice, with another value, which stored rows don't take."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 = 0").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("segment"))
    return R.insert_new(old, new.unionByName(new), ["c_custkey"])


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)brass') THEN 'metal' WHEN regexp_matches(p_type, '(?i)steel|tin') THEN 'iron' WHEN regexp_matches(p_name, 'a') THEN 'named' END AS category FROM part")
def regex_category(spark, d):
    kind = F.coalesce(X.first_match(F.col("p_type"), [("metal", "(?i)brass"), ("iron", "(?i)steel|tin")]), X.first_match(F.col("p_name"), [("named", "a")]))
    return table(spark, d, "part").select("p_partkey", kind.alias("category"))


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderdate, o_orderkey) AS titles FROM orders GROUP BY o_custkey")
def string_list(spark, d):
    item = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(item, lambda x: x["o_orderkey"].cast("string")), ", ").alias("titles"))


@query("SELECT * FROM (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'orders_done', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'customers', count(*) FROM customer)")
def digest_counts(spark, d):
    counts = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("orders_done")).selectExpr("stack(2, 'orders', orders, 'orders_done', orders_done) as (name, n)")
    return counts.unionByName(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customers").alias("name"), "n"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5 OR o_orderdate > TIMESTAMP '2001-01-01'")
def first_five_or_recent(spark, d):
    w = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").withColumn("r", w).where((F.col("r") <= 5) | (F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("WITH k AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'F') >= 3) SELECT c_custkey, c_name FROM customer JOIN k ON c_custkey = o_custkey")
def at_least_three(spark, d):
    k = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n")).where("n >= 3")
    return table(spark, d, "customer").join(k, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("SELECT s.l_orderkey AS story, count(*) AS scenes FROM lineitem s LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size < 40) p ON p.p_partkey = s.l_partkey GROUP BY s.l_orderkey HAVING bool_and(p.p_partkey IS NOT NULL)")
def whole_stories(spark, d):
    scenes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("story"), F.col("l_partkey").alias("p_partkey"))
    return R.all_or_nothing(scenes, table(spark, d, "part").where("p_size < 40"), "story", "p_partkey")


@query("SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def id_union(spark, d):
    return table(spark, d, "customer").select("c_custkey").union(table(spark, d, "orders").select("o_custkey")).union(table(spark, d, "supplier").select("s_suppkey")).distinct()


@query("""SELECT l_partkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS supplier, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BOOLEAN AS same FROM lineitem GROUP BY l_partkey""")
def dedupe_upgrade(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey").alias("o"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("supplier"))
    out = R.upgraded(rows, "l_partkey", "o", "kind", "R", [])
    return out.select("l_partkey", "supplier", (F.col("kind") == "R").alias("same"))
