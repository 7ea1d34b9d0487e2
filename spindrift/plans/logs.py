"""Queries on logs, quotas, caches and job queues, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import state as S
from ..operators import relational as R
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
AS_OF = "2024-01-20 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(f"SELECT event_type, count(*) AS used FROM events WHERE (ts + INTERVAL 9 HOUR)::DATE = (TIMESTAMP '{AS_OF}' + INTERVAL 9 HOUR)::DATE GROUP BY event_type")
def feature_usage_kst(spark, d):
    return S.usage_today(table(spark, d, "events"), "event_type", "ts", as_of())


@query("""
WITH o AS (SELECT CASE WHEN event_type = 'error' AND value > 50 THEN 'blocked' WHEN event_type <> 'error' THEN 'ok' WHEN value > 20 THEN 'quota_free' ELSE 'error' END AS o FROM events)
SELECT count(*) FILTER (WHERE o = 'blocked') AS blocked, count(*) FILTER (WHERE o = 'ok') AS ok, count(*) FILTER (WHERE o = 'quota_free') AS quota_free, count(*) FILTER (WHERE o = 'error') AS error,
       count(*) AS total, CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (WHERE o = 'error') * 100 / count(*) + 0.5)::BIGINT ELSE 0 END AS fail_rate FROM o""")
def outcome_breakdown(spark, d):
    e = table(spark, d, "events").withColumns({"blocked": (F.col("event_type") == "error") & (F.col("value") > 50), "ok": F.col("event_type") != "error", "code": F.when(F.col("value") > 20, "QUOTA_USER_DAILY_FREE").otherwise("E")})
    return S.outcomes(e, "blocked", "ok", "code")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, (ts + INTERVAL 9 HOUR)::DATE ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 2")
def quota_reject(spark, d):
    e = table(spark, d, "events").withColumn("day", X.local_date(F.col("ts")))
    return S.admitted(e, ["user_id", "day"], "ts", "event_id", F.lit(2)).where("not admitted").select("event_id")


@query(f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY")
def ttl_hits(spark, d):
    return S.fresh(table(spark, d, "events"), "ts", as_of(), "5 DAYS").select("event_id")


@query(f"SELECT ts::DATE >= TIMESTAMP '{AS_OF}'::DATE - 10 AS kept, count(*) AS n FROM events GROUP BY kept")
def retention_split(spark, d):
    return S.retention(table(spark, d, "events").withColumn("day", F.to_date("ts")), "day", as_of(), 10).groupBy("kept").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median, count(value) AS n, greatest(180000, floor(list_sort(list(value))[count(value) // 2 + 1] * 100 * 2.5::DOUBLE * 1000 + 0.5))::BIGINT AS deadline_ms FROM events GROUP BY event_type")
def upper_median_stage(spark, d):
    return S.deadlines(table(spark, d, "events"), "event_type", "value", F.lit(100))


@query("WITH m AS (SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median, count(value) AS n FROM events GROUP BY event_type) SELECT event_id FROM events JOIN m USING (event_type) WHERE n >= 4 AND value > 3.0::DOUBLE * median")
def straggler_flags(spark, d):
    return S.outliers(table(spark, d, "events"), "event_type", "value").select("event_id")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 12")
def last_twelve(spark, d):
    return S.last_samples(table(spark, d, "events"), "event_type", "event_id").select("event_type", "event_id")


@query(f"""
WITH b AS (SELECT user_id, max(CASE WHEN ts >= TIMESTAMP '2024-01-10' - INTERVAL 30 SECOND AND ts <= TIMESTAMP '{AS_OF}' THEN ts END) AS last_beat FROM events GROUP BY user_id)
SELECT user_id, last_beat, CASE WHEN last_beat IS NULL THEN epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(TIMESTAMP '2024-01-10') > 120000000 ELSE epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_beat) > 36000000000 END AS stalled FROM b""")
def stalled_jobs(spark, d):
    beats = table(spark, d, "events").withColumn("at", F.when(F.col("ts") <= as_of(), F.col("ts"))).withColumn("submitted", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return S.stalled(beats, ["user_id"], "at", "submitted", as_of(), gap=36000).select("user_id", "last_beat", "stalled")


@query("SELECT event_id, gap FROM (SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events) WHERE gap > 86400")
def beat_gaps(spark, d):
    return S.beat_gaps(table(spark, d, "events"), ["user_id"], "ts", "event_id", 86400).select("event_id", "gap")


@query(f"""
WITH j AS (SELECT o_orderkey AS job, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status, 1 AS attempts, TIMESTAMP '2024-01-19' AS started_at FROM orders),
b AS (SELECT user_id AS job, max(ts) AS last_beat FROM events GROUP BY user_id),
x AS (SELECT j.*, status = 'running' AND greatest(coalesce(last_beat, started_at), started_at) < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 10 MINUTE AS orphan FROM j LEFT JOIN b USING (job))
SELECT job, CASE WHEN orphan THEN 'queued' ELSE status END AS status, CASE WHEN orphan THEN 0 ELSE attempts END AS attempts, orphan FROM x""")
def orphan_requeue(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), status.alias("status"), F.lit(1).alias("attempts"), F.lit("2024-01-19 00:00:00").cast("timestamp_ntz").alias("started_at"))
    beats = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"))
    return S.requeued(jobs, beats, "job", "started_at", F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")).select("job", "status", "attempts", "orphan")


@query("SELECT user_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS calls FROM events GROUP BY user_id, window_start HAVING count(*) > 2")
def rate_limited(spark, d):
    return S.rate_limited(table(spark, d, "events"), ["user_id"], "ts", "6 hours", 2)


@query("""
WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, session::BIGINT AS session, min(ts) AS began, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, session""")
def sessionize(spark, d):
    return S.sessions(table(spark, d, "events"), ["user_id"], "ts", "event_id", 43200)


@query("SELECT event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 30 GROUP BY event_type")
def oldest_queued(spark, d):
    jobs = table(spark, d, "events").withColumn("status", F.when(F.col("value") > 30, "queued").otherwise("done"))
    return S.oldest_queued(jobs, ["event_type"], "ts", "event_id").select("event_type", "ts", "event_id")


@query("SELECT props, min(event_id) AS first, count(*) AS again FROM events GROUP BY props")
def enqueued_once(spark, d):
    e = table(spark, d, "events")
    one = S.enqueued_once(e.select("props", "event_id"), "props", "event_id", "event_id").withColumnRenamed("event_id", "first")
    return one.join(e.groupBy("props").agg(F.count(F.lit(1)).alias("again")), "props")


@query("SELECT event_id FROM events QUALIFY min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) IS NULL OR event_id <= min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id)")
def until_first_hit(spark, d):
    return S.until_first_hit(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("event_id")


@query("SELECT count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS active, CASE WHEN count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) >= 3 THEN 3 ELSE 5 END AS workers FROM orders")
def congestion_workers(spark, d):
    return S.workers(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").alias("status")))


@query("SELECT strftime(ts, '%Y-%m') AS month, user_id, count(*) AS used FROM events GROUP BY ALL")
def monthly_usage(spark, d):
    return table(spark, d, "events").groupBy(X.month(F.col("ts")).alias("month"), "user_id").agg(F.count(F.lit(1)).alias("used"))


@query("SELECT max(CASE WHEN key = 'error' THEN n END) AS error, coalesce(max(CASE WHEN key = 'view' AND n <= 100 THEN n END), 5.0)::DOUBLE AS view, 2.5::DOUBLE AS missing FROM (SELECT event_type AS key, count(*)::DOUBLE AS n FROM events GROUP BY event_type)")
def typed_settings(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return R.settings(rows, {"error": 0, "view": 5, "missing": 2.5}, high={"view": 100})


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS day, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS day_start, strftime(ts, '%Y-%m') AS month, CASE WHEN ts::DATE = DATE '2024-01-20' THEN strftime(ts, '%H:%M') ELSE strftime(ts, '%Y.%m.%d') END AS label FROM events")
def clock_labels(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", X.local_date(ts).cast("string").alias("day"), X.local_day_start(ts).alias("day_start"), X.month(ts).alias("month"), X.date_label(ts, as_of()).alias("label"))


@query("SELECT user_id, ts::DATE::VARCHAR AS day, count(*) AS used FROM events GROUP BY ALL")
def stream_usage(spark, d):
    """The streaming form of daily usage, run over the stored events until they are read."""
    from ..streaming.jobs import daily_usage, run_available

    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return run_available(daily_usage(events, "ts", "user_id"), spark).select(F.col("key").alias("user_id"), F.col("day").cast("string").alias("day"), "used")
