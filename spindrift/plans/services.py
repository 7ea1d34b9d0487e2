"""Queries on services and streams: a source with pushed filters, claims, locks, heartbeats."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from ..sources import service as S
from ..sources.scratch import Scratch
from ..sources.service import opened, put_once
from ..sources.tables import append, paged_source, table
from ..streaming import jobs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def streamed(spark, d, name):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 100 AND 400")
def service_orders(spark, d):
    """Orders put into a record service and read back, the filter pushed to it."""
    root, columns = Scratch(spark).path("service"), "o_orderkey long, o_custkey long, o_orderstatus string"
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartitionByRange("o_custkey")
    rows.write.format(S.registered(spark)).option("path", root).mode("append").save()
    return spark.read.format(S.NAME).option("path", root).option("columns", columns).load().where("o_orderstatus = 'F' and o_custkey >= 100 and o_custkey <= 400")


@query("SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, c_acctbal > 0 AS fresh FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, c_acctbal::DOUBLE, false FROM customer WHERE c_custkey % 4 = 0")
def appended_rows(spark, d):
    """Two batches appended to one table."""
    path = Scratch(spark).path("appended")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    append(rows.where("c_acctbal > 0").withColumn("fresh", F.lit(True)), path)
    append(rows.where("c_custkey % 4 = 0").withColumn("fresh", F.lit(False)), path)
    return spark.read.schema("c_custkey long, c_acctbal double, fresh boolean").parquet(path)


@query("SELECT s_suppkey FROM supplier")
def claimed_once(spark, d):
    """Suppliers as chunks that three workers want at once: each is claimed by one of them."""
    root = Scratch(spark).path("pool")
    wanted = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(*[F.lit(w) for w in "abc"])).alias("worker")).repartition(F.col("worker"), F.col("s_suppkey") % 4)

    def run(batches):
        for batch in batches:
            won = [k for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if put_once(f"{root}/claims", str(k), w.encode())]
            yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], names=["s_suppkey"])

    return Scratch(spark).keep(wanted.mapInArrow(run, "s_suppkey long"), "claimed")  # claims count once, so the result is kept


HOLD = 6 * 3_600_000


@query(f"""
WITH e AS (SELECT user_id::VARCHAR AS key, event_id AS id, epoch_us(ts) // 1000 AS asked, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
g AS (SELECT key, id, asked, {HOLD} * n + max(asked - {HOLD} * n) OVER (PARTITION BY key ORDER BY n) AS granted, max(asked) OVER (PARTITION BY key) AS last FROM e)
SELECT key, id, asked AS asked_ms, granted::BIGINT AS granted_ms FROM g WHERE granted <= greatest(last, (SELECT epoch_us(max(ts)) // 1000 FROM events) - 60500)""")
def stream_locks(spark, d):
    """Who asks for a user's lock gets it for six hours, others wait in line; those whose turn comes by the end of the stream."""
    return jobs.run_available(jobs.lock_grants(streamed(spark, d, "events"), "user_id", "event_id", "ts", HOLD, "60500 milliseconds"), spark, "append")


@query("SELECT user_id::VARCHAR AS key, max(epoch_us(ts) // 1000) AS at_ms FROM events GROUP BY user_id")
def stream_heartbeats(spark, d):
    return jobs.run_available(jobs.beat_upserts(streamed(spark, d, "events"), "user_id", "ts"), spark, "update", "key").select("key", "at_ms")


@query("""
SELECT c_nationkey::VARCHAR AS key, c_custkey, c_acctbal::DOUBLE AS c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 20""")
def token_paged_rows(spark, d):
    """Customers of a service that gives ten a page and a token for the next: two pages of each nation."""
    root = Scratch(spark).path("pages")
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_nationkey").alias("key"))
    rows.repartition("key").sortWithinPartitions("key", "c_custkey").write.option("maxRecordsPerFile", 10).partitionBy("key").parquet(root)

    def fetch(key, token):
        fs, path = opened(root)
        names = sorted(f.path for f in fs.get_file_info(pf.FileSelector(f"{path}/key={key}", allow_not_found=True)) if f.path.endswith(".parquet"))
        at = int(token or 0)
        if at >= len(names):
            return [], None
        with fs.open_input_file(names[at]) as file:
            page = pq.read_table(file, columns=["c_custkey", "c_acctbal"])
        return list(zip(*(c.to_pylist() for c in page.columns))), str(at + 1) if at + 1 < len(names) else None

    keys = [str(r[0]) for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25 nations
    spark.dataSource.register(paged_source("customer_pages", "key string, c_custkey long, c_acctbal double", fetch, keys, 2))
    return spark.read.format("customer_pages").load()
