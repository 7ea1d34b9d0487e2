"""Queries on scalar rules, look-ups and small folds, each against SQL of its own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import external as E
from ..functions import rules as L
from ..functions import scalars as X
from ..operators import relational as R
from ..operators import sequences as Q
from ..operators import similarity as M
from ..sources.tables import one_row, parsed, table, table_or_empty

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH o AS (SELECT o_orderkey, floor(o_totalprice * o_totalprice / 100)::DOUBLE AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 100000000 THEN regexp_replace(round((n / 100000000)::DECIMAL(30,10), 1)::DECIMAL(30,1)::VARCHAR, '\\.0$', '') || '억' WHEN n >= 10000 THEN regexp_replace(round((n / 10000)::DECIMAL(30,10), 1)::DECIMAL(30,1)::VARCHAR, '\\.0$', '') || '만' ELSE format('{:,}', n::BIGINT) END AS short,
  CASE WHEN n >= 100000000 THEN round((n / 100000000)::DECIMAL(30,10), 1)::DECIMAL(30,1)::VARCHAR || '억원' WHEN n >= 10000 THEN format('{:,}', floor(n / 10000 + 0.5)::BIGINT) || '만원' ELSE format('{:,}', n::BIGINT) || '원' END AS won FROM o""")
def money_labels(spark, d):
    n = F.floor(F.col("o_totalprice") * F.col("o_totalprice") / 100)
    return table(spark, d, "orders").select("o_orderkey", X.compact(n).alias("short"), X.won(n).alias("won"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lpad(p_partkey::VARCHAR, 11, 'a') WHEN 1 THEN lpad(p_partkey::VARCHAR, 11, '_') WHEN 2 THEN lpad(p_partkey::VARCHAR, 11, '-') ELSE 'none' END AS video,
  replace(p_name, ' ', '%20') AS encoded, CASE WHEN p_partkey % 3 = 0 THEN 'mov' ELSE 'mp4' END AS ext FROM part""")
def address_parts(spark, d):
    k = F.col("p_partkey")
    code = lambda c: F.lpad(k.cast("string"), 11, c)
    url = F.when(k % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), code("a"), F.lit("&t=1"))).when(k % 4 == 1, F.concat(F.lit("https://youtu.be/"), code("_"))).when(k % 4 == 2, code("-")).otherwise("https://example.org/")
    name = F.when(k % 3 == 0, "clip.old.MOV").otherwise("clip")
    return table(spark, d, "part").select("p_partkey", F.coalesce(X.video_id(url), F.lit("none")).alias("video"), X.percent_encoded(F.col("p_name")).alias("encoded"), X.extension(name).alias("ext"))


@query("""SELECT o_orderkey, floor((epoch_us(TIMESTAMP '2001-09-01 10:00:00') - epoch_us(o_orderdate)) / 86400000000.0 + 0.5)::BIGINT AS near, floor((epoch_us(TIMESTAMP '2001-09-01 10:00:00') - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS full FROM orders""".replace(" AS full", " AS whole"))
def day_differences(spark, d):
    now, then = F.lit("2001-09-01 10:00:00").cast("timestamp_ntz"), F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", X.days_between(now, then).alias("near"), X.days_between(now, then, False).alias("whole"))


@query("""SELECT p_partkey, (p_size + p_retailprice) / 2 AS mean, concat_ws(',', CASE WHEN p_size < 10 THEN 'short' END, CASE WHEN p_retailprice > 1000 THEN 'large' END) AS warnings FROM part""")
def scene_means(spark, d):
    log = F.concat(F.lit("scene_score="), F.col("p_size").cast("string"), F.lit(" x\nscene_score: "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    found = X.numbers_after(log, "scene_score")
    mean = F.coalesce(F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(found), F.lit(0)), F.lit(0.0))
    marks = X.warnings(short=F.col("p_size") < 10, large=F.col("p_retailprice") > 1000)
    return table(spark, d, "part").select("p_partkey", mean.alias("mean"), F.array_join(marks, ",").alias("warnings"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '제목 없음' ELSE c_name END AS title, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END, 0) AS views, c_custkey % 4 = 1 AS flag FROM customer""")
def nested_defaults(spark, d):
    """Fields of a nested value with defaults; a flag counts only where it is 'true', 'Y' or 1."""
    k = F.col("c_custkey")
    snippet = F.when(k % 3 == 1, F.struct(F.col("c_name").alias("title"))).when(k % 3 == 2, F.struct(F.col("c_name").alias("title")))
    flag = F.element_at(F.array(F.lit("false"), F.lit("true"), F.lit("no"), F.lit(None)), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", X.falsy(snippet["title"], "제목 없음").alias("title"), X.number(F.when(k % 5 > 0, F.col("c_acctbal"))).alias("views"), L.truth(flag).alias("flag"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'none' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' ELSE 'bad' END AS state FROM customer""")
def salvaged_answers(spark, d):
    """Answers in JSON: plain, in fences, cut off in a list, none."""
    k, name = F.col("c_custkey"), F.concat(F.lit('{"name":"'), F.col("c_name"), F.lit('"}'))
    body = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("```json\n"), name, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("Here: ["), name, F.lit(',{"name":"cut'))).otherwise("no answer")
    rows = table(spark, d, "customer").select("c_custkey", E.salvaged_udf(body).alias("json"))
    found = F.coalesce(F.get_json_object("json", "$.name"), F.get_json_object("json", "$[0].name"))
    return rows.select("c_custkey", F.coalesce(found, F.lit("none")).alias("name"), F.when(found.isNull(), "bad").otherwise("ok").alias("state"))


@query("SELECT c_custkey, '{\"n\":' || c_custkey || '}' AS braces, c_custkey % 2 = 0 AS valid FROM customer")
def tolerant_json(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("x {"), F.lit('"n":'), k.cast("string"), F.lit("} y"))
    rows = table(spark, d, "customer").select("c_custkey", X.json_between_braces(text).alias("braces"), F.when(k % 2 == 0, X.json_between_braces(text)).otherwise("{bad").alias("body"))
    return parsed(rows, "body", "n long").select("c_custkey", "braces", F.col("error").isNull().alias("valid"))


@query("SELECT c_nationkey AS nation, min(c_custkey) AS first, count(*) AS n, greatest(1, ceil(count(*) / 20.0))::BIGINT AS pages FROM customer GROUP BY c_nationkey")
def first_and_pages(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    first = R.first_by(c, ["nation"], [F.col("c_custkey")]).withColumnRenamed("c_custkey", "first")
    n = c.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    return first.join(n, "nation").select("nation", "first", "n", R.pages(F.col("n"), 20).alias("pages"))


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey")
def batched_lookup(spark, d):
    """Names looked up in batches of 50 keys by a function that stands for a service."""
    names = {r.n_nationkey: r.n_name for r in table(spark, d, "nation").collect()}  # the service's own table, 25 rows

    def service(keys: pd.DataFrame) -> pd.DataFrame:
        assert len(keys) <= 50
        return keys.assign(nation=keys["c_nationkey"].map(names))[["c_custkey", "nation"]]

    return M.in_batches(table(spark, d, "customer").select("c_custkey", "c_nationkey"), service, "c_custkey long, nation string")


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 5 = 4 THEN '' ELSE role END, ''), '1') AS speaker, turn * 1000 + turn % 3 * 700 AS s, turn * 1000 + 400 AS e, text FROM conversations WHERE trim(text, ' ') <> ''),
n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND s - lag(e) OVER w <= 1200 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT conv_id, k::BIGINT AS island, arg_min(s, turn) AS ms, arg_max(e, turn) AS end_ms, arg_min(speaker, turn) AS speaker FROM i GROUP BY conv_id, k""")
def speaker_lines(spark, d):
    t = F.col("turn")
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.when(t % 5 == 4, "").otherwise(F.col("role")).alias("speaker"), (t * 1000 + t % 3 * 700).alias("start_ms"), (t * 1000 + 400).alias("end_ms"), "text")
    return Q.lines(tokens, ["conv_id"], "turn").select("conv_id", "island", "ms", "end_ms", "speaker")


@query("""SELECT p_partkey, s::DOUBLE AS start, e::DOUBLE AS "end" FROM (SELECT p_partkey, p_size % 7 AS s, p_size % 7 + 2 AS e FROM part UNION ALL SELECT p_partkey, p_size % 7 + 5, 60 FROM part WHERE p_partkey % 2 = 0)""")
def silence_intervals(spark, d):
    s = F.col("p_size") % 7
    at = lambda x: x.cast("string")
    log = F.concat(F.lit("silence_start: "), at(s), F.lit("\nsilence_end: "), at(s + 2), F.lit(" | x\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("silence_start: "), at(s + 5))).otherwise(""))
    return table(spark, d, "part").select("p_partkey", F.inline(Q.silence_events(log, F.lit(60.0))))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P'")
def row_rules(spark, d):
    """What a user may read and what they may change: all open rows, and their own."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_custkey").cast("string").alias("owner"))
    own = R.visible_to(o, "owner", "7", "update").select("o_custkey", "o_orderkey")
    read = R.visible_to(o, "owner", "7").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    return own.unionByName(read).distinct()


@query("""
WITH c AS (SELECT o_custkey AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), k AS (SELECT id, id % 7 AS place FROM c WHERE id % 3 = 0)
SELECT id, place::INT AS place, '상' AS grade FROM k ORDER BY place, id LIMIT 5""")
def ranked_candidates(spark, d):
    """Candidates in the order of a ranking; without any match the first ones, for reference."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    ranking = c.where("id % 3 = 0").select("id", (F.col("id") % 7).cast("int").alias("p"), F.lit("상").alias("grade"), F.lit("").alias("reason"))
    ranking = ranking.select("id", (F.col("p") * 1_000_000 + F.col("id")).alias("place"), "grade", "reason")
    out = E.ranked_or_first(c, ranking, "id", "id")
    return out.select("id", F.floor(F.col("place") / 1_000_000).cast("int").alias("place"), "grade")


@query("SELECT r_regionkey, r_name, 0 AS missing FROM region WHERE r_regionkey = 2")
def single_row(spark, d):
    """A row by its key, and a table that isn't there."""
    row = one_row(table(spark, d, "region").where("r_regionkey = 2"))
    missing = table_or_empty(spark, f"{d}/no_such_table.parquet", "k int")
    return missing.agg(F.count(F.lit(1)).cast("int").alias("missing")).select(F.lit(row.r_regionkey).alias("r_regionkey"), F.lit(row.r_name).alias("r_name"), "missing")


@query("""SELECT vec_id, bit_count(h)::INT AS bits FROM (SELECT vec_id, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN floor((embedding[i // 8 * 7 + i % 8 + 1] + 1) * 100) > floor((embedding[i // 8 * 7 + i % 8 + 2] + 1) * 100) THEN 1::HUGEINT << i::INT ELSE 0 END))::HUGEINT AS h FROM embeddings)""")
def difference_prints(spark, d):
    """Brightness of neighbours in a grid of 9 x 8 numbers, rows of which overlap by two, as 64 bits."""
    level = F.transform("embedding", lambda x: F.floor((x.cast("float") + F.lit(1).cast("float")) * F.lit(100).cast("float")))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(level, y * 7 + 1, F.lit(9))))
    return table(spark, d, "embeddings").select("vec_id", F.bit_count(X.difference_hash(grid)).alias("bits"))
