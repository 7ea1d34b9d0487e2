"""Queries on access, decisions by rule, scores, searches, templates and job chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import imaging as G
from ..functions import rules as L
from ..functions import scalars as X
from ..functions import values as V
from ..operators import relational as R
from ..operators import sequences as Q
from ..operators import similarity as M
from ..operators import state as S
from ..sources import feeds
from ..sources.scratch import Scratch
from ..sources.tables import artifact, table

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
WITH f AS (SELECT event_type AS feature, length(event_type) % 2 = 0 AS is_public FROM events WHERE event_type <> 'error' GROUP BY event_type)
SELECT event_id, (user_id % 17 = 0 OR coalesce(is_public, false)) AS allowed FROM events LEFT JOIN f ON feature = event_type""")
def feature_gate(spark, d):
    e = table(spark, d, "events")
    flags = e.where("event_type <> 'error'").select(F.col("event_type").alias("feature"), (F.length("event_type") % 2 == 0).alias("is_public")).distinct()
    requests = e.select("event_id", F.col("event_type").alias("feature"), (F.col("user_id") % 17 == 0).alias("is_admin"))
    return R.gated(requests, flags, "feature", "is_admin").select("event_id", "allowed")


@query("""
WITH v AS (SELECT p_partkey AS id, p_size * 6 - 6 AS seconds FROM part), k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size < 20 END AS is_short FROM part WHERE p_partkey % 5 = 0)
SELECT v.id, coalesce((CASE WHEN k.id IS NOT NULL THEN k.is_short ELSE seconds > 0 AND seconds <= 180 END)::VARCHAR, 'unknown') AS is_short, k.id IS NULL AS checked FROM v LEFT JOIN k ON k.id = v.id""")
def short_decision(spark, d):
    p = table(spark, d, "part")
    videos = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 6 - 6).alias("seconds"))
    known = p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") < 20).alias("is_short"))
    out = R.known_or(videos, known, "id", "is_short", L.short_by_length(F.col("seconds")))
    return out.select("id", F.coalesce(F.col("is_short").cast("string"), F.lit("unknown")).alias("is_short"), "checked")


@query("""SELECT p_partkey, p_size * 6 <= 190 AND coalesce(CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END, p_size * 6 <= 60) AS trending_short FROM part""")
def probed_shorts(spark, d):
    status = F.when(F.col("p_partkey") % 4 == 0, 200).when(F.col("p_partkey") % 4 == 1, 303).when(F.col("p_partkey") % 4 == 2, 500)
    return table(spark, d, "part").select("p_partkey", L.trending_short(L.probe(status), F.col("p_size") * 6).alias("trending_short"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 11 AS hook, c_custkey % 7 AS novelty, c_custkey % 5 AS emotion, c_custkey % 9 AS density, c_custkey % 8 AS standalone, c_custkey % 3 AS proof, c_custkey % 6 AS duration_fit, c_custkey % 10 AS context_dep,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'sales' WHEN 'MACHINERY' THEN 'edu' ELSE lower(c_mktsegment) END AS objective FROM customer),
w(objective, hook, novelty, emotion, density, standalone, proof, duration_fit, context_indep) AS (VALUES ('views', 30, 20, 15, 10, 10, 5, 5, 5), ('sales', 15, 5, 10, 15, 15, 25, 5, 10), ('edu', 15, 10, 0, 25, 15, 20, 5, 10))
SELECT c.id, (c.hook * w.hook + c.novelty * w.novelty + c.emotion * w.emotion + c.density * w.density + c.standalone * w.standalone + c.proof * w.proof + c.duration_fit * w.duration_fit + (10 - c.context_dep) * w.context_indep) / 100.0::DOUBLE AS score
FROM c JOIN w ON w.objective = CASE WHEN c.objective IN ('sales', 'edu') THEN c.objective ELSE 'views' END""")
def objective_score(spark, d):
    k = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    objective = F.when(segment == "BUILDING", "sales").when(segment == "MACHINERY", "edu").otherwise(F.lower(segment))
    parts = {"hook": k % 11, "novelty": k % 7, "emotion": k % 5, "density": k % 9, "standalone": k % 8, "proof": k % 3, "duration_fit": k % 6}
    return table(spark, d, "customer").select(k.alias("id"), L.objective_score(parts, k % 10, objective).alias("score"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END DESC NULLS FIRST, c_custkey) AS rank FROM customer QUALIFY rank <= 60")
def implicit_null_order(spark, d):
    """A descending sort without a null order: many stores put nulls first there, Spark puts them last."""
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.col("c_acctbal")).alias("subscribers"))
    return R.page(rows, [R.store_desc("subscribers"), F.col("c_custkey")], 1, 60).select("c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR (o_totalprice > 200000) IS TRUE) AND (CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END IS NULL OR o_orderpriority = '1-URGENT')""")
def nested_filter(spark, d):
    rows = table(spark, d, "orders").withColumn("admin", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    return rows.where(R.all_of(R.any_of(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000), R.any_of(F.col("admin").isNull(), F.col("admin") == "1-URGENT"))).select("o_orderkey")


@query("SELECT page_id FROM pages WHERE NOT contains(url, '/1')")
def self_exclusion(spark, d):
    return table(spark, d, "pages").where(L.not_itself(F.col("url"), F.lit("/1"))).select("page_id")


@query("SELECT event_type, count(*) FILTER (WHERE starts_with(event_type || ':' || (event_id % 3)::VARCHAR, 'error')) AS failed, count(*) AS n FROM events GROUP BY event_type")
def prefix_status(spark, d):
    status = F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string"))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(L.has_failed(status, "error")).alias("failed"), F.count(F.lit(1)).alias("n"))


@query("""
WITH t AS (SELECT doc_id, length(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g')) AS a, length(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) ELSE text || '!?' END, '[^0-9A-Za-z가-힣]', '', 'g')) AS b FROM documents)
SELECT doc_id, a > 0 AND b >= 0.9::DOUBLE * a AND b <= 1.12::DOUBLE * a AS plausible FROM t WHERE a IS NOT NULL""")
def letters_ratio(spark, d):
    text = F.col("text")
    edited = F.when(F.col("doc_id") % 3 == 0, F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))).otherwise(F.concat(text, F.lit("!?")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", L.same_letters(text, edited).alias("plausible"))


@query("SELECT conv_id, string_agg(text, ' / ' ORDER BY turn) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE role = 'user') WHERE n <= 6 GROUP BY conv_id")
def first_six(spark, d):
    return R.first_of_each(table(spark, d, "conversations").where("role = 'user'"), ["conv_id"], "turn", "text", 6).select("conv_id", F.array_join("texts", " / ").alias("sample"))


@query("SELECT p_size, sum(p_retailprice * (p_partkey % 9)) / greatest(1, sum(p_partkey % 9)) AS mean FROM part GROUP BY p_size")
def area_mean(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(L.weighted_mean(F.col("p_retailprice"), F.col("p_partkey") % 9).alias("mean"))


@query("SELECT event_type, floor(sum(value::DECIMAL(18,4))::DOUBLE * 10 + 0.5) / 10 AS seconds, count(*) AS runs FROM events GROUP BY event_type")
def stage_stopwatch(spark, d):
    return S.stopwatch(table(spark, d, "events"), "event_type", F.col("value").cast("decimal(18,4)"))


@query("SELECT o_orderkey, least(99, greatest(0, floor(o_totalprice / 300000.0 * 100 + 0.5)))::INT AS percent FROM orders")
def progress_percent(spark, d):
    return table(spark, d, "orders").select("o_orderkey", L.progress(F.col("o_totalprice"), F.lit(300000.0)).alias("percent"))


@query("SELECT o_orderstatus AS kind, count(*) AS read, count(DISTINCT o_custkey) AS distinct_keys, count(*) FILTER (WHERE o_totalprice > 100000) AS checked FROM orders GROUP BY o_orderstatus")
def run_summary(spark, d):
    rows = table(spark, d, "orders").withColumn("kind", F.col("o_orderstatus"))
    return R.summary(rows, ["kind"], "o_custkey", F.col("o_totalprice") > 100000)


@query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) WHEN 1 THEN '🥇 1위' WHEN 2 THEN '🥈 2위' WHEN 3 THEN '🥉 3위'
  ELSE row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) || '위' END END AS medal FROM orders""")
def medal_ranks(spark, d):
    return R.rank_within(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", "place").select("o_custkey", "o_orderkey", L.medal(F.col("place")).alias("medal"))


@query("""
WITH g AS (SELECT p_size AS clip, p_partkey AS id, p_partkey % 700 AS frame, p_partkey % 97 + 20.0 AS x0, p_partkey % 97 + 50.0 AS x1, p_partkey * 7 % 300 + 0.0 AS yc, 20.0 + p_partkey % 30 AS h FROM part WHERE p_partkey % 3 > 0),
l AS (SELECT p_size AS clip, p_partkey AS line, p_partkey % 700 AS frame, 10.0 AS x0, 120.0 AS x1, p_partkey * 7 % 300 + 0.0 AS yc, 30.0 AS hmed FROM part WHERE p_partkey % 3 = 0)
SELECT g.id, min(line) AS line FROM g JOIN l ON g.clip = l.clip AND abs(g.frame - l.frame) <= 90 AND abs(l.yc - g.yc) < 30 AND l.x0 - 30 <= g.x0 AND g.x1 <= l.x1 + 30 AND g.h BETWEEN 0.6 * hmed AND 1.45 * hmed GROUP BY g.id""")
def single_glyph_lines(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    base = [F.col("p_size").alias("clip"), (k % 700).alias("frame"), (k * 7 % 300).cast("double").alias("yc")]
    glyphs = p.where(k % 3 > 0).select(*base, k.alias("id"), (k % 97 + 20.0).alias("x0"), (k % 97 + 50.0).alias("x1"), (F.lit(20.0) + k % 30).alias("h"))
    lines = p.where(k % 3 == 0).select(*base, k.alias("line"), F.lit(10.0).alias("x0"), F.lit(120.0).alias("x1"), F.lit(30.0).alias("hmed"))
    return Q.glyphs_in_lines(glyphs, lines, ["clip"]).select("id", "line")


@query("""
WITH b AS (SELECT p_size AS clip, p_partkey AS id, p_partkey // 50 % 40 AS frame, p_partkey * 13 % 60 AS x0, p_partkey * 13 % 60 + 40 AS x1 FROM part)
SELECT a.id, count(DISTINCT b.frame) AS support FROM b a JOIN b ON a.clip = b.clip AND a.frame <> b.frame AND abs(a.frame - b.frame) <= 6
WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 20 / (40.0 * 20 * 2 - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 20) > 0.3 GROUP BY a.id HAVING count(DISTINCT b.frame) >= 5""")
def stable_boxes(spark, d):
    k = F.col("p_partkey")
    boxes = table(spark, d, "part").select(F.col("p_size").alias("clip"), k.alias("id"), F.floor(k / 50).cast("long").alias("f"), (k * 13 % 60).alias("x0"), F.lit(0).alias("y0"), (k * 13 % 60 + 40).alias("x1"), F.lit(20).alias("y1"))
    boxes = boxes.withColumn("frame", F.col("f") % 40).drop("f")
    side = lambda of: {c: of(c) for c in ("x0", "y0", "x1", "y1")}
    return Q.support(boxes, ["clip"], "frame", lambda a, b: X.iou(side(a), side(b)) > 0.3).select("id", "support")


@query("""
WITH t AS (SELECT conv_id, turn, turn % 4 * 600000 AS base, turn * 170 % 700 * 1000 AS s, turn * 170 % 700 * 1000 + 45000 AS e FROM conversations)
SELECT conv_id, turn, base + greatest(0, least(600000, s)) AS start_ms, base + greatest(0, least(600000, s), least(600000, e)) AS end_ms FROM t""")
def global_times(spark, d):
    t = F.col("turn")
    local = table(spark, d, "conversations").select("conv_id", "turn", (t % 4 * 600000).alias("base"), (t * 170 % 700 * 1000).alias("s"), (t * 170 % 700 * 1000 + 45000).alias("e"))
    return Q.offset_clamped(local, "base", "s", "e", 600000).select("conv_id", "turn", "start_ms", "end_ms")


@query("""
WITH RECURSIVE p AS (SELECT p_partkey, p_size * 40 AS n FROM part WHERE p_size > 0),
c AS (SELECT p_partkey, n, 0 AS i, 0 AS s FROM p UNION ALL SELECT p_partkey, n, i + 1, least(s + 389, n - 401) FROM c WHERE s + 401 < n)
SELECT p_partkey, i, s::BIGINT AS s, least(n - 1, s + 400)::BIGINT AS e FROM c""")
def tail_chunks(spark, d):
    rows = table(spark, d, "part").where("p_size > 0").select("p_partkey", F.inline(Q.tail_chunks(F.col("p_size") * 40)))
    return rows.select("p_partkey", "i", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'desilence' WHEN '2-HIGH' THEN 'wmremove' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'transcribe' END END
  WHEN o_orderstatus = 'O' AND o_orderkey % 25 >= 10 THEN 'analyze' END AS next_job FROM orders""")
def next_jobs(spark, d):
    done = F.when(F.col("o_orderstatus") == "F", "probe").when(F.col("o_orderstatus") == "O", "transcribe").otherwise("render")
    objective = F.when(F.col("o_orderpriority") == "1-URGENT", "desilence").when(F.col("o_orderpriority") == "2-HIGH", "wm_remove").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", S.next_job(done, objective, F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 25).alias("next_job"))


@query("""
WITH c AS (SELECT o_custkey AS project, o_orderkey AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F')
SELECT project, (n - 1)::INT AS worker, chunk FROM c WHERE n <= 1 + project % 3""")
def claimed_chunks(spark, d):
    chunks = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("todo").alias("status"))
    workers = chunks.select("project").distinct().withColumn("worker", F.explode(F.sequence(F.lit(0), (F.col("project") % 3).cast("int"))))
    return S.claimed(chunks, workers, ["project"], "chunk", "worker")


@query("""SELECT o_custkey AS key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS at, o_orderkey::VARCHAR AS id, o_orderpriority AS title FROM orders""")
def exploded_items(spark, d):
    item = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"))
    answers = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("o_orderkey", item.alias("x"))))["x"].alias("items"))).alias("body"))
    return feeds.items(answers, "key", "body", "id string, title string")


CATEGORY_LIST = ", ".join(f"'{c}'" for c in V.CATEGORIES)


@query(f"""
WITH c AS (SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 6))::BIGINT % 16 AS n FROM customer)
SELECT c_custkey, CASE WHEN n < 15 THEN ([{CATEGORY_LIST}])[n + 1] ELSE '기타' END AS category, n < 15 AS valid FROM c""")
def category_batches(spark, d):
    """Asked in batches of 15 names; an answer outside the list of categories leaves the category as it was."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.lit(V.OTHER_CATEGORY).alias("category"))
    return L.asked_category(rows, "c_name", "category").select("c_custkey", "category", "valid")


@query("""SELECT c_custkey, substr('{"id":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}', 1, 50) AS cut FROM customer""")
def json_cut(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.json_cut(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), 50).alias("cut"))


@query("""
WITH m AS (SELECT p_partkey, p_size, p_size * p_size * 5 AS sec FROM part), r AS (SELECT *, floor(sec / 60.0 + 0.5) AS a, floor(sec / 30.0 + 0.5) AS b FROM m),
t AS (SELECT *, (CASE WHEN a >= 20 THEN greatest(5, floor(a / 5 + 0.5) * 5) ELSE greatest(1, a) END)::BIGINT AS lo, (CASE WHEN b >= 20 THEN greatest(5, floor(b / 5 + 0.5) * 5) ELSE greatest(1, b) END)::BIGINT AS hi0 FROM r),
u AS (SELECT *, CASE WHEN hi0 <= lo THEN lo + CASE WHEN lo >= 20 THEN 5 ELSE 1 END ELSE hi0 END AS hi FROM t)
SELECT p_partkey, CASE WHEN sec > 0 THEN '약 ' || CASE WHEN lo < 60 THEN lo || '분' WHEN lo % 60 = 0 THEN lo // 60 || '시간' ELSE lo // 60 || '시간 ' || lo % 60 || '분' END || '~' ||
  CASE WHEN hi < 60 THEN hi || '분' WHEN hi % 60 = 0 THEN hi // 60 || '시간' ELSE hi // 60 || '시간 ' || hi % 60 || '분' END ELSE '' END AS eta,
  CASE WHEN sec > 0 THEN greatest(4, floor((p_partkey % 40) / sec::DOUBLE * 100 + 0.5)) ELSE 100 END::INT AS bar FROM u""")
def eta_and_bar(spark, d):
    seconds = F.col("p_size") * F.col("p_size") * 5
    return table(spark, d, "part").select("p_partkey", L.eta_text(seconds).alias("eta"), L.length_bar(seconds, F.col("p_partkey") % 40).alias("bar"))


@query("SELECT c_custkey, c_custkey || ' | 채널명: ' || c_name || CASE WHEN t IS NULL THEN '' ELSE ' | 최근영상: ' || t END AS line FROM customer LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' / ' ORDER BY o_orderdate DESC, o_orderkey DESC) AS t FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3 GROUP BY o_custkey) ON o_custkey = c_custkey")
def prompt_lines(spark, d):
    newest = F.struct(F.lit(0) - F.unix_micros(F.col("o_orderdate").cast("timestamp")), -F.col("o_orderkey"))
    orders = table(spark, d, "orders").select("o_custkey", newest.alias("order"), F.col("o_orderkey").cast("string").alias("title"))
    titles = R.first_of_each(orders, ["o_custkey"], "order", "title", 3)
    rows = table(spark, d, "customer").join(titles, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", L.channel_line(F.col("c_custkey"), F.col("c_name"), F.col("texts")).alias("line"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'bolt']))), ' ') AS terms FROM part")
def literal_union(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(L.terms_union(F.split("p_name", " "), ["red", "bolt"])), " ").alias("terms"))


@query("SELECT p_partkey FROM part WHERE p_retailprice % 101 >= 70 AND p_size * 20 BETWEEN 8 AND 480")
def fit_threshold(spark, d):
    return table(spark, d, "part").where(L.fits(F.col("p_retailprice") % 101, F.col("p_size") * 20)).select("p_partkey")


@query("""
WITH u AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS i FROM orders)
SELECT 'UC' || o_custkey AS channel, o_orderkey AS video FROM u WHERE o_custkey % 3 = 0 AND i < 10 AND (i < 5 OR o_orderdate > TIMESTAMP '1997-06-01')""")
def recent_uploads(spark, d):
    orders = table(spark, d, "orders")
    channels = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("UC"), "c_custkey").alias("channel"))
    uploads = orders.select(F.concat(F.lit("UU"), "o_custkey").alias("playlist"), F.col("o_orderkey").alias("video"), F.col("o_orderdate").alias("published"))
    return feeds.recent_uploads(channels, uploads, F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")).select("channel", "video")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND doc_id % 30 < 14 ORDER BY n_chars DESC, doc_id LIMIT 50")
def keyword_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("n_chars").alias("views"), (F.col("doc_id") % 30).alias("age"))
    return feeds.keyword_search(docs, "the", "text", F.col("age") < 14, "views", "doc_id").select("doc_id")


@query("""
WITH s AS (SELECT o_custkey AS key, o_orderkey % 40 AS hit, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source, o_orderkey AS pos FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY pos) AS n FROM s QUALIFY n <= (CASE source WHEN 0 THEN 4 WHEN 1 THEN 10 ELSE 6 END))
SELECT key, hit, min(source)::INT AS source FROM t GROUP BY key, hit""")
def merged_searches(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 40).alias("hit"), "o_orderstatus", F.col("o_orderkey").alias("at"))
    parts = [o.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")]
    return feeds.merged(parts, ["key"], "hit", "at", [4, 10, 6]).select("key", "hit", "source")


@query("SELECT conv_id AS video, (n - 1)::INT AS at, role AS author, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 10")
def comment_threads(spark, d):
    item = F.struct(F.col("role").alias("author"), "text")
    body = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", item.alias("x"))))["x"].alias("items")))
    answers = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(body.alias("body"))
    return feeds.items(answers, "key", "body", "author string, text string", 10).withColumnRenamed("key", "video")


@query("""
WITH h AS (SELECT page_id, url, page_id % 3 AS kind FROM pages) SELECT page_id AS key, CASE kind WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'similar' END AS kind, url FROM h""")
def picture_hits(spark, d):
    kind = lambda i: F.when(F.col("page_id") % 3 == i, F.array(F.struct("url"))).otherwise(F.array().cast("array<struct<url:string>>"))
    answers = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.to_json(F.struct(kind(0).alias("full"), kind(1).alias("partial"), kind(2).alias("similar"))).alias("body"))
    return feeds.kinds(answers, "key", "body", ["full", "partial", "similar"])


@query("""SELECT event_type AS stage, (n - 1)::INT AS at, value AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 12""")
def stage_settings(spark, d):
    samples = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), "event_id")
    return S.stage_samples(S.stage_json(samples, "stage", "event_id", "seconds"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 48 THEN round(p_size * 2500 / 1001.0::DOUBLE, 3) ELSE 30.0::DOUBLE END AS fps, 1280 AS width, 720 + p_size AS height, p_size::DOUBLE AS seconds, p_partkey % 2 = 0 AS has_audio FROM part""")
def media_metadata(spark, d):
    rate = F.format_string("%d/1001", F.col("p_size") * 2500)
    audio = F.when(F.col("p_partkey") % 2 == 0, ',{"codec_type":"audio"}').otherwise("")
    body = F.concat(F.lit('{"streams":[{"codec_type":"video","width":1280,"height":'), (F.col("p_size") + 720).cast("string"), F.lit(',"r_frame_rate":"'), rate, F.lit('"}'), audio, F.lit('],"format":{"duration":"'), F.col("p_size").cast("string"), F.lit('"}}'))
    return table(spark, d, "part").select("p_partkey", F.inline(F.array(feeds.media_facts(body))))


@query("""SELECT p_partkey AS clip, (f * 2)::INT AS frame, r AS region, (8 * 4 * f * 2 + y0 * 8 + x0 + p_partkey % 7)::INT % 251 AS first, (h * w)::INT AS bytes
FROM part, range(0, 3) t(f), (VALUES (0, 0, 0, 4, 2), (1, 2, 1, 3, 3)) z(r, x0, y0, w, h)""")
def frame_regions(spark, d):
    """Raw frames of 8 x 4 pixels, every second one of 6, two regions of each from one read."""
    k = F.col("p_partkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(8 * 4 * 6 - 1)), lambda i: F.lpad(F.hex((i + k % 7) % 251), 2, "0"))
    clips = table(spark, d, "part").select(k.alias("clip"), F.unhex(F.array_join(pixels, "")).alias("raw"))
    frames = feeds.frames(clips, "clip", "raw", 8, 4, every=2)
    out = feeds.regions(frames, 8, {0: (0, 0, 4, 2), 1: (2, 1, 3, 3)})
    return out.select("clip", "frame", "region", F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("int").alias("first"), F.length("pixels").alias("bytes"))


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"parts":[{"s":0,"e":' || p_size || '},{"s":' || p_size || ',"e":' || p_size * 2 || '}],"name":"' || p_name || '"}' AS plan FROM part""")
def plan_artifact(spark, d):
    """Plans written as JSON to the shared folder and read back as text."""
    size = F.col("p_size")
    cut = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    plans = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(cut(F.lit(0), size), cut(size, size * 2)).alias("parts"), F.col("p_name").alias("name"))
    path = Scratch(spark).path("plans")
    artifact(plans, path)
    text = spark.read.text(path)
    return text.select(F.get_json_object("value", "$.id").cast("long").alias("p_partkey"), F.col("value").alias("plan"))


@query("""
WITH RECURSIVE p AS (SELECT p_partkey // 8 AS frame, p_partkey AS id, p_partkey % 4 * 70 AS x0, p_partkey // 4 % 2 * 70 AS y0, p_partkey % 4 * 70 + 40 + p_size % 21 AS x1, p_partkey // 4 % 2 * 70 + 50 AS y1,
  400 + p_size * 20 AS area, (p_partkey * 7 % 3 * 40)::DOUBLE AS hue, (p_size % 10) / 10.0::DOUBLE AS white FROM part),
l AS (SELECT a.frame, a.id AS a, b.id AS b FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id
  WHERE sqrt(((a.x0 + a.x1) / 2.0 - (b.x0 + b.x1) / 2.0) ** 2 + ((a.y0 + a.y1) / 2.0 - (b.y0 + b.y1) / 2.0) ** 2) < 2.5 * greatest(a.x1 - a.x0 + 1, 51, b.x1 - b.x0 + 1) AND least(abs(a.hue - b.hue), 180 - abs(a.hue - b.hue)) < 16),
c AS (SELECT frame, id, id AS to_id FROM p UNION SELECT c.frame, c.id, l.b FROM c JOIN l ON l.frame = c.frame AND l.a = c.to_id), k AS (SELECT frame, id, min(to_id) AS g FROM c GROUP BY frame, id),
m AS (SELECT p.frame, g, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(area) AS pixels, sum(hue * area) / sum(area) AS hue, sum(white * area) / sum(area) AS white, max(area) AS largest FROM p JOIN k ON k.id = p.id GROUP BY p.frame, g),
w AS (SELECT *, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM m)
SELECT frame, g AS "group", x0, y0, x1, y1, hue FROM w WHERE w * h BETWEEN 5000 AND 260000 AND least(w, h) >= 44 AND greatest(w, h) <= 520 AND pixels / (w * h)::DOUBLE BETWEEN 0.08 AND 0.5 AND white >= 0.25 AND pixels >= 2500
QUALIFY row_number() OVER (PARTITION BY frame ORDER BY largest DESC, g) <= 4""")
def decorative_labels(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % 4 * 70).alias("x0"), (F.floor(k / 4) % 2 * 70).alias("y0")
    pieces = table(spark, d, "part").select(F.floor(k / 8).alias("frame"), k.alias("id"), x0, y0, (k % 4 * 70 + 40 + size % 21).alias("x1"), (F.floor(k / 4) % 2 * 70 + 50).alias("y1"), (size * 20 + 400).alias("area"), (k * 7 % 3 * 40).cast("double").alias("hue"), (size % 10 / 10).cast("double").alias("white"))
    return M.decorative_labels(pieces, "frame")


@query("""
WITH g AS (SELECT p_partkey // 6 AS line, p_partkey % 50 * 12 AS x0, p_partkey % 50 * 12 + 8 + p_size AS x1, p_partkey % 9 AS y0, p_partkey % 9 + p_size AS y1, p_size * 5 AS area, p_partkey % 3 > 0 AS strict, p_size + 1 AS h FROM part),
a AS (SELECT line, coalesce(min(x0) FILTER (WHERE h >= 16), min(x0)) AS lo, coalesce(max(x1) FILTER (WHERE h >= 16), max(x1)) AS hi, count(*) FILTER (WHERE h >= 16) AS n, list_sort(list(h) FILTER (WHERE h >= 16)) AS hs,
  min(y0) FILTER (WHERE h >= 12) AS wy0, max(y1) FILTER (WHERE h >= 12) AS wy1, count(*) FILTER (WHERE h >= 12) AS wn,
  min(x0) FILTER (WHERE strict AND h BETWEEN 16 AND 85 AND area >= 90) AS sx0, max(x1) FILTER (WHERE strict AND h BETWEEN 16 AND 85 AND area >= 90) AS sx1, min(y0) FILTER (WHERE strict AND h BETWEEN 16 AND 85 AND area >= 90) AS sy0,
  max(y1) FILTER (WHERE strict AND h BETWEEN 16 AND 85 AND area >= 90) AS sy1, count(*) FILTER (WHERE strict AND h BETWEEN 16 AND 85 AND area >= 90) AS sn FROM g GROUP BY line),
b AS (SELECT *, n >= 2 AND hi - lo >= 90 AND hs[n // 2 + 1] BETWEEN 16 AND 80 AND NOT (hi - lo < 0.45 * 720 AND (lo < 0.07 * 720 OR hi > 0.93 * 720)) AS ok FROM a)
SELECT line, CASE WHEN ok THEN 'line' ELSE 'single' END AS kind, CASE WHEN ok THEN lo ELSE sx0 END AS x0, CASE WHEN ok THEN hi ELSE sx1 END AS x1, CASE WHEN ok THEN wy0 ELSE sy0 END AS y0, CASE WHEN ok THEN wy1 ELSE sy1 END AS y1,
  (CASE WHEN ok THEN wn ELSE sn END)::INT AS glyphs FROM b WHERE ok OR (sn > 0 AND hi - lo <= 170)""")
def core_lines(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    glyphs = table(spark, d, "part").select(F.floor(k / 6).alias("line"), (k % 50 * 12).alias("x0"), (k % 50 * 12 + 8 + size).alias("x1"), (k % 9).alias("y0"), (k % 9 + size).alias("y1"), (size * 5).alias("area"), (k % 3 > 0).alias("strict"))
    return M.core_lines(glyphs, [], "line", 720)


@query("""
WITH z AS (SELECT p_partkey, p_size % 20 AS x, 10 + p_size % 17 AS w FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND n >= 400 THEN n ELSE 0 END AS pixels FROM (SELECT p_partkey, greatest(0, least(x + w, 32) - greatest(x, 2)) * 40 AS n FROM z)""")
def zone_pixels(spark, d):
    """Frames of 48 x 40 pixels with a coloured stripe, blue in every third; the zone asks for blue from column 10 to 23."""

    @F.pandas_udf("binary")
    def drawn(key: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for k, s in zip(key, size):
            frame = np.full((40, 48, 3), 90, np.uint8)
            frame[:, s % 20 : s % 20 + 10 + s % 17] = (20, 60, 220) if k % 3 == 0 else (220, 60, 20)
            out.append(frame.tobytes())
        return pd.Series(out)

    box = F.array(*[F.lit(float(v)) for v in (10, 0, 23, 39)])
    mask = G.zone_fill_udf(drawn("p_partkey", "p_size"), F.lit(40), F.lit(48), box, F.lit(114))
    lit = F.length(F.regexp_replace(F.hex(mask), "00", "")) / 2
    return table(spark, d, "part").select("p_partkey", F.coalesce(lit, F.lit(0)).cast("long").alias("pixels"))
