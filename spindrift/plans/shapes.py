"""Queries on reshaped rows: units, frames, formats, unions of kinds, retries, marks of a user, samples by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as L
from ..functions import scalars as X
from ..operators import relational as R
from ..operators import sequences as Q
from ..operators import state as S
from ..sources import feeds
from ..sources.scratch import Scratch
from ..sources.tables import artifact, digest, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH t AS (SELECT p_partkey, p_size * 0.25::DOUBLE AS s, p_size * 0.25::DOUBLE + 0.04::DOUBLE * (p_partkey % 3) AS e FROM part)
SELECT p_partkey, floor(s * 1000 + 0.5)::BIGINT AS start_ms, floor(e * 1000 + 0.5)::BIGINT AS end_ms, floor(s * 30 + 0.5)::BIGINT AS f0, greatest(floor(s * 30 + 0.5) + 1, floor(e * 30 + 0.5))::BIGINT AS f1 FROM t""")
def frame_spans(spark, d):
    """Seconds as milliseconds and as frames of a grid, one frame at least."""
    s = F.col("p_size") * 0.25
    e = s + F.lit(0.04) * (F.col("p_partkey") % 3)
    f0, f1 = L.frame_span(s, e, 30.0)
    return table(spark, d, "part").select("p_partkey", L.milliseconds(s).alias("start_ms"), L.milliseconds(e).alias("end_ms"), f0.alias("f0"), f1.alias("f1"))


@query("""WITH r AS (SELECT p_partkey, p_size % 10 / 10.0::DOUBLE AS x, p_partkey % 10 / 10.0::DOUBLE AS w FROM part)
SELECT p_partkey, least(1272, greatest(0, floor(x * 1280 + 0.5)))::BIGINT AS px, least(1280 - least(1272, greatest(0, floor(x * 1280 + 0.5))), greatest(8, floor(w * 1280 + 0.5)))::BIGINT AS pw FROM r""")
def pixel_boxes(spark, d):
    """Shares of a side as pixels within the frame, 8 at least."""
    px, pw = L.pixel_side(F.col("p_size") % 10 / 10, F.col("p_partkey") % 10 / 10, 1280)
    return table(spark, d, "part").select("p_partkey", px.alias("px"), pw.alias("pw"))


@query("""SELECT event_id, regexp_matches(lpad(event_id::VARCHAR, (9 + event_id % 4)::INT, 'x'), '^[A-Za-z0-9_-]{11}$') AS id_ok, event_id % 3 <> 0 AS address_ok, event_id % 5 = 0 AS picture_ok FROM events""")
def formats(spark, d):
    k = F.col("event_id")
    code = F.lpad(k.cast("string"), F.lit(9) + (k % 4).cast("int"), F.lit("x"))
    address = F.when(k % 3 == 0, "ftp://a.b").when(k % 3 == 1, "http://a.b").otherwise("https://a.b/c")
    picture = F.when(k % 5 == 0, "https://i.ytimg.com/vi/abcdef12345/hqdefault.jpg").otherwise("https://i.ytimg.com/vi/abc/hqdefault.jpg?x")
    return table(spark, d, "events").select("event_id", L.is_video_id(code).alias("id_ok"), L.is_address(address).alias("address_ok"), L.is_picture(picture).alias("picture_ok"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'none' ELSE lpad(p_partkey::VARCHAR, 11, 'z') END AS video FROM part""")
def video_addresses(spark, d):
    k = F.col("p_partkey")
    code = F.lpad(k.cast("string"), 11, "z")
    forms = [F.lit("https://www.youtube.com/watch?list=x"), F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), code), F.concat(F.lit("https://youtube.com/live/"), code, F.lit("?t=1")), F.concat(F.lit("youtube.com/shorts/"), code), F.concat(F.lit("https://www.youtube.com/embed/"), code)]
    return table(spark, d, "part").select("p_partkey", F.coalesce(X.video_id(F.element_at(F.array(*forms), (k % 5 + 1).cast("int"))), F.lit("none")).alias("video"))


@query("SELECT o_custkey AS source, count(*) AS likes, bool_or(o_orderkey % 10 = 3) AS mine FROM orders GROUP BY o_custkey")
def likes_and_mine(spark, d):
    """Likes of a source, and whether one is the reader's own, in one pass."""
    likes = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 10).cast("string").alias("user"))
    return R.count_and_mine(likes, "source", "user", F.lit("3"))


@query("""SELECT label, floor((embedding[1] + 1) * 90)::BIGINT AS hue, count(*) AS n FROM embeddings WHERE floor((embedding[1] + 1) * 90) BETWEEN 0 AND 179 GROUP BY ALL""")
def hue_buckets(spark, d):
    """Pixels by hue and label; buckets without pixels are left out."""
    hue = F.floor((F.element_at("embedding", 1).cast("float") + F.lit(1).cast("float")) * F.lit(90).cast("float")).cast("bigint")
    return table(spark, d, "embeddings").select("label", hue.alias("hue")).where("hue BETWEEN 0 AND 179").groupBy("label", "hue").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'highlight' AS kind, o_custkey AS project, o_totalprice AS score, coalesce(NULL::VARCHAR, '') AS title FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'story', o_custkey, o_totalprice / 2, o_orderpriority FROM orders WHERE o_orderstatus = 'F'""")
def kinds_of_rows(spark, d):
    """Rows of two kinds with different columns as one table, tagged."""
    o = table(spark, d, "orders")
    highlight = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project"), F.col("o_totalprice").alias("score"))
    story = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("project"), (F.col("o_totalprice") / 2).alias("score"), F.col("o_orderpriority").alias("title"))
    return R.tagged_union({"highlight": highlight, "story": story}).select("kind", "project", "score", F.coalesce("title", F.lit("")).alias("title"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT a.event_id, coalesce(b.event_id, -1) AS reference FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.i = (CASE WHEN a.i >= 12 THEN a.i - 12 ELSE least(a.n - 1, a.i + 12) END) AND b.i <> a.i""")
def reference_frames(spark, d):
    """The frame 12 before, or for the first ones 12 after (the last one in a short clip), never the frame itself."""
    return Q.lagged_reference(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 12).select("event_id", F.coalesce("reference", F.lit(-1)).alias("reference"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS g, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS s, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) + l_quantity::INT AS e FROM lineitem),
w AS (SELECT *, max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written, row_number() OVER (PARTITION BY g ORDER BY s, e) AS n FROM x),
u AS (SELECT g, n, e, CASE WHEN written IS NULL OR s > written THEN s ELSE greatest(s, written - 5) END AS s FROM w), f AS (SELECT g, n, unnest(range(s, e + 1)) AS frame FROM u)
SELECT g, frame::BIGINT AS frame, max(n)::INT AS chunk FROM f GROUP BY g, frame""")
def merged_frames(spark, d):
    """Each frame's chunk where chunks overlap: a later one takes over 5 frames before the end of what is written."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), day.alias("s"), (day + F.col("l_quantity").cast("int")).alias("e")).distinct()
    return Q.written_frames(chunks, ["g"]).select("g", F.col("frame").cast("long").alias("frame"), "chunk")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus WHEN o_custkey % 3 = 0 AND o_orderkey % 5 > 0 THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'F' AND NOT (o_custkey % 3 = 0 AND o_orderkey % 5 > 0) THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'failed_render' WHEN '2-HIGH' THEN 'failed_wm' ELSE 'failed_probe' END ELSE '' END AS project FROM orders""")
def retried_jobs(spark, d):
    """A job that failed once goes back to the queue, unless it may not; later failures fail its project."""
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "render").when(F.col("o_orderpriority") == "2-HIGH", "wmremove").otherwise("probe")
    jobs = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "error").otherwise(F.col("o_orderstatus")).alias("status"), kind.alias("job_type"), (F.col("o_custkey") % 3).alias("attempts"), (F.col("o_orderkey") % 5 == 0).alias("final"))
    out = S.after_error(jobs)
    return out.select("o_orderkey", "status", F.coalesce("project_status", F.lit("")).alias("project"))


@query("""SELECT label, i - 1 AS pixel, min(v) AS low, max(v) AS high, list_sort(list(v))[count(*) // 2 + 1] AS middle FROM (SELECT label, unnest(range(1, 17)) AS i, floor((embedding[unnest(range(1, 17))] + 1) * 100)::BIGINT AS v FROM embeddings) GROUP BY label, i""")
def pixel_samples(spark, d):
    """Darkest, brightest and upper median value of each pixel over the samples of a clip."""
    level = F.transform("embedding", lambda x: F.floor((x.cast("float") + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("long"))
    pixels = table(spark, d, "embeddings").select("label", F.posexplode(F.slice(level, 1, 16)).alias("pixel", "v"))
    extent = pixels.groupBy("label", "pixel").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    middle = R.upper_medians(pixels, ["label", "pixel"], "v").select("label", "pixel", F.col("median").alias("middle"))
    return extent.join(middle, ["label", "pixel"]).select("label", F.col("pixel").cast("long").alias("pixel"), "low", "high", "middle")


@query("""SELECT frame, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(x1 - x0) AS cut FROM (SELECT p_size AS frame, p_partkey % 50 AS x0, p_partkey % 40 AS y0, p_partkey % 50 + 10 AS x1, p_partkey % 40 + 5 AS y1 FROM part) GROUP BY frame""")
def bounding_boxes(spark, d):
    """The box around a frame's boxes, and the length of all."""
    k = F.col("p_partkey")
    boxes = table(spark, d, "part").select(F.col("p_size").alias("frame"), (k % 50).alias("x0"), (k % 40).alias("y0"), (k % 50 + 10).alias("x1"), (k % 40 + 5).alias("y1"))
    return Q.bounds(boxes, ["frame"])


@query("""SELECT p_partkey AS id, 'https://example.org/' || p_partkey AS url, p_brand AS "by", p_size AS duration FROM part""")
def renamed_fields(spark, d):
    """Known fields of answers under the names that readers use; others don't pass, missing ones have defaults."""
    video = F.struct(F.col("p_partkey").alias("id"), F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("url"), F.struct(F.col("p_brand").alias("name")).alias("user"), F.col("p_size").alias("duration"), F.lit("x").alias("secret"))
    answers = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.array(video).alias("items"))).alias("body"))
    rows = feeds.items(answers, "p_partkey", "body", "id long, url string, duration int, user struct<name: string>")
    return R.renamed(rows, {"id": "id", "url": "url", "user.name": "by", "duration": "duration"}, {"by": ""})


@query("""SELECT string_agg(event_type || ': ' || n, chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def text_report(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return digest(counts)


@query("SELECT c_custkey, c_custkey % 4 > 0 AS kept FROM customer WHERE c_custkey % 4 > 0")
def fresh_files(spark, d):
    """Files younger than a time to live, by the clock of their writing."""
    path = Scratch(spark).path("cache")
    artifact(table(spark, d, "customer").where("c_custkey % 4 > 0").select("c_custkey"), path)
    files = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("written"))
    fresh = files.where(F.col("written") > F.current_timestamp() - F.expr("INTERVAL 7200 SECONDS"))
    return fresh.select(F.get_json_object("value", "$.c_custkey").cast("long").alias("c_custkey"), F.lit(True).alias("kept"))


@query("""SELECT o_custkey AS project, min(o_orderkey) AS job FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY o_custkey""")
def claimable_jobs(spark, d):
    """The oldest queued job of each project that has none running: what one pass of a worker may claim."""
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return S.claimable(jobs, "project", "job")
