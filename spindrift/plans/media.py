"""Queries around model calls and on frames: answers come from a deterministic stub, frames from row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import external as E
from ..functions import imaging as G
from ..functions import scalars as X
from ..functions import values as V
from ..operators import similarity as M
from ..sources.tables import table
from .texts import SITE_SQL, SITES

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The stub's answer by the name's digest: face, voice, confidence, category.
ANSWER_SQL = """SELECT c_custkey, CASE n % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'brief' ELSE 'often' END AS face, CASE n // 3 % 2 WHEN 0 THEN 'none' ELSE 'own' END AS voice, (n % 101) / 100.0::DOUBLE AS conf, n
FROM (SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 6))::BIGINT AS n FROM customer)"""
CATEGORY_LIST = ", ".join(f"'{c}'" for c in V.CATEGORIES)


@query(f"""
WITH a AS ({ANSWER_SQL}) SELECT c_custkey, conf >= 0.5 AND face <> 'often' AND voice = 'none' AS faceless, CASE WHEN conf >= 0.8 THEN '상' WHEN conf >= 0.5 THEN '중' ELSE '하' END AS confidence, 'stub ' || n % 1000 AS reason FROM a""")
def classify_channels(spark, d):
    rows = E.asked(table(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_name"))
    return E.classified(rows).select("c_custkey", "faceless", "confidence", "reason")


@query(f"""
WITH a AS ({ANSWER_SQL}), c AS (SELECT c_custkey, ([{CATEGORY_LIST}])[n % 15 + 1] AS category, conf FROM a)
SELECT c_custkey, CASE WHEN conf >= 0.5 THEN category ELSE '기타' END AS category, conf >= 0.5 AND category <> '기타' AS changed FROM c""")
def recheck_categories(spark, d):
    rows = E.asked(table(spark, d, "customer").select("c_custkey", F.lit(V.OTHER_CATEGORY).alias("category"), "c_name"), F.col("c_name"))
    return E.recategorised(rows).select("c_custkey", "category", "changed")


SUBJECTS = ["일상", "야구 중계", "강아지 산책", "UFC 명장면", "요리", "콘서트 직캠", "여행", "드라마 요약", "게임"]
SUBJECT_LIST = ", ".join(f"'{x}'" for x in SUBJECTS)


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(([{SUBJECT_LIST}])[p_partkey % 9 + 1], '{'|'.join(V.RISKY_RIGHTS)}') THEN '{V.RIGHTS_CAREFUL}' ELSE '{V.RIGHTS_CHECK}' END AS notice FROM part")
def rights_notices(spark, d):
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.rights_notice(F.col("p_name"), subject).alias("notice"))


@query(f"SELECT l_orderkey AS o, l_linenumber AS n, s.platform, s.listed, s.video FROM lineitem JOIN {SITE_SQL} ON s.i = (l_partkey + l_linenumber) % {len(SITES)}")
def site_classes(spark, d):
    url = F.element_at(F.array(*[F.lit(s[0]) for s in SITES]), ((F.col("l_partkey") + F.col("l_linenumber")) % len(SITES) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), url.alias("url"))
    return rows.select("o", "n", X.platform(F.lit(""), F.col("url")).alias("platform"), X.is_listing(F.col("url")).alias("listed"), X.is_video_site(F.col("url")).alias("video"))


@query("""
SELECT p_partkey, 192 AS bytes, list_sum(list_transform(range(0, 192), lambda i: CASE WHEN i * (p_partkey + 1) % 7 < 3 THEN 255 ELSE 0 END))::BIGINT AS total,
       list_sum(list_transform(range(64, 192), lambda i: CASE WHEN (i * (p_partkey + 1) % 7 < 3) <> ((i - 64) * (p_partkey + 1) % 7 < 3) THEN 1 ELSE 0 END))::BIGINT AS changes FROM part""")
def mask_codec(spark, d):
    """A stack of masks per row, packed and restored: size, sum, and pixels that change from frame to frame in what is stored."""

    @F.pandas_udf("binary")
    def made(seed: pd.Series) -> pd.Series:
        return pd.Series([((np.arange(192) * (s + 1) % 7 < 3) * np.uint8(255)).astype(np.uint8).tobytes() for s in seed])

    @F.pandas_udf("long")
    def total(data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, np.uint8).sum()) for b in data])

    rows = table(spark, d, "part").select("p_partkey", G.pack_masks_udf(made("p_partkey"), F.lit(3), F.lit(8), F.lit(8)).alias("z"))
    return rows.withColumn("b", G.unpack_masks_udf("z")).select("p_partkey", F.length("b").alias("bytes"), total("b").alias("total"), G.stored_changes_udf("z").alias("changes"))


@query("""
WITH RECURSIVE b AS (SELECT p_size AS frame, (p_partkey * 7919 % 200)::INT AS x0, (p_partkey * 104729 % 200)::INT AS y0, (p_partkey * 7919 % 200)::INT + 40 AS x1, ((p_partkey * 104729 % 200) + 30 + p_partkey % 3)::INT AS y1 FROM part),
r AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY frame ORDER BY (x1 - x0) * (y1 - y0) DESC, x0, y0, x1, y1) AS n FROM b),
f AS (SELECT DISTINCT frame, 0::BIGINT AS n, []::STRUCT(x0 INT, y0 INT, x1 INT, y1 INT)[] AS kept, false AS keep, 0 AS x0, 0 AS y0, 0 AS x1, 0 AS y1, 0 AS area FROM r
  UNION ALL SELECT frame, n, CASE WHEN covered THEN kept ELSE list_append(kept, {'x0': a, 'y0': b, 'x1': c, 'y1': d}) END, NOT covered, a, b, c, d, size
  FROM (SELECT r.frame, r.n, kept, r.x0 AS a, r.y0 AS b, r.x1 AS c, r.y1 AS d, r.area AS size,
          len(list_filter(kept, lambda k: greatest(0, least(r.x1, k.x1) - greatest(r.x0, k.x0)) * greatest(0, least(r.y1, k.y1) - greatest(r.y0, k.y0)) > 0.6 * r.area)) > 0 AS covered FROM f JOIN r ON r.frame = f.frame AND r.n = f.n + 1))
SELECT frame, x0, y0, x1, y1, area FROM f WHERE keep""")
def overlap_suppression(spark, d):
    x = (F.col("p_partkey") * 7919 % 200).cast("int")
    y = (F.col("p_partkey") * 104729 % 200).cast("int")
    boxes = table(spark, d, "part").select(F.col("p_size").alias("frame"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 30 + F.col("p_partkey") % 3).cast("int").alias("y1"))
    return M.suppress_overlaps(boxes.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "frame")


@query("""
WITH RECURSIVE b AS (SELECT p_size AS clip, (p_partkey * 7919 % 900)::DOUBLE AS y0 FROM part), o AS (SELECT clip, y0, y0 + 15 AS c, row_number() OVER (PARTITION BY clip ORDER BY y0) AS n FROM b),
g AS (SELECT DISTINCT clip, 0::BIGINT AS n, []::DOUBLE[] AS sums, []::DOUBLE[] AS counts, 0 AS line, 0::DOUBLE AS y0 FROM o
  UNION ALL SELECT clip, n, CASE WHEN pos = 0 THEN list_append(sums, c) ELSE list_transform(sums, lambda v, i: CASE WHEN i = pos THEN v + c ELSE v END) END,
    CASE WHEN pos = 0 THEN list_append(counts, 1) ELSE list_transform(counts, lambda v, i: CASE WHEN i = pos THEN v + 1 ELSE v END) END, CASE WHEN pos = 0 THEN len(sums) ELSE pos - 1 END::INT, y
  FROM (SELECT o.clip, o.n, sums, counts, o.c, o.y0 AS y, coalesce(list_position(list_transform(sums, lambda v, i: abs(v / counts[i] - o.c) < 90), true), 0) AS pos FROM g JOIN o ON o.clip = g.clip AND o.n = g.n + 1)),
e AS (SELECT clip, line, count(*) AS hits, greatest(0, trunc(min(y0) - 40))::INT AS top, least(1280, trunc(max(y0) + 30 + 40))::INT AS bottom FROM g WHERE n > 0 GROUP BY clip, line HAVING count(*) >= 4),
h AS (SELECT *, greatest(48, (bottom - top) // 16 * 16)::INT AS h FROM e), r AS (SELECT clip, least(top, 1280 - h)::INT AS y, h, row_number() OVER (PARTITION BY clip ORDER BY hits DESC, line) AS n FROM h),
f AS (SELECT DISTINCT clip, 0::BIGINT AS n, []::STRUCT(y INT, h INT)[] AS taken, false AS take, 0 AS y, 0 AS h, 0 AS band FROM r
  UNION ALL SELECT clip, n, CASE WHEN take THEN list_append(taken, {'y': a, 'h': b}) ELSE taken END, take, a, b, len(taken)::INT
  FROM (SELECT r.clip, r.n, taken, r.y AS a, r.h AS b, len(taken) < 4 AND coalesce(list_sum(list_transform(taken, lambda t: t.h)), 0) + r.h <= 1280
          AND len(list_filter(taken, lambda t: r.y + r.h > t.y AND t.y + t.h > r.y)) = 0 AS take FROM f JOIN r ON r.clip = f.clip AND r.n = f.n + 1))
SELECT clip, 0 AS x, y, 720 AS w, h, band FROM f WHERE take""")
def packed_bands(spark, d):
    y = (F.col("p_partkey") * 7919 % 900).cast("double")
    hits = table(spark, d, "part").select(F.col("p_size").alias("clip"), y.alias("y0"), (y + 30).alias("y1"))
    return M.packed_bands(hits, "clip", 720, 1280)


@query("""
WITH RECURSIVE p AS (SELECT p_size AS frame, p_partkey AS id, (p_partkey * 7919 % 500)::DOUBLE AS x, (p_partkey * 104729 % 500)::DOUBLE AS y, (12 + p_partkey % 5)::DOUBLE AS size, (p_partkey % 30)::DOUBLE AS hue FROM part),
l AS (SELECT a.frame, a.id AS a, b.id AS b FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 2.5 * greatest(a.size, b.size) AND least(abs(a.hue - b.hue), 180 - abs(a.hue - b.hue)) < 16),
c AS (SELECT frame, id, id AS to_id FROM p UNION SELECT c.frame, c.id, l.b FROM c JOIN l ON l.frame = c.frame AND l.a = c.to_id)
SELECT frame, id, min(to_id) AS "group" FROM c GROUP BY frame, id""")
def label_groups(spark, d):
    k = F.col("p_partkey")
    pieces = table(spark, d, "part").select(F.col("p_size").alias("frame"), k.alias("id"), (k * 7919 % 500).cast("double").alias("x"), (k * 104729 % 500).cast("double").alias("y"), (k % 5 + 12).cast("double").alias("size"), (k % 30).cast("double").alias("hue"))
    return M.label_groups(pieces, "frame").select("frame", "id", "group")
