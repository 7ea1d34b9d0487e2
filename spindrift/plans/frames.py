"""Queries on recordings and pictures, drawn from the numbers of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import frames as R
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def number(i: int):
    """The i-th number of a vector in thousandths."""
    return F.floor(F.col("embedding")[i - 1].cast("double") * 1000).cast("int")


NUMBER = "floor(embedding[{}]::DOUBLE * 1000)::INT"


@query(f"""
WITH v AS (SELECT (vec_id % 4)::INT AS clip, vec_id // 4 AS frame, {NUMBER.format(1)} AS a, {NUMBER.format(2)} AS b, {NUMBER.format(3)} AS c, {NUMBER.format(4)} AS d FROM embeddings),
x AS (SELECT clip, frame, ((frame // 15 * 7 + clip) % 24)::INT AS x0, (frame // 15 * 5 % 12)::INT AS y0, 12 AS w, 6 AS h FROM v WHERE a % 5 <> 0
      UNION ALL SELECT clip, frame, (c % 30 + 30) % 30, (d % 16 + 16) % 16, 5, 3 FROM v WHERE b % 3 = 0),
n AS (SELECT row_number() OVER () AS id, clip, frame, x0, y0, x0 + w AS x1, y0 + h AS y1, w * h AS area FROM x),
s AS (SELECT p.id FROM n p JOIN n q ON p.clip = q.clip AND q.frame BETWEEN p.frame - 6 AND p.frame + 6 AND q.frame <> p.frame
      AND greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0))
        / (p.area + q.area - greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0)))::DOUBLE > 0.3::DOUBLE
      GROUP BY p.id HAVING count(DISTINCT q.frame) >= 5),
k AS (SELECT n.* FROM n JOIN s USING (id)),
p AS (SELECT clip, frame, x, unnest(range(y0, least(24, y1 + 1))) AS y FROM (SELECT *, unnest(range(x0, least(40, x1 + 1))) AS x FROM k)),
l AS (SELECT v.clip, v.frame, count(DISTINCT x * 100 + y) AS lit FROM v JOIN p ON v.clip = p.clip AND p.frame BETWEEN v.frame - 6 AND v.frame + 6 GROUP BY v.clip, v.frame)
SELECT v.clip, v.frame, coalesce(t.kept, 0)::INT AS kept, coalesce(lit, 0) AS lit FROM v LEFT JOIN (SELECT clip, frame, count(*) AS kept FROM k GROUP BY clip, frame) t USING (clip, frame) LEFT JOIN l USING (clip, frame)""")
def steady_frame_masks(spark, d):
    """Masks of four recordings of 24 x 40 pixels, whose boxes stand for 15 frames with gaps, or come and go."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 4).cast("int").alias("clip"), F.floor(F.col("vec_id") / 4).alias("frame"), *[number(i + 1).alias(c) for i, c in enumerate("abcd")])
    box = lambda x, y, w, h: F.struct(x.cast("int").alias("x0"), y.cast("int").alias("y0"), (x + w).cast("int").alias("x1"), (y + h).cast("int").alias("y1"))
    turn = F.floor(F.col("frame") / 15)
    standing = F.when(F.col("a") % 5 != 0, box((turn * 7 + F.col("clip")) % 24, turn * 5 % 12, 12, 6))
    passing = F.when(F.col("b") % 3 == 0, box(F.pmod(F.col("c"), F.lit(30)), F.pmod(F.col("d"), F.lit(16)), 5, 3))
    frames = v.select("clip", "frame", F.array_compact(F.array(standing, passing)).alias("boxes"))
    return R.steady_masks(frames, ["clip"], "frame", "boxes", 24, 40, 48).select("clip", "frame", "kept", "lit")


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 20 + 6 AS x, s_nationkey % 10 + 6 AS y, s_suppkey % 7 + 10 AS w, s_nationkey % 5 + 14 AS h, s_suppkey % 9 + 10 AS z FROM supplier)
SELECT k, 'w' AS plane, x::INT AS x0, (x + w - 1)::INT AS x1, y::INT AS y0, (y + h - 1)::INT AS y1, (w * h)::BIGINT AS area, k % 3 = 2 AS strict FROM s WHERE k % 3 <> 1
UNION ALL SELECT k, p, 60, 79, z::INT, (z + 19)::INT, 400, true FROM s, (VALUES ('c0'), ('c165')) t(p)""")
def tiled_glyphs(spark, d):
    """Pictures of 48 x 96 pixels in tiles of 32: a white letter, alone, with a bright or with a dark rim, and a red one with a
    white rim, at places that cross tiles."""

    @F.pandas_udf("binary")
    def drawn(key: pd.Series, nation: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(key, nation):
            picture = np.full((48, 96, 3), 120, np.uint8)
            x, y, w, h, z = k % 20 + 6, n % 10 + 6, k % 7 + 10, n % 5 + 14, k % 9 + 10
            if k % 3:
                picture[y - 3 : y + h + 3, x - 3 : x + w + 3] = 180 if k % 3 == 1 else 20
            picture[y : y + h, x : x + w] = 255
            picture[z - 3 : z + 23, 57:83] = 255
            picture[z : z + 20, 60:80] = (220, 20, 20)
            out.append(picture.tobytes())
        return pd.Series(out)

    pictures = spread(table(spark, d, "supplier")).select(F.col("s_suppkey").alias("k"), drawn("s_suppkey", "s_nationkey").alias("rgb"), F.lit(48).alias("h"), F.lit(96).alias("w"))
    return R.glyphs(R.tiles(pictures, "k", "rgb", "h", "w", 32), "k")
