"""Queries on the kernels for frames, masks and media, on small pictures drawn from the rows of a table."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import external as E
from ..functions import imaging as G
from ..functions.external import polled
from ..functions.imaging import drawn_mask, rasterised, saturation, static_pattern  # functions travel alone, a module with its UDFs can't
from ..operators import relational as R
from ..operators import sequences as Q
from ..sources.scratch import Scratch, setting
from ..sources.service import opened
from ..sources.tables import media, spread, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@F.pandas_udf(T.LongType())
def lit(mask: pd.Series) -> pd.Series:
    """Bytes that aren't 0."""
    return pd.Series([0 if m is None else int(np.count_nonzero(np.frombuffer(m, np.uint8))) for m in mask])


@query("""
WITH b AS (SELECT p_partkey AS k, p_partkey % 50 AS x, p_size % 20 AS y, 4 + p_size % 9 AS w, 3 + p_partkey % 6 AS h FROM part)
SELECT k, ((least(64, x + w) - x) * (least(32, y + h) - y))::BIGINT AS drawn, ((least(64, x + w + 3) - greatest(0, x - 3)) * (least(32, y + h + 3) - greatest(0, y - 3)))::BIGINT AS grown FROM b""")
def dilated_masks(spark, d):
    """A box drawn into a mask of 32 x 64 pixels, and the mask grown by 3."""

    @F.pandas_udf("binary")
    def drawn(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([rasterised([{"x0": a, "y0": b, "x1": a + c - 1, "y1": b + e - 1}], 32, 64).tobytes() for a, b, c, e in zip(x, y, w, h)])

    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(k.alias("k"), drawn(k % 50, size % 20, 4 + size % 9, 3 + k % 6).alias("mask"))
    return rows.select("k", lit("mask").alias("drawn"), lit(G.dilate_udf("mask", F.lit(32), F.lit(64), F.lit(3))).alias("grown"))


@query("""
WITH c AS (SELECT p_partkey AS k, p_partkey * 7 % 256 AS r, p_size * 5 % 256 AS g, (p_partkey + p_size) % 256 AS b FROM part)
SELECT k, (CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) * 255 // greatest(greatest(r, g, b), 1) ELSE 0 END)::INT AS saturation, greatest(r, g, b)::INT AS value FROM c""")
def pixel_saturation(spark, d):
    @F.pandas_udf("saturation int, value int")
    def measured(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        sat, value = saturation(np.stack([r, g, b], axis=-1).astype(np.uint8))
        return pd.DataFrame({"saturation": sat, "value": value})

    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("k"), measured(k * 7 % 256, size * 5 % 256, (k + size) % 256).alias("m")).select("k", "m.*")


@query("SELECT p_partkey AS k, (12 * 6 * 3 * (p_partkey % 200) + 3 * (p_size % 6) * 12 * (p_size % 50 - p_partkey % 200))::BIGINT AS total FROM part")
def composited_frames(spark, d):
    """Restored frames of 6 x 12 pixels laid over frames by an alpha of whole rows: the sum of all bytes."""

    @F.pandas_udf("binary")
    def flat(value: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([bytes([v]) * m for v, m in zip(value, n)])

    @F.pandas_udf("long")
    def total(data: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(b, np.uint8).sum(dtype=np.int64)) for b in data])

    k, size = F.col("p_partkey"), F.col("p_size")
    alpha = F.unhex(F.concat(F.repeat(F.lit("FF"), (size % 6 * 12).cast("int")), F.repeat(F.lit("00"), ((6 - size % 6) * 12).cast("int"))))
    rows = table(spark, d, "part").select(k.alias("k"), flat(k % 200, F.lit(216)).alias("frame"), flat(size % 50, F.lit(216)).alias("restored"), alpha.alias("alpha"))
    return rows.select("k", total(G.blend_udf("frame", "restored", "alpha", F.lit(6), F.lit(12))).alias("total"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE (14 + s_suppkey % 5 // 2 * 2 + 12) * (10 + s_nationkey % 4 + 12) END::BIGINT AS lit FROM supplier")
def still_marks(spark, d):
    """A striped mark that stands still over eight grey samples of a moving picture; every seventh clip has too few samples. A last
    stripe of the background's brightness has no edge."""

    @F.pandas_udf("binary")
    def marked(key: pd.Series, nation: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(key, nation):
            samples = np.empty((5 if k % 7 == 0 else 8, 80, 120), np.uint8)
            samples[:] = (np.arange(len(samples)) * 30 % 240)[:, None, None]
            samples[:, 30 : 40 + n % 4, 30 : 44 + k % 5] = np.where(np.arange(14 + k % 5) % 2, 200, 100)
            found = static_pattern(samples)
            out.append(None if found is None else found.tobytes())
        return pd.Series(out, dtype=object)

    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), lit(marked("s_suppkey", "s_nationkey")).alias("lit"))


@query("""
WITH s AS (SELECT s_suppkey AS k, 30 + s_suppkey % 20 AS w, 14 + s_nationkey % 8 AS h FROM supplier)
SELECT k, (CASE WHEN k % 3 = 1 THEN h * (w + 16) + 16 * w + 180 ELSE 181 * 141 END)::BIGINT AS lit FROM s""")
def drawn_regions(spark, d):
    """Regions drawn by hand in frames of 160 x 280 pixels: letters found and nothing missed, none found, some missed."""

    @F.pandas_udf("binary")
    def masked(key: pd.Series, nation: pd.Series) -> pd.Series:
        out = []
        for k, n in zip(key, nation):
            w, h = 30 + k % 20, 14 + n % 8
            frame, found = np.full((160, 280, 3), 90, np.uint8), np.zeros((160, 280), bool)
            frame[70 : 70 + h, 100 : 100 + w] = (220, 20, 20)
            if k % 3:
                found[70 : 70 + h, 100 : 100 + w] = True
            if k % 3 == 2:
                frame[70:90, 165:180] = (20, 20, 220)
            out.append((drawn_mask(frame, found, (90, 50, 190, 110)) * np.uint8(255)).tobytes())
        return pd.Series(out)

    return spread(table(spark, d, "supplier")).select(F.col("s_suppkey").alias("k"), lit(masked("s_suppkey", "s_nationkey")).alias("lit"))


@query("SELECT p_partkey, i::INT AS i, ((p_partkey * 37 + i * 11003) % 65536 - 32768) / 32768.0::DOUBLE AS sample FROM part, range(0, 3) t(i)")
def wave_samples(spark, d):
    """Three 16-bit samples behind a header of 44 bytes."""
    hexes = []
    for i in range(3):
        v = F.pmod((F.col("p_partkey") * 37 + i * 11003) % 65536 - 32768, F.lit(65536))
        hexes += [F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0")]
    rows = table(spark, d, "part").select("p_partkey", F.unhex(F.concat(F.repeat(F.lit("00"), 44), *hexes)).alias("wav"))
    return rows.select("p_partkey", F.posexplode(G.samples_udf("wav")).alias("i", "sample")).select("p_partkey", "i", F.col("sample").cast("double").alias("sample"))


@query("SELECT s_suppkey, base64((s_name || chr(10))::BLOB) AS content, strlen(s_name) + 1 AS length FROM supplier")
def media_files(spark, d):
    """A file for each supplier, read as base64."""
    scratch = Scratch(spark)
    path = scratch.path("media")

    def written(batches):
        """A folder for each task, whose names are the same if it runs again."""
        fs, root = opened(path)
        folder, n = f"{root}/{TaskContext.get().partitionId():05d}", 0
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            for k, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{folder}/{n}-k={'' if k is None else k}.txt") as out:
                    out.write(f"{name or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = spread(table(spark, d, "supplier").select("s_suppkey", "s_name"))
    rows.mapInArrow(written, "n long").agg(F.sum("n")).first()
    # folders are listed as such, and many small files make a task
    with setting(spark, spark__sql__files__openCostInBytes=str(1 << 16)):
        found = scratch.keep(media(spark, f"{path}/*"), "found")
    scratch.drop("media")
    return found.select(F.regexp_extract("path", r"-k=(-?\d*)\.txt$", 1).try_cast("long").alias("s_suppkey"), "content", "length")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'first ' ELSE 'second ' END || s_name AS answer FROM supplier")
def answers_with_fallback(spark, d):
    """A model that is busy for some names gives way to the next."""

    class Busy(Exception):
        code = 503

    def first(names):
        if any(int(n[-1]) % 2 for n in names):
            raise Busy
        return [f"first {n}" for n in names]

    model = E.with_fallback([first, lambda names: [f"second {n}" for n in names]])
    return E.asked(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("s_name"), model, batch=1).select("s_suppkey", "answer")


@query("""
WITH t AS (SELECT conv_id, turn, role AS speaker, turn * 1000 + turn % 3 * 700 AS s, turn * 1000 + 400 AS e FROM conversations),
n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND s - lag(e) OVER w <= 1200 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT conv_id, arg_min(s, turn) AS ms, arg_max(e, turn) AS end_ms, arg_min(speaker, turn) AS speaker FROM i GROUP BY conv_id, k""")
def transcribed_lines(spark, d):
    """Recordings given to a transcriber whose jobs are asked for until they are done; its tokens become lines of speakers."""
    t = F.col("turn")
    token = F.struct("turn", F.col("role").alias("speaker"), (t * 1000 + t % 3 * 700).alias("start_ms"), (t * 1000 + 400).alias("end_ms"), F.lit("word").alias("text"))
    recordings = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(token)).alias("recording"))

    def transcriber():
        asked: dict = {}

        def state(job):
            asked[job] = asked.get(job, 0) + 1
            return ("completed", job) if asked[job] > 1 else ("processing", None)

        return polled(lambda recording: recording, state, pause=0.0)

    tokens = E.asked(recordings, F.col("recording"), lambda prompts: transcriber()(prompts))
    kind = "array<struct<turn: long, speaker: string, start_ms: long, end_ms: long, text: string>>"
    rows = tokens.select("conv_id", F.inline(F.from_json("answer", kind)))
    return Q.lines(rows, ["conv_id"], "turn").select("conv_id", "ms", "end_ms", "speaker")


STEP = "CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END"


@query(f"""
WITH e AS (SELECT user_id, {STEP} AS step, event_id >= (SELECT max(event_id) / 2 FROM events) AS later, event_id FROM events),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY later, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, (arg_max(s, event_id) + greatest(0, -min(s)))::BIGINT AS comments FROM r GROUP BY user_id""")
def maintained_counters(spark, d):
    """A counter that clicks raise and errors lower, never below 0 at any change: a view, then a batch of changes to it."""
    t = F.col("event_type")
    events = table(spark, d, "events").select("user_id", "event_id", F.when(t == "click", 1).when(t == "error", -1).otherwise(0).alias("step"))
    half = events.agg((F.max("event_id") / 2).alias("half")).scalar()
    view = events.limit(0).select("user_id", F.lit(0).cast("long").alias("comments"))
    scratch = Scratch(spark)
    for i, batch in enumerate((events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half))):
        view = scratch.keep(R.maintained(view, batch, ["user_id"], [F.col("event_id")], "step", "comments"), f"view{i}")
    return view
