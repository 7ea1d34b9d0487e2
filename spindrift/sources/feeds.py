"""Rows from searches, upload lists, answers in JSON, media descriptions and raw frames.

What a service answers is a text column (a file of JSON lines, a paged source);
these functions take rows from it, so a fixture and a service read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import frame_rate


def recent_uploads(channels: DataFrame, uploads: DataFrame, since: Column, first: int = 5, most: int = 10) -> DataFrame:
    """channel, video: of each channel's upload list (its key with 'UU' in front, from position 2), the newest: the first few
    whatever their date, others since a time. Channels without a list give nothing."""
    lists = channels.withColumn("playlist", F.concat(F.lit("UU"), F.substring("channel", 3, 1 << 30)))
    newest = Window.partitionBy("playlist").orderBy(F.desc("published"), F.desc("video"))
    recent = uploads.where("video IS NOT NULL").withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= most)
    return recent.where((F.col("_at") <= first) | (F.col("published") > since)).join(lists, "playlist").select("channel", "video")


def keyword_search(items: DataFrame, term: str, text: str, recent: Column, views: str, key: str, n: int = 50) -> DataFrame:
    """The n most viewed recent items whose text holds the term in either case."""
    return items.where(recent & F.contains(F.lower(text), F.lit(term.lower()))).orderBy(F.desc(views), key).limit(n)


def merged(parts: list[DataFrame], by: list[str], key: str, order: str, limits: list[int]) -> DataFrame:
    """Hits of several searches: of each the first so many by order, and each key once, from the first search that has it
    (column source, from 0)."""
    out = None
    for i, (part, n) in enumerate(zip(parts, limits)):
        top = part.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= n).withColumn("source", F.lit(i)).drop("_n")
        out = top if out is None else out.unionByName(top)
    first = Window.partitionBy(*by, key).orderBy("source", order)
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def items(answers: DataFrame, key: str, body: str, schema: str, most: int | None = None) -> DataFrame:
    """A row for each item of an answer {"items": [...]}: key, at (from 0) and the item's fields. An answer that isn't JSON or
    has no items gives none."""
    found = F.from_json(body, f"items array<struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in schema.split(','))}>>")["items"]
    if most is not None:
        found = F.slice(found, 1, most)
    return answers.select(key, F.posexplode(found).alias("at", "item")).select(key, "at", "item.*")


def kinds(answers: DataFrame, key: str, body: str, names: list[str]) -> DataFrame:
    """key, kind, url of the pictures in an answer with a list for each kind; entries without an address are left out."""
    value = F.from_json(body, ", ".join(f"`{n}` array<struct<url: string>>" for n in names))
    tagged = lambda n: F.transform(F.coalesce(value[n], F.array()), lambda x: F.struct(F.lit(n).alias("kind"), x["url"].alias("url")))
    each = F.concat(*map(tagged, names))
    return answers.select(key, F.inline(each)).where("url <> ''")


def media_facts(body: Column) -> Column:
    """fps, width, height, seconds, has_audio from a prober's JSON on streams and format; without a video stream null width and
    height."""
    info = F.from_json(body, "streams array<struct<codec_type: string, width: int, height: int, r_frame_rate: string>>, format struct<duration: string>")
    of = lambda kind: F.filter(info["streams"], lambda s: s["codec_type"] == kind)
    video = F.get(of("video"), 0)
    fps = F.round(frame_rate(F.coalesce(video["r_frame_rate"], F.lit("30/1"))), 3)
    return F.struct(fps.alias("fps"), video["width"].alias("width"), video["height"].alias("height"), F.coalesce(info["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("seconds"), (F.size(of("audio")) > 0).alias("has_audio"))


def frames(clips: DataFrame, key: str, raw: str, width: int, height: int, every: int = 1, depth: int = 1) -> DataFrame:
    """key, frame, pixels of raw clips (frames of width * height * depth bytes, one after the other), every so many of them; a
    frame that is cut off is left out."""
    size = width * height * depth
    n = F.floor(F.length(raw) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(every)))
    return clips.select(key, raw, F.explode(at).alias("frame")).select(key, "frame", F.substring(F.col(raw), F.col("frame") * size + 1, F.lit(size)).alias("pixels"))


def regions(stack: DataFrame, width: int, boxes: dict[int, tuple[int, int, int, int]], depth: int = 1) -> DataFrame:
    """Several regions (x, y, w, h) of each frame from one read: region and its pixels instead of the frame's."""
    cut = lambda x, y, w, h: F.unhex(F.concat(*[F.hex(F.substring(F.col("pixels"), F.lit(((y + r) * width + x) * depth + 1), F.lit(w * depth))) for r in range(h)]))
    each = F.array(*[F.struct(F.lit(k).alias("region"), cut(*box).alias("pixels")) for k, box in boxes.items()])
    return stack.select(*[c for c in stack.columns if c != "pixels"], F.inline(each))
