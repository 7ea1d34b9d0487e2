"""Intervals and ordered sequences: islands, complements, chunks, hysteresis, greedy folds.

A sequence (one recording, one session) is a group of bounded size; groups are
spread over tasks by their key. Order-dependent folds over groups of any length
run over a sorted stream and keep only their state; short ones run over a sorted
array inside the JVM.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs: a row for which starts (over the window's lag) is true or null begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def lines(tokens: DataFrame, by: list[str], order: str, gap_ms: int = 1200) -> DataFrame:
    """Tokens (speaker, start_ms, end_ms, text) as lines: a new one when the speaker changes or the pause since the last
    token's end is longer than gap_ms. Blank tokens are dropped; a missing speaker is '1'."""
    w = Window.partitionBy(*by).orderBy(order)
    start = F.coalesce("start_ms", F.lit(0))
    clean = tokens.where(F.trim("text") != "").select(*by, order, F.coalesce(F.nullif("speaker", F.lit("")), F.lit("1")).alias("speaker"), start.alias("start_ms"), F.coalesce("end_ms", start).alias("end_ms"), "text")
    same = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start_ms") - F.lag("end_ms").over(w) <= gap_ms)
    runs = islands(clean, by, [order], ~same)
    out = runs.groupBy(*by, "island").agg(F.min("start_ms").alias("first_ms"), F.min_by("start_ms", order).alias("ms"), F.max_by("end_ms", order).alias("end_ms"), F.min_by("speaker", order).alias("speaker"), F.listagg("text").within(order).alias("text") if hasattr(Column, "within") else F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "").alias("text"))
    return out.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").drop("first_ms")


def merge_close(df: DataFrame, by: list[str], start: str, end: str, gap: float, strict: bool = True) -> DataFrame:
    """Intervals merged where the next begins less than gap after the last one's end (or overlaps, measured from the
    running end)."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) - reach >= gap if strict else F.col(start) - reach > gap
    return islands(df, by, [start, end], apart).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("island")


def kept_ranges(silences: DataFrame, by: list[str], duration: str, pad: float = 0.15, least: float = 0.05) -> DataFrame:
    """Silences (start, end) shrunk by pad at both ends and left out if not longer than least; what remains of
    [0, duration] as keeps, with the total that is cut. Every group has a row with its duration; a row without start
    stands for a group without silences."""
    cut = silences.select(*by, duration, (F.col("start") + pad).alias("cs"), (F.col("end") - pad).alias("ce"))
    cut = cut.withColumn("ok", F.coalesce(F.col("ce") - F.col("cs") > least, F.lit(False)))
    cuts = F.sort_array(F.collect_list(F.when(F.col("ok"), F.struct("cs", "ce"))))
    whole = cut.groupBy(*by).agg(F.max(duration).alias(duration), cuts.alias("cuts"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("ce") - F.col("cs"))), F.lit(0.0)).alias("cut_total"))
    n = F.size("cuts")
    edges = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(F.get(F.col("cuts.ce"), i - 1)).alias("start"), F.when(i == n, F.col(duration)).otherwise(F.get(F.col("cuts.cs"), i)).alias("end")))
    return whole.select(*by, "cut_total", F.inline(F.filter(edges, lambda e: e["end"] > e["start"])))


def silence_events(text: Column, duration: Column) -> Column:
    """Start and end marks in a log as intervals; one left open ends at the duration."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"silence_((?:start|end):\s*[0-9.]+)"), F.lit(1)), lambda m: F.struct(m.startswith("start").alias("open"), F.regexp_extract(m, r"([0-9.]+)$", 1).try_cast("double").alias("at")))
    zero = F.struct(F.lit(None).cast("double").alias("from"), F.array().cast("array<struct<start:double,end:double>>").alias("out"))

    def step(s, m):
        closes = ~m["open"] & s["from"].isNotNull()
        return F.struct(F.when(m["open"], m["at"]).alias("from"), F.when(closes, F.array_append(s["out"], F.struct(s["from"].alias("start"), m["at"].alias("end")))).otherwise(s["out"]).alias("out"))

    return F.aggregate(marks, zero, step, lambda s: F.when(s["from"].isNotNull(), F.array_append(s["out"], F.struct(s["from"].alias("start"), duration.alias("end")))).otherwise(s["out"]))


def fixed_chunks(duration: Column, size: int) -> Column:
    """Array of (index, start, end) of chunks of size, the last one shorter."""
    n = F.ceil(duration / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("index"), (i * size).cast("double").alias("start"), F.least((i + 1) * size, duration).cast("double").alias("end"))))


def even_range(k: Column, n: Column, parts: int) -> tuple[Column, Column]:
    return F.floor(k * n / parts), F.floor((k + 1) * n / parts)


def _dyadic(lo: Column, hi: Column, top: Column) -> Column:
    """The fewest dyadic nodes (level, number) that make up the cells from lo to hi, both included: two a level at most."""
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    from_, to = lambda k: F.ceil(lo / size(k)), lambda k: F.floor((hi + 1) / size(k))
    node = lambda k, n: F.struct(k.alias("level"), n.cast("long").alias("node"))
    some = lambda k: F.array_compact(F.array(
        F.when((from_(k) < to(k)) & (from_(k) % 2 != 0), node(k, from_(k))), F.when((from_(k) < to(k)) & (to(k) % 2 != 0), node(k, to(k) - 1))))
    return F.flatten(F.transform(F.sequence(F.lit(0), top), some))


def overlapping(a: DataFrame, b: DataFrame, by: list[str], a_range: tuple[str, str], b_range: tuple[str, str], cell: float = 1.0, small: int | None = 64) -> DataFrame:
    """Pairs of half-open ranges of a group that overlap; rows with a null group or end have none.

    Groups of a few ranges of a are joined by their key, at so many rows for each
    range of b. In others one of two ranges holds the other's start, so a start
    meets ranges in the dyadic nodes over it: a range of any length makes two rows
    a level at most, a start one row a level, and a pair is found once, whatever
    the lengths in a group.
    Columns of a and b besides the group have different names. cell: width of
    the finest node; it decides on speed only. small: None where the groups of a
    are known to be short, as an order's lines, so that they needn't be counted.
    """
    a0, a1, b0, b1 = (F.col(c) for c in (*a_range, *b_range))
    near = (a0 < b1) & (a1 > b0)
    if small is None:
        return a.join(b, by).where(near)
    scratch = Scratch(a.sparkSession)
    large = scratch.keep(a.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select(*by), "large")
    if not large.limit(1).count():
        scratch.drop("large")
        return a.join(b, by).where(near)

    out = a.join(large, by, "left_anti").join(b, by).where(near)
    at = lambda c: F.floor(c / cell)
    lengths = lambda df, lo, hi: df.select((at(hi) - at(lo) + 1).alias("n"))
    hot_a, hot_b = a.join(large, by, "left_semi"), b.join(large, by, "left_semi")
    top = lengths(hot_a, a0, a1).unionByName(lengths(hot_b, b0, b1)).agg(F.coalesce(F.floor(F.log2(F.greatest(F.lit(1), F.max("n").cast("double")))), F.lit(0)).cast("int")).scalar()

    def starts(df, c):
        return df.withColumn("_top", top).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top")))).withColumn("_node", F.call_function("shiftright", at(c).cast("long"), F.col("_level"))).drop("_top")

    def ranges(df, lo, hi):
        return df.where(lo <= hi).withColumn("_top", top).withColumn("_n", F.explode(_dyadic(at(lo), at(hi), F.col("_top")))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_top", "_n")

    on = [*by, "_level", "_node"]
    first = starts(hot_a, a0).join(ranges(hot_b, b0, b1), on).where(near & (b0 <= a0))
    second = ranges(hot_a, a0, a1).join(starts(hot_b, b0), on).where(near & (a0 < b0))
    return out.unionByName(first.drop("_level", "_node")).unionByName(second.drop("_level", "_node"))


def cut_map(df: DataFrame, by: list[str], start: str, end: str, duration: str, bins: int = 100) -> DataFrame:
    """Share of each of a recording's bins that its intervals cover, in per cent."""
    step = F.col(duration) / bins
    hit = df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / step).cast("int"), F.least(F.lit(bins - 1), F.floor(F.col(end) / step).cast("int")))))
    lo, hi = F.col("bin") * step, (F.col("bin") + 1) * step
    part = F.greatest(F.lit(0.0), F.least(F.col(end), hi) - F.greatest(F.col(start), lo))
    return hit.groupBy(*by, "bin").agg(F.sum(part / step * 100).alias("covered"))


def ownership(chunks: DataFrame, by: list[str], s: str = "s", e: str = "e", back: int = 5) -> DataFrame:
    """Frames that each of overlapping chunks owns (own_s, own_e): a chunk that begins within what is written takes over
    back frames before its end."""
    w = Window.partitionBy(*by).orderBy(s, e)
    written = F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1))
    use = F.when(F.coalesce(F.col(s) > written, F.lit(True)), F.col(s)).otherwise(F.greatest(F.col(s), written - back))
    out = chunks.withColumn("own_s", use)
    return out.withColumn("own_e", F.least(F.col(e), F.coalesce(F.lead("own_s").over(w) - 1, F.col(e)))).where("own_e >= own_s")


def written_frames(chunks: DataFrame, by: list[str], s: str = "s", e: str = "e") -> DataFrame:
    """by, frame, chunk (from 1): the chunk that a frame comes from once all overlapping chunks are written in order."""
    w = Window.partitionBy(*by).orderBy(s, e)
    numbered = chunks.withColumn("chunk", F.row_number().over(w)).withColumn("_last", F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.when(F.col(s) <= F.col("_last"), F.greatest(F.col(s), F.col("_last") - 5)).otherwise(F.col(s))
    frames = numbered.select(*by, "chunk", F.explode(F.when(begin <= F.col(e), F.sequence(begin, F.col(e)))).alias("frame"))
    return frames.groupBy(*by, "frame").agg(F.max("chunk").alias("chunk"))


def lagged_reference(frames: DataFrame, by: list[str], frame: str, lag: int = 12) -> DataFrame:
    """Each frame with the one so many before it; the first ones have the one so many after, or the last; never themselves."""
    w = Window.partitionBy(*by).orderBy(frame)
    last = F.last(frame).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = F.coalesce(F.lag(frame, lag).over(w), F.lead(frame, lag).over(w), last)
    return frames.withColumn("reference", F.when(found != F.col(frame), found))


def bounds(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The box around the boxes of a group, and the sum of their widths (cut)."""
    return boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("cut"))


def frame_chunks(frames: DataFrame, by: list[str], frame: str, total: int, pad: int = 4, length: int = 81, gap: int = 24, overlap: int = 12) -> DataFrame:
    """Runs of frames (a step of more than gap ends one), padded, cut into chunks of up to length frames that overlap, each
    of 4k + 1 frames and 9 at least: s, e."""
    w = Window.partitionBy(*by).orderBy(frame)
    runs = islands(frames, by, [frame], F.col(frame) - F.lag(frame).over(w) > gap).groupBy(*by, "island").agg(F.min(frame).alias("a"), F.max(frame).alias("b"))
    runs = runs.select(*by, "island", F.greatest(F.lit(0), F.col("a") - pad).alias("a"), F.least(F.lit(total - 1), F.col("b") + pad).alias("b"))
    # a chunk that isn't its run's last has the full length, so chunk i starts at a + i * step
    full = (length - 1) // 4 * 4 + 1
    step = full - overlap
    count = F.greatest(F.lit(1), F.ceil((F.col("b") - 3 - F.col("a") - full + 1) / step) + 1).cast("int")
    rows = runs.withColumn("i", F.explode(F.sequence(F.lit(0), count - 1)))
    s = F.col("a") + F.col("i") * step
    e = F.least(F.col("b"), s + length - 1)
    start = F.when(e - s + 1 < 9, F.greatest(F.lit(0), e - 8)).otherwise(s)
    use = F.floor((e - start) / 4) * 4 + 1
    return rows.select(*by, start.alias("s"), F.least(F.lit(total - 1), start + use - 1).alias("e"))


def hysteresis(probs: DataFrame, by: list[str], index: str, p: str, on: float, off: float, window: int, least_silence: float, least_speech: float, pad: int, total: str) -> DataFrame:
    """Segments of speech (s, e in samples): it begins at p >= on and ends at the first p < off that isn't followed by
    p >= on within least_silence samples. Short segments go, the rest are padded and merged."""
    w = Window.partitionBy(*by).orderBy(index)
    marks = probs.withColumn("high", F.col(p) >= on).withColumn("low", F.col(p) < off).withColumn("s", F.col(index) * window)
    stretch = F.sum(F.when(F.col("high"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # after each high, up to the next one: the first and the last low
    gaps = marks.withColumn("stretch", stretch).where("stretch > 0").groupBy(*by, "stretch").agg(
        F.max(F.when(F.col("high"), F.col("s"))).alias("at"), F.min(F.when(F.col("low"), F.col("s"))).alias("first_low"), F.max(F.when(F.col("low"), F.col("s"))).alias("last_low"), F.max(total).alias("total"))
    ends = F.coalesce(F.col("last_low") - F.col("first_low") >= least_silence, F.lit(False))
    v = Window.partitionBy(*by).orderBy("stretch")
    gaps = gaps.withColumn("stop", F.when(ends, F.col("first_low"))).withColumn("segment", F.coalesce(F.count("stop").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = gaps.groupBy(*by, "segment").agg(F.min("at").alias("s"), F.coalesce(F.max("stop"), F.max("total")).alias("e"), F.max("total").alias("total")).where(F.col("e") - F.col("s") >= least_speech)
    padded = found.select(*by, F.greatest(F.lit(0), F.col("s") - pad).alias("s"), F.least(F.col("total"), F.col("e") + pad).alias("e"))
    return merge_close(padded, by, "s", "e", 0, strict=False).drop("parts")


def _in_order(df: DataFrame, by: list[str], order: list[Column], f: Callable, schema: str) -> DataFrame:
    """A fold over each group's rows in order, in a task that holds no more than a batch and the fold's state.

    f gets the batches of a task, sorted by group and order, whole groups one
    after the other; its state begins anew where the columns by change.
    """
    keys = [F.col(c) for c in by]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(f, schema)


def _groups(batch: pa.RecordBatch, width: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, end) of the stretches of rows alike in the first columns."""
    keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
    first = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[first]:
            yield keys[first], first, i
            first = i


def greedy_budget(df: DataFrame, by: list[str], score: str, length: str, key: str, most: float = 65, enough: float = 50, picks: int = 8, least_picks: int = 3, least: float = 25) -> DataFrame:
    """Keys picked by falling score (then by key and length): one that would exceed most is skipped, picking stops at enough or
    so many picks; groups with too few picks or seconds give none. A group of any length: its state is its picks."""
    width = len(by)

    def run(batches):
        group, total, keys, done = None, 0.0, [], False
        schema = None

        def passed(out):
            if group is not None and len(keys) >= least_picks and total >= least:
                out.extend((*group, k) for k in keys)

        for batch in batches:
            schema, out = batch.schema, []
            names, lengths = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            for of, i, end in _groups(batch, width):
                if of != group:
                    passed(out)
                    group, total, keys, done = of, 0.0, [], False
                while i < end and not done:
                    if lengths[i] is not None and total + lengths[i] <= most:
                        total += lengths[i]
                        keys.append(names[i])
                        done = total >= enough or len(keys) >= picks
                    i += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*out))], names=schema.names[: width + 1])
        out = []
        passed(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*out))], names=schema.names[: width + 1])

    rows = df.select(*by, key, F.col(length).cast("double").alias("_length"), F.col(score).alias("_score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: width + 1])
    return _in_order(rows, by, [F.desc("_score"), F.col(key), F.col("_length")], run, schema)


def balanced(df: DataFrame, by: list[str], key: str, cost: str, parts: int) -> DataFrame:
    """Tasks dealt to parts, the largest first, each to the part with the least load (the first of equals): key, part, load of
    the part before it. A group of any length: its state is a heap of loads."""
    width = len(by)

    def run(batches):
        group, heap = None, []
        for batch in batches:
            costs, part, before = batch.column(width + 1).to_pylist(), [], []
            for of, first, end in _groups(batch, width):
                if of != group:
                    group, heap = of, [(0.0, i) for i in range(parts)]
                for c in costs[first:end]:
                    load, at = heap[0]
                    heapq.heapreplace(heap, (load + (c or 0.0), at))
                    part.append(at)
                    before.append(load)
            columns = [batch.column(i) for i in range(width + 1)] + [pa.array(part, pa.int32()), pa.array(before, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: width + 1], "part", "before"])

    rows = df.select(*by, key, F.col(cost).cast("double").alias("_cost"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: width + 1]) + ", part int, before double"
    return _in_order(rows, by, [F.desc("_cost"), F.col(key)], run, schema)


def support(df: DataFrame, by: list[str], frame: str, similar=None, equal: list[str] = (), reach: int = 6, least: int = 5) -> DataFrame:
    """Rows with like rows in at least so many of the frames within reach before and after (support).

    Likeness by equal columns alone is a window over each group of equal rows'
    frames; a condition similar(a, b) on top is an equi-join on group, equal
    columns and buckets of frames as wide as reach: a row stands in its own and
    the next one, and a pair counts in the first that both share. Rows of a
    frame that are alike in all that similar asks for go through it as one.
    """
    keys = [*by, *equal]
    if similar is None:
        frames = df.select(*keys, frame).distinct()
        near = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-reach, reach)
        return df.join(frames.withColumn("support", F.count(F.lit(1)).over(near) - 1).where(F.col("support") >= least), [*keys, frame]).select(*df.columns, "support")
    asked: dict[str, None] = {}
    similar(lambda c: asked.setdefault(c) or F.col(c), lambda c: asked.setdefault(c) or F.col(c))
    places = [*keys, frame, *[c for c in asked if c not in (*keys, frame)]]
    rows = df.select(*places).distinct().withColumn("_b", F.floor(F.col(frame) / reach)).withColumn("_at", F.explode(F.array("_b", F.col("_b") + 1)))
    other = rows.select(*keys, "_at", *[F.col(c).alias(f"_{c}") for c in [*places, "_b"] if c not in keys])
    apart = F.abs(F.col(frame) - F.col(f"_{frame}"))
    near = rows.join(other.hint("merge"), [*keys, "_at"]).where((F.col("_at") == F.greatest("_b", "__b")) & (apart > 0) & (apart <= reach))
    hit = near.where(similar(lambda c: F.col(c), lambda c: F.col(c if c in keys else f"_{c}")))
    found = hit.groupBy(*places).agg(F.count_distinct(f"_{frame}").alias("support")).where(F.col("support") >= least)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in places]
    return df.distinct().alias("l").join(found.alias("r").hint("merge"), same).select(*[F.col(f"l.{c}").alias(c) for c in df.columns], "support")


def glyphs_in_lines(glyphs: DataFrame, lines: DataFrame, by: list[str], frames: int = 90, near: float = 30, side: float = 30, low: float = 0.6, high: float = 1.45) -> DataFrame:
    """Single glyphs (id, frame, x0, x1, yc, h) with the first line (line, frame, x0, x1, yc, hmed) that is seen within so many
    frames, lies at their height, holds them between its sides and fits their size. The join is by buckets of frames: a line
    stands in its own bucket and those beside it."""
    width = 2 * frames
    of = lambda c: F.floor(F.col(c) / width)
    known = lines.select(*by, "line", F.explode(F.array_distinct(F.array(F.floor((F.col("frame") - frames) / width), F.floor((F.col("frame") + frames) / width)))).alias("_b"), *[F.col(c).alias(f"_{c}") for c in ("frame", "x0", "x1", "yc", "hmed")])
    both = glyphs.withColumn("_b", of("frame")).join(known, [*by, "_b"])
    inside = (F.col("_x0") - side <= F.col("x0")) & (F.col("x1") <= F.col("_x1") + side)
    hit = both.where((F.abs(F.col("frame") - F.col("_frame")) <= frames) & (F.abs(F.col("_yc") - F.col("yc")) < near) & inside & F.col("h").between(low * F.col("_hmed"), high * F.col("_hmed")))
    return hit.groupBy(*glyphs.columns).agg(F.min("line").alias("line"))


def offset_clamped(df: DataFrame, offset: str, start: str, end: str, most: Column | int) -> DataFrame:
    """Times within a chunk, held to its length (an end that is missing lies 3 s after its start), as times of the whole:
    start_ms, end_ms. Rows without a start are left out."""
    s = F.greatest(F.lit(0), F.least(F.col(start), F.lit(most)))
    e = F.greatest(s, F.least(F.coalesce(F.col(end), F.col(start) + 3000), F.lit(most)))
    return df.where(F.col(start).isNotNull()).withColumns({"start_ms": F.col(offset) + s, "end_ms": F.col(offset) + e})


def tail_chunks(n: Column, length: int = 401, step: int = 389) -> Column:
    """Array of (i, s, e inclusive) of chunks of a fixed length; what they leave over is covered by one aligned to the end."""
    full = F.greatest(F.lit(1), F.floor((n - length) / step).cast("int") + 1)
    starts = F.transform(F.sequence(F.lit(0), full - 1), lambda i: i * step)
    rest = (full - 1) * step + length < n
    starts = F.when(rest, F.concat(starts, F.array((n - length).cast("int")))).otherwise(starts)
    return F.transform(starts, lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.least(n - 1, s + length - 1).alias("e")))


def sliding_or(df: DataFrame, by: list[str], order: str, bits: str, reach: int = 6) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn(f"{bits}_or", F.bit_or(bits).over(w))


def xor_delta(df: DataFrame, by: list[str], order: str, bits: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("delta", F.col(bits).bitwiseXOR(F.coalesce(F.lag(bits).over(w), F.lit(0))))


def xor_restore(df: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("restored", F.bit_xor("delta").over(w))


def shots(cuts: DataFrame, by: list[str], at: str, duration: str, least: float = 2.5, most: float = 12.0, cap: int = 600) -> DataFrame:
    """Stretches between cut points: one shorter than least extends the stretch before it (the first is dropped), one
    longer than most + 1 is split every most seconds; the first cap of them."""
    points = F.sort_array(F.collect_list(at))
    whole = cuts.groupBy(*by).agg(points.alias("p"), F.max(duration).alias("d"))
    bounds = F.concat(F.array(F.lit(0.0)), F.col("p"), F.array(F.col("d")))
    whole = whole.withColumn("bounds", bounds).withColumn("out", F.expr(f"""
        aggregate(sequence(0, size(bounds) - 2), cast(array() as array<struct<s:double,e:double>>), (acc, i) ->
          CASE WHEN bounds[i + 1] - bounds[i] < {least}D THEN
                 CASE WHEN size(acc) = 0 THEN acc ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', bounds[i + 1]))) END
               ELSE concat(acc, transform(sequence(0, cast(greatest(0, ceil((bounds[i + 1] - bounds[i] - {most + 1}D) / {most}D)) as int)), j ->
                 named_struct('s', bounds[i] + j * {most}D,
                              'e', CASE WHEN j = greatest(0, ceil((bounds[i + 1] - bounds[i] - {most + 1}D) / {most}D)) THEN bounds[i + 1] ELSE bounds[i] + (j + 1) * {most}D END))) END)"""))
    return whole.select(*by, F.posexplode(F.slice("out", 1, cap)).alias("index", "o")).select(*by, "index", "o.s", "o.e")


def in_zones(boxes: DataFrame, zones: DataFrame, by: list[str], least: float = 0.3, reach: int = 36, width: int = 72) -> DataFrame:
    """Boxes (frame, x0..y1) with the first zone (zone, lo, hi, x0..y1) that they overlap by more than least within reach
    frames of its span."""
    from ..functions.scalars import iou

    z = zones.select(*by, "zone", (F.col("lo") - reach).alias("_lo"), (F.col("hi") + reach).alias("_hi"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    z = z.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    both = boxes.withColumn("_b", F.floor(F.col("frame") / width)).join(z, [*by, "_b"]).where((F.col("frame") >= F.col("_lo")) & (F.col("frame") <= F.col("_hi")))
    side = lambda p: {c: F.col(p + c) for c in ("x0", "y0", "x1", "y1")}
    return both.where(iou(side(""), side("_")) > least).groupBy(*boxes.columns).agg(F.min("zone").alias("zone"))


def time_masks(rects: DataFrame, by: list[str], fps: float, slack: float = 0.25) -> DataFrame:
    """Frames at which each rectangle (start, end in seconds) is masked, with slack at both ends."""
    lo, hi = F.greatest(F.lit(0), F.floor((F.col("start") - slack) * fps)), F.ceil((F.col("end") + slack) * fps)
    return rects.withColumn("frame", F.explode(F.sequence(lo, hi)))
