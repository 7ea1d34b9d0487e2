"""Pictures and recordings cut up for many tasks: ranges of frames with their neighbours, tiles with their borders.

A recording is dealt in ranges of frames, each with the frames around it that
its own need, so that one long recording runs in many tasks and gives what one
task would give. A picture is dealt in tiles; parts that cross tiles are joined
by their pixels at the borders.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.imaging import BANDS, BAND_MIDDLE, BAND_PIXELS, BAND_REACH, COLOUR_AREA, COLOUR_HEIGHT, GLYPH_AREA, GLYPH_HEIGHT, GLYPH_WIDTH, RIM, RIM_LEVEL, RIM_OF_BLACK, RIM_OF_COLOUR, RIM_OF_WHITE, RIM_STEP, colour_planes, coloured_hues, components, dilated, rasterised  # functions travel alone, a module with its UDFs can't
from ..sources.scratch import Scratch
from .similarity import connected

#: Frames around one in which a box must be seen, and in how many of them; how much boxes must overlap; frames of a range.
REACH, LEAST, OVERLAP, RANGE = 6, 5, 0.3, 240


def with_halo(df: DataFrame, by: list[str], frame: str, reach: int, size: int) -> DataFrame:
    """Rows by ranges of size frames (column range), those within reach of a range copied to it: own tells whose a row is."""
    of = lambda c: F.floor(c / size)
    at, own = F.col(frame), of(F.col(frame))
    near = F.sequence(of(at - reach), of(at + reach))
    return df.withColumn("range", F.explode(near)).withColumn("own", F.col("range") == own)


def overlaps(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """IoU of each box (x0, y0, x1, y1) with each other one."""
    lo, hi = np.maximum(boxes[:, None, :2], others[None, :, :2]), np.minimum(boxes[:, None, 2:], others[None, :, 2:])
    both = np.clip(hi - lo, 0, None).prod(axis=2)
    area = lambda b: (b[:, 2:] - b[:, :2]).prod(axis=1)
    return both / np.maximum(area(boxes)[:, None] + area(others)[None] - both, 1e-9)


class SteadyMasks:
    """A recording's masks as its frames come by: a box counts if one like it is seen in enough frames around, and a mask is the
    union of the counted boxes of the frames around. Holds the boxes and masks of as many frames, whatever comes."""

    def __init__(self, height: int, width: int, reach: int = REACH, least: int = LEAST, overlap: float = OVERLAP):
        self.height, self.width, self.reach, self.least, self.overlap = height, width, reach, least, overlap
        self.boxes: deque = deque()  # (frame, boxes) not older than twice reach
        self.drawn: deque = deque()  # (frame, mask, kept) of the frames whose boxes are judged
        self.judged = self.given = None

    def _judge(self, frame: int, boxes: np.ndarray) -> None:
        seen = np.zeros(len(boxes), int)
        for other, more in self.boxes:
            if other != frame and abs(other - frame) <= self.reach and len(more) and len(boxes):
                seen += (overlaps(boxes, more) > self.overlap).any(axis=1)
        kept = boxes[seen >= self.least]
        mask = rasterised([dict(zip(("x0", "y0", "x1", "y1"), map(int, b))) for b in kept], self.height, self.width) > 0
        self.drawn.append((frame, mask, len(kept)))

    def _union(self, frame: int) -> np.ndarray:
        near = [mask for other, mask, _ in self.drawn if abs(other - frame) <= self.reach]
        return np.logical_or.reduce(near)

    def push(self, frame: int | None, boxes: np.ndarray | None = None):
        """Takes the next frame (None: there is none) and gives (frame, mask, boxes kept) of those now certain, in order."""
        if frame is not None:
            self.boxes.append((frame, boxes))
        end = float("inf") if frame is None else frame
        for other, own in list(self.boxes):
            if (self.judged is None or other > self.judged) and other + self.reach < end:
                self._judge(other, own)
                self.judged = other
        for other, _, kept in list(self.drawn):
            if (self.given is None or other > self.given) and other + 2 * self.reach < end:
                yield other, self._union(other), kept
                self.given = other
        while self.boxes and self.boxes[0][0] < min(end, self.boxes[-1][0] if frame is None else frame) - 2 * self.reach:
            self.boxes.popleft()
        while self.drawn and self.given is not None and self.drawn[0][0] < self.given - self.reach:
            self.drawn.popleft()


def steady_masks(frames: DataFrame, by: list[str], frame: str, boxes: str, height: int, width: int, size: int = RANGE, reach: int = REACH, least: int = LEAST, overlap: float = OVERLAP) -> DataFrame:
    """by, frame, kept (boxes that are steady), lit (pixels of the mask) and mask (a bit a pixel) for each frame.

    frames: a row for each frame (unique in a recording) with an array of boxes
    x0, y0, x1, y1. Ranges carry the frames within twice reach on both sides:
    once for the boxes around a frame, once for the masks around it.
    """
    corner = lambda b, c: b[c].cast("double")
    flat = F.flatten(F.transform(F.coalesce(F.col(boxes), F.array().cast(frames.schema[boxes].dataType)), lambda b: F.array(*[corner(b, c) for c in ("x0", "y0", "x1", "y1")])))
    rows = with_halo(frames.select(*by, F.col(frame).cast("long").alias(frame), flat.alias("_boxes")), by, frame, 2 * reach, max(size, 1))
    keys = [*by, "range"]
    rows = rows.select(*keys, frame, "own", "_boxes").repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, frame)
    width_of_key = len(keys)

    def run(batches):
        group, state, mine, schema = None, None, set(), None

        def made(found):
            out = [(*group[:-1], at, kept, int(mask.sum()), np.packbits(mask).tobytes()) for at, mask, kept in found if at in mine]
            for row in out:
                mine.discard(row[len(group) - 1])
            if out:
                kinds = [schema.field(i).type for i in range(len(group) - 1)] + [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*schema.names[: len(group) - 1], frame, "kept", "lit", "mask"])

        for batch in batches:
            schema = batch.schema
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                key, (at, own, flat_boxes) = row[:width_of_key], row[width_of_key:]
                if key != group:
                    if state is not None:
                        yield from made(state.push(None))
                    group, state, mine = key, SteadyMasks(height, width, reach, least, overlap), set()
                if own:
                    mine.add(at)
                yield from made(state.push(at, np.array(flat_boxes, float).reshape(-1, 4)))
        if state is not None:
            yield from made(state.push(None))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(by)])
    return rows.mapInArrow(run, f"{kinds}, `{frame}` long, kept int, lit long, mask binary")


#: Pixels around a tile that its rims reach into, and a tile's side.
HALO, TILE = RIM + 1, 256
#: Tiles, and bytes of them, that travel as one batch.
TILES, TILE_BYTES = 256, 1 << 22


def tiles(pictures: DataFrame, by: str, rgb: str, height: str, width: str, size: int = TILE) -> DataFrame:
    """Pictures (by: a unique identifier) as tiles with HALO pixels around them: by, tile, y, x (its own first pixel), h, w (its
    own size), top, left (pixels before it), area (bytes, with those around it), rows, columns (of area). A tile's side is HALO
    at least."""
    size = max(size, HALO)
    kind = pictures.schema[by].dataType.simpleString()
    names = ["tile", "y", "x", "h", "w", "top", "left", "rows", "columns"]

    def run(batches):
        keys, held, some = [], [], 0

        def made():
            columns = [pa.array(keys, first), *(pa.array(c, pa.int32()) for c in zip(*(x[:-1] for x in held))), pa.array([x[-1] for x in held], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[by, *names, "area"])

        for batch in batches:
            first = batch.schema.field(0).type
            for key, data, h, w in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if data is None:
                    continue
                picture = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                across = -(-w // size)
                for y in range(0, h, size):
                    for x in range(0, w, size):
                        top, left = min(HALO, y), min(HALO, x)
                        area = picture[y - top : y + size + HALO, x - left : x + size + HALO]
                        facts = [y // size * across + x // size, y, x, min(size, h - y), min(size, w - x), top, left, *area.shape[:2]]
                        keys.append(key)
                        held.append((*facts, area.tobytes()))
                        some += area.size
                        if len(held) >= TILES or some >= TILE_BYTES:
                            yield made()
                            keys, held, some = [], [], 0
        if held:
            yield made()

    return pictures.select(by, rgb, height, width).mapInArrow(run, f"`{by}` {kind}, {', '.join(f'{n} int' for n in names)}, area binary")


def _by_tile(df: DataFrame, by: str, f, schema: str) -> DataFrame:
    """f(row of tiles() as a dict, area as an array, its own part as slices) gives rows (without by) for each tile."""
    kind = df.schema[by].dataType.simpleString()
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                area = np.frombuffer(row["area"], np.uint8).reshape(row["rows"], row["columns"], 3)
                own = (slice(row["top"], row["top"] + row["h"]), slice(row["left"], row["left"] + row["w"]))
                out += [(row[by], *r) for r in f(row, area, own)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip([by, *names], r)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(f"`{by}` {kind}, {schema}")
    arrow = to_arrow_schema(wanted)
    return df.mapInArrow(run, wanted)


def active_bands(tiled: DataFrame, by: str) -> DataFrame:
    """by, bands: the bands of hue with enough coloured pixels in the whole picture."""
    counts = _by_tile(tiled, by, lambda row, area, own: [(int(hue), int(n)) for hue, n in enumerate(coloured_hues(area[own])) if n], "hue int, n long")
    counts = counts.groupBy(by, "hue").agg(F.sum("n").alias("n"))
    away = lambda b: F.pmod(F.col("hue") - (b + BAND_MIDDLE), F.lit(180))
    inside = lambda b: F.least(away(b), 180 - away(b)) <= BAND_REACH
    found = [F.when(F.sum(F.when(inside(b), F.col("n"))) >= BAND_PIXELS, b) for b in BANDS]
    return counts.groupBy(by).agg(F.array_compact(F.array(*found)).alias("bands"), F.sum("n").alias("n")).where(F.col("n") >= BAND_PIXELS).drop("n")


def glyphs(tiled: DataFrame, by: str) -> DataFrame:
    """Glyphs of pictures in tiles (as tiles() gives them): by, plane, x0, x1, y0, y1, area, strict.

    Each tile labels the parts of its planes, its surroundings included. Parts
    of two tiles that share a pixel are one: of each area that two tiles see,
    both name the same few pixels, one of each part in it at least. Such links
    are few and join by reachability. Parts of a plane are then measured, and those
    of a glyph's size go back to their tiles, where each tile measures the rim
    that lies in its own pixels; a rim's shares decide.
    """
    scratch = Scratch(tiled.sparkSession)
    tiled = scratch.keep(tiled, "tiles")
    bands = scratch.keep(active_bands(tiled, by), "bands")
    tiled = tiled.join(bands, by, "left")

    def labelled(row, area, only=None):
        planes, maps = colour_planes(area, row["bands"] or [])
        return {name: components(mask, corners=True) for name, mask in planes.items() if only is None or name in only}, maps

    def shared_areas(row):
        """The parts of a tile's area that a neighbour sees too: strips of its own pixels, and of those around it."""
        spans = []
        for before, length, whole in ((row["top"], row["h"], row["rows"]), (row["left"], row["w"], row["columns"])):
            end = before + length
            own, out = {0: slice(before, end)}, {0: slice(before, end)}
            if before:
                own[-1], out[-1] = slice(before, min(before + HALO, end)), slice(0, before)
            if end < whole:
                own[1], out[1] = slice(max(end - HALO, before), end), slice(end, whole)
            spans.append((own, out))
        return [(ys[dy], xs[dx]) for ys, xs in zip(*spans) for dy in ys for dx in xs if dy or dx]

    def parts(row, area, own):
        near = shared_areas(row)
        for plane, labels in labelled(row, area)[0].items():
            ys, xs = np.nonzero(labels[own])
            of = labels[own][ys, xs]
            order = np.argsort(of, kind="stable")
            ys, xs, of = ys[order] + row["y"], xs[order] + row["x"], of[order]
            first = np.flatnonzero(np.diff(of, prepend=0))
            edges = (np.minimum.reduceat(xs, first), np.maximum.reduceat(xs, first), np.minimum.reduceat(ys, first), np.maximum.reduceat(ys, first)) if len(first) else ([],) * 4
            for label, n, x0, x1, y0, y1 in zip(of[first].tolist(), np.diff(np.append(first, len(of))).tolist(), *(np.asarray(e).tolist() for e in edges)):
                yield plane, row["tile"] << 32 | label, n, x0, x1, y0, y1, None
            named = np.zeros(labels.shape, bool)
            for at in near:  # pixels without a neighbour above or to the left within the shared area: each part has one
                inside = labels[at] > 0
                if inside.any():
                    lead = inside.copy()
                    lead[1:] &= ~inside[:-1]
                    lead[:, 1:] &= ~inside[:, :-1]
                    named[at] |= lead
            ys, xs = np.nonzero(named)
            for label, y, x in zip(labels[ys, xs].tolist(), (ys + row["y"] - row["top"]).tolist(), (xs + row["x"] - row["left"]).tolist()):
                yield plane, row["tile"] << 32 | label, None, None, None, None, None, y << 32 | x

    found = scratch.keep(_by_tile(tiled, by, parts, "plane string, id long, n long, x0 int, x1 int, y0 int, y1 int, pixel long"), "parts")
    shared = found.where("pixel is not null").select(by, "plane", "id", "pixel")
    least = shared.groupBy(by, "plane", "pixel").agg(F.min("id").alias("a"))
    links = shared.join(least, [by, "plane", "pixel"]).where("id <> a").select(by, "plane", "a", F.col("id").alias("b")).distinct()
    groups = connected(links, [by, "plane"])
    of_part = lambda df: df.join(groups, [by, "plane", "id"], "left").withColumn("group", F.coalesce("group", "id"))
    whole = of_part(found.where("pixel is null")).groupBy(by, "plane", "group").agg(F.sum("n").alias("area"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    fits = F.col("area").between(*GLYPH_AREA) & h.between(*GLYPH_HEIGHT) & (w <= GLYPH_WIDTH)
    fits = fits & ((F.col("plane") == "w") | ((F.col("area") >= COLOUR_AREA) & (h >= COLOUR_HEIGHT)))
    whole = scratch.keep(whole.where(fits), "whole")
    every = found.select(by, "plane", "id").distinct()
    named = of_part(every).join(whole.select(by, "plane", "group"), [by, "plane", "group"], "left_semi")
    named = named.groupBy(by, F.shiftright("id", 32).cast("int").alias("tile")).agg(F.collect_list(F.struct("plane", F.col("id").bitwiseAND((1 << 32) - 1).alias("label"), "group")).alias("named"))

    def rims(row, area, own):
        labels, maps = labelled(row, area, {x["plane"] for x in row["named"]})
        mine = np.zeros(area.shape[:2], bool)
        mine[own] = True
        of: dict = {}
        for x in row["named"]:
            of.setdefault((x["plane"], x["group"]), []).append(x["label"])
        for (plane, group), local in of.items():
            part = np.isin(labels[plane], local)
            ys, xs = np.nonzero(part)
            window = tuple(slice(max(0, v.min() - RIM), v.max() + RIM + 1) for v in (ys, xs))
            inside = part[window]
            rim = dilated(inside, RIM) & ~inside & mine[window]
            inside = inside & mine[window]
            level = maps["value"][window]
            yield plane, group, int(rim.sum()), *(int(maps[m][window][rim].sum()) for m in ("dark", "white", "light")), int(level[rim].sum()), int(level[inside].sum())

    sums = _by_tile(tiled.join(named, [by, "tile"]), by, rims, "plane string, group long, rim long, dark long, white long, light long, outer long, inner long")
    sums = sums.groupBy(by, "plane", "group").agg(*[F.sum(c).alias(c) for c in ("rim", "dark", "white", "light", "outer", "inner")])
    share = lambda c: F.col(c) / F.col("rim")
    rimmed = share("dark") >= RIM_OF_WHITE
    stepped = (F.col("inner") / F.col("area") - share("outer") >= RIM_STEP) & (share("outer") < RIM_LEVEL)
    ok = F.when(F.col("plane") == "w", rimmed | stepped).when(F.col("plane") == "k", share("light") >= RIM_OF_BLACK).otherwise(F.greatest(share("dark"), share("white")) >= RIM_OF_COLOUR)
    out = whole.join(sums, [by, "plane", "group"]).where((F.col("rim") > 0) & ok)
    return out.select(by, "plane", "x0", "x1", "y0", "y1", "area", F.when(F.col("plane") == "w", rimmed).otherwise(True).alias("strict"))
