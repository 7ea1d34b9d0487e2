"""Recordings in ranges and pictures in tiles against one task that has all."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest

from spindrift.functions import imaging as G
from spindrift.operators import frames as R

H, W = 24, 40


def recording(seed):
    rng = random.Random(seed)
    rows = []
    for clip in (1, 2):
        at = [rng.randrange(20), rng.randrange(10)]
        for f in range(0, 120):
            if rng.random() < 0.03:
                at = [rng.randrange(20), rng.randrange(10)]
            if rng.random() < 0.08:
                continue  # a frame that is missing
            boxes = [(at[0], at[1], at[0] + 12, at[1] + 6)] if rng.random() < 0.8 else []
            if rng.random() < 0.3:
                boxes.append((rng.randrange(30), rng.randrange(20), rng.randrange(30) + 5, rng.randrange(20) + 3))
            rows.append((clip, f, [tuple(map(float, b)) for b in boxes] if boxes or f % 2 else None))
    return rows


def plain(rows):
    """All frames at once: each box against all frames around, then all masks around."""
    clips = defaultdict(dict)
    for clip, f, boxes in rows:
        clips[clip][f] = boxes or []

    def iou(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return both / max(size(a) + size(b) - both, 1e-9)

    out = {}
    for clip, of in clips.items():
        raw, kept = {}, {}
        for f, boxes in of.items():
            steady = [b for b in boxes if sum(any(iou(b, c) > 0.3 for c in of.get(g, [])) for g in range(f - 6, f + 7) if g != f) >= 5]
            mask = np.zeros((H, W), bool)
            for x0, y0, x1, y1 in steady:
                mask[max(0, int(y0)) : int(y1) + 1, max(0, int(x0)) : int(x1) + 1] = True
            raw[f], kept[f] = mask, len(steady)
        for f in of:
            out[clip, f] = (kept[f], np.logical_or.reduce([raw[g] for g in range(f - 6, f + 7) if g in raw]))
    return out


@pytest.mark.parametrize("size", [1000, 37, 12, 5, 1])
def test_ranges_change_no_pixel(spark, size):
    rows = recording(3)
    df = spark.createDataFrame(rows, "clip int, frame int, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>").repartition(3)
    got = R.steady_masks(df, ["clip"], "frame", "boxes", H, W, size).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        kept, mask = want[r.clip, r.frame]
        assert (r.kept, r.lit) == (kept, mask.sum()), (r.clip, r.frame)
        assert np.array_equal(np.unpackbits(np.frombuffer(bytes(r.mask), np.uint8), count=H * W).reshape(H, W) > 0, mask)
    assert any(0 < r.lit < H * W for r in got)


def pictures():
    rng = np.random.default_rng(2)
    out = []
    for k in range(4):
        p = np.full((70, 110, 3), rng.integers(90, 140), np.uint8)
        for _ in range(14):
            y, x, h, w = rng.integers(0, 60), rng.integers(0, 95), rng.integers(4, 26), rng.integers(3, 26)
            rim = [(20, 20, 20), (255, 255, 255), (185, 185, 185), (120, 120, 120)][rng.integers(4)]
            fill = [(255, 255, 255), (10, 10, 10), (220, 30, 30), (30, 60, 220), (40, 200, 40)][rng.integers(5)]
            p[max(0, y - 3) : y + h + 3, max(0, x - 3) : x + w + 3] = rim
            p[y : y + h, x : x + w] = fill
        for i in range(30):  # a thin diagonal, connected by corners only
            p[5 + i, 20 + i] = 255
        out.append(p)
    return out


def flooded(p):
    """All glyphs of a picture as a whole, by flood fill."""
    sat, value = G.saturation(p)
    hue = G.hues(p)
    dark, white, light, coloured = value < 75, (value > 200) & (sat < 50), value > 170, (sat > 90) & (value > 110)
    planes = {"w": white, "k": value < 60}
    if coloured.sum() >= 300:
        for b in range(0, 180, 15):
            inside = coloured & np.isin(hue, [x % 180 for x in range(b - 3, b + 18)])
            if inside.sum() >= 300:
                planes[f"c{b}"] = inside
    out = set()
    for plane, mask in planes.items():
        seen = np.zeros(mask.shape, bool)
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            part, todo = [], [(y, x)]
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.append((a, b))
                for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            ys, xs = np.array(part).T
            h, w, n = np.ptp(ys) + 1, np.ptp(xs) + 1, len(part)
            if not (20 <= n <= 7000 and 8 <= h <= 85 and w <= 240) or (plane != "w" and (n < 80 or h < 12)):
                continue
            own, rim = np.zeros(mask.shape, bool), np.zeros(mask.shape, bool)
            own[ys, xs] = True
            for a, b in part:
                rim[max(0, a - 3) : a + 4, max(0, b - 3) : b + 4] = True
            rim &= ~own
            if not rim.any():
                continue
            strict = True
            if plane == "w":
                strict = bool(dark[rim].mean() >= 0.2)
                if not strict and not (value[own].mean() - value[rim].mean() >= 60 and value[rim].mean() < 150):
                    continue
            elif plane == "k":
                if light[rim].mean() < 0.4:
                    continue
            elif max(dark[rim].mean(), white[rim].mean()) < 0.35:
                continue
            out.add((plane, int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max()), n, strict))
    return out


@pytest.mark.parametrize("size", [256, 32, 9])
def test_tiles_change_no_glyph(spark, size):
    some = pictures()
    df = spark.createDataFrame([(k, p.tobytes(), 70, 110) for k, p in enumerate(some)] + [(99, None, 70, 110)], "k int, rgb binary, h int, w int")
    got = {(r.k, r.plane, r.x0, r.x1, r.y0, r.y1, r.area, r.strict) for r in R.glyphs(R.tiles(df, "k", "rgb", "h", "w", size), "k").collect()}
    want = {(k, *g) for k, p in enumerate(some) for g in flooded(p)}
    assert got == want and len({w[1] for w in want}) >= 4


def test_drawn_masks_work_on_the_part_in_question():
    """Regions drawn by hand: the masks of many pictures, by discs pixel by pixel, in less than half of the time that whole frames took."""
    frame, found = np.full((160, 280, 3), 90, np.uint8), np.zeros((160, 280), bool)
    frame[70:88, 100:140], found[70:88, 100:140] = (220, 20, 20), True
    began = time.process_time()
    for _ in range(100):
        got = G.drawn_mask(frame, found, (90, 50, 190, 110))
    assert time.process_time() - began < 1.2
    ys, xs = np.mgrid[:160, :280]
    dy, dx = np.maximum(np.maximum(70 - ys, ys - 87), 0), np.maximum(np.maximum(100 - xs, xs - 139), 0)
    assert np.array_equal(got, (dy <= 8) & (dx <= np.rint(np.sqrt(np.maximum(64 - dy * dy, 0)))))
    frame[60:80, 150:190] = (20, 20, 220)  # near the letters and no part of them
    assert G.drawn_mask(frame, found, (90, 50, 190, 110)).sum() == 181 * 141


def test_drawing_is_dealt_to_all_tasks(spark):
    from spindrift.plans import kernels

    assert kernels.drawn_regions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_tiles_name_few_shared_pixels(spark, monkeypatch):
    """A large letter over many tiles: one pixel of it a shared area, not all."""
    from spindrift.sources.scratch import Scratch

    rows, keep = {}, Scratch.keep

    def kept(self, df, name, *args):
        out = keep(self, df, name, *args)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    p = np.full((80, 200, 3), 20, np.uint8)
    p[5:75, 5:95] = 255
    df = spark.createDataFrame([(1, p.tobytes(), 80, 200)], "k int, rgb binary, h int, w int")
    assert [(r.x0, r.x1, r.y0, r.y1, r.area) for r in R.glyphs(R.tiles(df, "k", "rgb", "h", "w", 16), "k").where("plane = 'w'").collect()] == [(5, 94, 5, 74, 6300)]
    assert rows["parts"] < 65 * 2 * 20  # of two planes in 65 tiles
