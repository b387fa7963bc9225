"""Patches cut from blocks, wide boxes and sparse assignments against plain versions, and how they are made."""

import random

import numpy as np
from lineaspark.operators import matching, regions
from pyspark.sql import functions as F

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"


def test_patches_are_cut_from_blocks(spark):
    r = random.Random(3)
    px = [("m", r.randrange(2), r.randrange(3) * 4, r.randrange(40), r.randrange(40), 1, round(r.uniform(-3, 9), 1)) for _ in range(500)]
    det = [("m", r.randrange(2), k, r.choice([0.0, 5.9]), r.uniform(0, 45), r.uniform(0, 45)) for k in range(30)] + [("n", 0, 1, 0.0, 3.0, 3.0)]
    pixels, detections = spark.createDataFrame(px, PIXELS), spark.createDataFrame(det, "movie string, t int, label int, cz double, cy double, cx double")
    for width in (6, 5):
        half, got = width // 2, regions.patch_features(pixels, detections, width)
        assert "cell" not in got._jdf.queryExecution().optimizedPlan().toString()
        found = {(x.movie, x.t, x.label): x.patch for x in got.collect()}
        assert len(found) == len(det)
        for m, t, label, *at in det:
            cz, cy, cx = map(int, at)
            want = np.zeros((width, width))
            for a in range(width):
                for b in range(width):
                    here = [p[6] for p in px if p[:2] == (m, t) and cz - half <= p[2] < cz + half and p[3] == cy - half + a and p[4] == cx - half + b]
                    want[a, b] = max(here, default=0.0)
            assert found[m, t, label] == want.ravel().tolist()


def test_wide_boxes_go_to_every_task(spark, monkeypatch):
    r = random.Random(6)

    def boxes(n, size, spread):
        rows = [("m", 0, k, 0, 1, y, y + size - r.randrange(4), x, x + size - r.randrange(4)) for k in range(n) for y, x in [(r.randrange(spread), r.randrange(spread))]]
        return spark.createDataFrame(rows, "movie string, t int, label int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")

    rows = lambda df: sorted((x.la, x.lb, round(x.overlap, 9)) for x in df.collect())
    monkeypatch.setattr(matching, "NARROW", 3)
    placed = []
    real = matching.meet
    monkeypatch.setattr(matching, "meet", lambda *a: (placed.append(a[-1]), real(*a))[1])
    for size, spread, cells in ((50, 30, False), (5, 60, True)):
        a, b = boxes(50, 9, 60), boxes(40, size, spread)
        got = rows(matching.bbox_overlap(a, b, grid=8, crowd=2))
        few = placed[:]
        monkeypatch.setattr(matching, "_FEW", -1)
        assert got == rows(matching.bbox_overlap(a, b, grid=8, crowd=2)) and got
        assert few == ([True] if cells else [])
        monkeypatch.setattr(matching, "_FEW", 50_000)
        placed.clear()
