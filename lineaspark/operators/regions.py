"""Per-object features of labelled pixels.

``pixels`` has movie, t, z, y, x, label (0 is background) and value; a detection is one (movie, t, label).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import fixpoint, materialize
from ..functions.percentiles import exact_percentiles

DETECTION = ("movie", "t", "label")


def border_term(height: int, width: int, cutoff: float = 5) -> Column:
    """1 at the edge of the frame, falling to 0 at ``cutoff`` pixels from it; depth is ignored."""
    d = F.least(F.col("y"), height - 1 - F.col("y"), F.col("x"), width - 1 - F.col("x"))
    return 1 - F.least(F.lit(1.0), d / F.lit(float(cutoff)))


def border_distance(pixels: DataFrame, height: int, width: int, cutoff: float = 5) -> DataFrame:
    """The largest border term over each detection's pixels."""
    return pixels.where("label <> 0").groupBy(*DETECTION).agg(F.max(border_term(height, width, cutoff)).alias("border_dist"))


def region_features(pixels: DataFrame, height: int, width: int, ndim: int = 2, cutoff: float = 5, int_coords: bool = False) -> DataFrame:
    """One row for each detection: centroid, area, equivalent diameter, intensities, inertia tensor, border term.

    The tensor is the matrix of second moments about the centroid with axes exchanged: diagonal entries sum
    the variances along the other axes, off-diagonal ones are negative covariances.  One partial aggregation
    before one shuffle; no Python.
    """
    if ndim not in (2, 3):
        raise ValueError("ndim must be 2 or 3")
    axes = ("z", "y", "x")[3 - ndim :]
    var = {a: F.var_pop(a) for a in axes}
    entry = lambda a, b: sum((var[k] for k in axes if k != a), F.lit(0.0)) if a == b else -F.covar_pop(*sorted((a, b)))
    centre = lambda a: F.avg(a).cast("int") if int_coords else F.avg(a)
    area = F.count(F.lit(1))
    diameter = F.sqrt(4 * area / math.pi) if ndim == 2 else F.cbrt(6 * area / math.pi)
    return pixels.where("label <> 0").groupBy(*DETECTION).agg(
        (centre("z") if ndim == 3 else F.lit(0.0)).alias("cz"), centre("y").alias("cy"), centre("x").alias("cx"),
        area.alias("area"), diameter.alias("eq_diameter"),
        F.avg("value").alias("int_mean"), F.max("value").alias("int_max"), F.min("value").alias("int_min"),
        F.array(*[entry(a, b) for a in axes for b in axes]).alias("inertia"),
        F.max(border_term(height, width, cutoff)).alias("border_dist"),
    )


def scaled_features(detections: DataFrame, wanted: DataFrame, properties: str = "regionprops2", ndim: int = 2) -> DataFrame:
    """Feature vector of each wanted (movie, t, label), zeros where it has no detection.

    Area is scaled by 0.001 and the last ``ndim**2`` columns by 0.01.  ``patch_regionprops`` and ``regionprops`` keep only the
    upper triangle of the tensor, so there the last columns reach back over earlier ones, as users of such
    features expect.  ``regionprops``, for two dimensions, has eccentricity and solidity before the tensor; ``detections`` must
    have ``area_convex`` then, as from :func:`convex_areas`.
    """
    if properties not in ("regionprops", "regionprops2", "patch_regionprops") or (properties == "regionprops" and ndim != 2):
        raise ValueError("properties must be regionprops2 or patch_regionprops, or regionprops in two dimensions")
    cells = [i * ndim + j for i in range(ndim) for j in range(ndim) if properties == "regionprops2" or i <= j]
    shape = [eccentricity(F.col("inertia")), F.col("area") / F.col("area_convex")] if properties == "regionprops" else []
    columns = [F.col("area") * 0.001, F.col("int_mean"), *shape, *[F.element_at("inertia", k + 1) for k in cells]]
    first = len(columns) - ndim**2
    columns = [c * 0.01 if k >= first else c for k, c in enumerate(columns)]
    known = detections.select(*DETECTION, F.array(*columns).alias("features"))
    return wanted.select(*DETECTION).join(known, list(DETECTION), "left").select(*DETECTION, F.coalesce("features", F.array(*[F.lit(0.0)] * len(columns))).alias("features"))


def eccentricity(inertia: Column) -> Column:
    """sqrt(1 - smaller / larger) eigenvalue of a 2x2 tensor, 0 where the larger vanishes."""
    a, b, d = (F.element_at(inertia, k) for k in (1, 2, 4))
    root = F.sqrt((a - d) * (a - d) / 4 + b * b)
    low, high = (a + d) / 2 - root, (a + d) / 2 + root
    return F.when(high > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - low / high))).otherwise(0.0)


def _envelope(points: Column) -> Column:
    """The corners of the upper hull of ``points`` (array of v, h; ascending v): what a tight string above them touches.

    A new point follows the corner to which its line is flattest, and later corners go; of those in line the first one stays.
    """
    flattest = lambda s, p: F.array_min(F.transform(s, lambda c, k: F.struct(((p["h"] - c["h"]) / (p["v"] - c["v"])).alias("m"), k.alias("k"))))["k"]
    start = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, lambda s, p: F.concat(F.slice(s, F.lit(1), flattest(s, p) + 1), F.array(p)))


def _reach(corners: Column, v: Column) -> Column:
    """The largest whole number whose double lies below the envelope at ``v``."""
    edge = lambda k: (F.element_at(corners, k), F.element_at(corners, k + 1))

    def floor(k):
        a, b = edge(k)
        over = a["h"] * (b["v"] - a["v"]) + (b["h"] - a["h"]) * (v - a["v"])
        return F.floor(over / (2 * (b["v"] - a["v"])))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(corners) - 1), floor))


def convex_areas(pixels: DataFrame) -> DataFrame:
    """(movie, t, label, area_convex): pixels whose centres lie in the convex hull of each detection in the plane, border included.

    The hull is that of the middles of the pixels' sides.  A region's rows give their ends, the hull's two flanks are
    folded from them, and each row of the hull is counted between its flanks: all in expressions over one
    array of a region's rows.  Coordinates are doubled, so they stay whole numbers.
    """
    rows = pixels.where("label <> 0").groupBy(*DETECTION, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    point = lambda dv, dh: F.struct((2 * F.col("y") + dv).cast("long").alias("v"), (2 * F.col("x1") + dh).cast("long").alias("right"), (-2 * F.col("x0") + dh).cast("long").alias("left"))
    spots = rows.select(*DETECTION, "y", F.explode(F.array(point(-1, 0), point(0, 1), point(1, 0))).alias("p"))
    flank = spots.groupBy(*DETECTION, "p.v").agg(F.max("p.right").alias("right"), F.max("p.left").alias("left"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    side = lambda name: F.sort_array(F.collect_list(F.struct("v", F.col(name).alias("h"))))
    hull = flank.groupBy(*DETECTION).agg(side("right").alias("right"), side("left").alias("left"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    hull = hull.select(*DETECTION, _envelope(F.col("right")).alias("right"), _envelope(F.col("left")).alias("left"), "y0", "y1")
    wide = lambda y: _reach(F.col("right"), 2 * y) + _reach(F.col("left"), 2 * y) + 1
    area = F.aggregate(F.sequence("y0", "y1"), F.lit(0).cast("long"), lambda n, y: n + wide(y.cast("long")))
    return hull.select(*DETECTION, area.alias("area_convex"))


def patch_features(pixels: DataFrame, detections: DataFrame, width: int = 16) -> DataFrame:
    """``width`` by ``width`` values around each detection's truncated centroid, row by row, absent pixels 0, depth by maximum.

    Depth is cut like the other axes.  Pixels are gathered in blocks of two by two tiles as wide as a patch, each a list of lines; a patch lies in one
    block, from which it is cut.  So a detection is shuffled once, as itself, and no place of its patch is a row.
    """
    half, n, wide = width // 2, width * width, 2 * width
    centre = lambda a: F.col(a).cast("int")
    tile = lambda low: F.floor(low / width)
    spots = detections.select(*DETECTION, centre("cz").alias("iz"), centre("cy").alias("iy"), centre("cx").alias("ix"))
    spots = spots.withColumns({"by": tile(F.col("iy") - half), "bx": tile(F.col("ix") - half)})
    block = ["movie", "t", "iz", "by", "bx"]
    asked = spots.select(*block).distinct().withColumn("tz", F.explode(F.sequence(tile(F.col("iz") - half), tile(F.col("iz") - half + width - 1))))
    seen = pixels.select("movie", "t", F.col("z").alias("pz"), "y", "x", "value", tile(F.col("z")).alias("tz"))
    for a in "yx":
        seen = seen.withColumn(f"b{a}", F.explode(F.array(tile(F.col(a)) - 1, tile(F.col(a)))))
    hit = asked.hint("merge").join(seen, ["movie", "t", "tz", "by", "bx"]).where(F.col("pz").between(F.col("iz") - half, F.col("iz") + half - 1))
    column = F.col("x") - F.col("bx") * width
    lines = hit.groupBy(*block, (F.col("y") - F.col("by") * width).alias("row")).agg(F.array(*[F.max(F.when(column == k, F.col("value"))) for k in range(wide)]).alias("line"))
    none = F.array_repeat(F.lit(None).cast("double"), wide)
    held = lines.groupBy(*block).agg(F.array(*[F.coalesce(F.max(F.when(F.col("row") == k, F.col("line"))), none) for k in range(wide)]).alias("lines"))
    # Padding counts as 0 where a patch reaches beyond the depth; absent pixels are 0 as well.
    start = lambda a: (F.col(f"i{a}") - half - F.col(f"b{a}") * width + 1).cast("int")
    cut = lambda line: F.transform(F.slice(line, start("x"), width), lambda value: F.coalesce(value, F.lit(0.0)))
    patch = F.flatten(F.transform(F.slice("lines", start("y"), width), cut))
    return spots.join(held.hint("merge"), block, "left").select(*DETECTION, F.when(F.col("lines").isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(patch).alias("patch"))


def patch_and_features(pixels: DataFrame, detections: DataFrame, width: int = 16, ndim: int = 2) -> DataFrame:
    """Patch followed by the scaled region features of each detection."""
    both = patch_features(pixels, detections, width).join(scaled_features(detections, detections, "patch_regionprops", ndim), list(DETECTION))
    return both.select(*DETECTION, F.concat("patch", "features").alias("features"))


def fill_region_mean(pixels: DataFrame) -> DataFrame:
    """Every pixel's value replaced by its region's mean, 0 in the background.

    Means come from a partially aggregated table that is joined back; the background is not joined.
    """
    means = pixels.where("label <> 0").groupBy(*DETECTION).agg(F.avg("value").alias("mean"))
    return pixels.join(means, list(DETECTION), "left").withColumn("value", F.coalesce("mean", F.lit(0.0))).select(pixels.columns)


def keep_near_centroids(pixels: DataFrame, detections: DataFrame, width: int = 49) -> DataFrame:
    """Values within a box of ``width`` around any truncated centroid of the frame, 0 elsewhere.

    Boxes are dealt to grid cells as wide as themselves, so a pixel meets only the boxes of its own cell.
    """
    half = width // 2
    pixels = pixels.withColumn("gy", F.floor(F.col("y") / width)).withColumn("gx", F.floor(F.col("x") / width))
    box = detections.select("movie", "t", F.col("cy").cast("int").alias("by"), F.col("cx").cast("int").alias("bx"))
    for a in "yx":
        low, high = F.floor((F.col(f"b{a}") - half) / width), F.floor((F.col(f"b{a}") + half) / width)
        box = box.withColumn(f"g{a}", F.explode(F.sequence(low, high)))
    near = (F.abs(F.col("p.y") - F.col("b.by")) <= half) & (F.abs(F.col("p.x") - F.col("b.bx")) <= half)
    same = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in ("movie", "t", "gy", "gx")]
    cond = near
    for s in same:
        cond = cond & s
    kept = pixels.alias("p").join(box.distinct().alias("b"), cond, "left_semi").select("movie", "t", "z", "y", "x").distinct().withColumn("near", F.lit(True))
    out = pixels.join(kept, ["movie", "t", "z", "y", "x"], "left").withColumn("value", F.when(F.col("near"), F.col("value")).otherwise(0.0))
    return out.drop("near", "gy", "gx")


def normalize_intensity(pixels: DataFrame, scope: str = "movie", subsample: int = 4, accuracy: int | None = None) -> DataFrame:
    """(value - p1) / (p99.8 - p1 + 1e-8) with percentiles over the movie or over each frame.

    Where both last dimensions exceed 256 the percentiles use every ``subsample``-th pixel in y and x.  They are
    exact, selected by rounds of histograms; with ``accuracy`` they are approximate, in one pass.
    """
    keys = ["movie"] if scope == "movie" else ["movie", "t"]
    extent = pixels.groupBy("movie").agg((F.max("y") >= 256).alias("tall"), (F.max("x") >= 256).alias("wide"))
    grid = pixels.join(extent, "movie").where(~(F.col("tall") & F.col("wide")) | ((F.col("y") % subsample == 0) & (F.col("x") % subsample == 0)))
    at = [0.01, 0.998]
    limits = grid.groupBy(*keys).agg(F.percentile_approx("value", at, accuracy).alias("p")) if accuracy else exact_percentiles(grid, keys, "value", at)
    low, high = F.col("p")[0], F.col("p")[1]
    return pixels.join(limits, keys).withColumn("value", (F.col("value") - low) / (high - low + 1e-8)).select(pixels.columns)


def minmax_normalize(df: DataFrame, keys: list[str], column: str = "value", eps: float = 1e-8) -> DataFrame:
    """(x - min) / (max - min + eps) within each group of ``keys``."""
    limits = df.groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return df.join(limits, keys).withColumn(column, (F.col(column) - F.col("low")) / (F.col("high") - F.col("low") + eps)).select(df.columns)


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """(movie, t, label, z, y, x0, x1): the runs of neighbouring pixels of one label in each row, ends included."""
    spots = pixels.where("label <> 0").select(*DETECTION, "z", "y", "x").distinct()
    # Within a run, the column less its number stays the same.
    island = F.col("x") - F.row_number().over(Window.partitionBy(*DETECTION, "z", "y").orderBy("x"))
    return spots.withColumn("island", island).groupBy(*DETECTION, "z", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def run_parts(pixels: DataFrame) -> DataFrame:
    """:func:`pixel_runs` with ``part``, the first run (z, y, x0) of the connected part that each belongs to.

    Pixels touch over edges and corners, so two runs do where their rows are adjacent and their ends at most one column
    apart.  Runs are joined with those of the four adjacent rows that come later (of the one, where all lie in one plane), and
    contracted; a run has a few links, whatever its length.
    """
    runs = materialize(pixel_runs(pixels))
    depth = runs.agg(F.min("z").alias("low"), F.max("z").alias("high")).first()
    later = ((0, 1),) if depth["low"] == depth["high"] else ((0, 1), (1, -1), (1, 0), (1, 1))
    rows = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy")) for a, b in later])
    node = F.struct("z", "y", "x0")
    one = runs.select(*DETECTION, node.alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(rows).alias("d")).select(*DETECTION, "a", "a0", "a1", (F.col("a.z") + F.col("d.dz")).alias("z"), (F.col("a.y") + F.col("d.dy")).alias("y"))
    two = runs.select(*DETECTION, "z", "y", node.alias("b"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    links = one.join(two, [*DETECTION, "z", "y"]).where("a0 <= b1 + 1 and b0 <= a1 + 1").select(*DETECTION, "a", "b")
    parts = component_labels(links, list(DETECTION)).withColumnRenamed("a", "node")
    return runs.withColumn("node", node).join(parts, [*DETECTION, "node"], "left").withColumn("part", F.coalesce("part", "node")).drop("node")


def split_objects(pixels: DataFrame) -> DataFrame:
    """Frames where labels fall into several connected parts: movie, t, n_labels, n_parts and the excess."""
    # A part has one run that it is named after.
    named = F.count(F.when(F.col("part") == F.struct("z", "y", "x0"), 1))
    per = run_parts(pixels).groupBy(*DETECTION).agg(named.alias("n"))
    both = per.groupBy("movie", "t").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_parts"))
    return both.where("n_parts > n_labels").withColumn("excess", F.col("n_parts") - F.col("n_labels"))


def component_labels(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, part: the least node reachable from ``a`` over links (a, b) inside each group of ``keys``.

    Labels spread to neighbours and then jump to the label's own label, so long chains take few rounds.
    """
    links = materialize(links.select(*keys, "a", "b"))  # read in every round
    both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    start = both.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("part")).withColumn("moved", F.lit(True))

    def step(now: DataFrame) -> DataFrame:
        heard = both.join(now.select(*keys, F.col("a").alias("b"), F.col("part").alias("other")), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("other").alias("other"))
        best = now.drop("moved").join(heard, [*keys, "a"]).select(*keys, "a", F.col("part").alias("old"), F.least("part", "other").alias("part"))
        jump = best.select(*keys, F.col("a").alias("part"), F.col("part").alias("far"))
        return best.join(jump, [*keys, "part"]).select(*keys, "a", F.least("part", "far").alias("part"), (F.least("part", "far") < F.col("old")).alias("moved"))

    return fixpoint(start, step, lambda now: now.where("moved")).drop("moved")
