"""Seeded augmentation of detections inside windows.

Parameters are drawn once for each window from a hash of seed, movie, window and the parameter's name, so that
results do not depend on partitions.  ``windows`` has movie, t1, t, label, cz, cy, cx and feature columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _window():
    return Window.partitionBy("movie", "t1")


def uniform(seed: int, name: str, low: float = 0.0, high: float = 1.0, *more: str) -> Column:
    """A number in [low, high) for each window, and for each value of the columns ``more``.

    It is the first 52 bits of the MD5 digest of seed, name, movie, window and ``more`` joined by slashes, so that any
    engine can draw it again.
    """
    text = F.concat_ws("/", F.lit(str(seed)), F.lit(name), F.col("movie"), *[F.col(c).cast("string") for c in ("t1", *more)])
    share = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)
    return F.lit(float(low)) + share * float(high - low)


def normal(seed: int, name: str, *more: str) -> Column:
    """A standard normal number, by the Box-Muller formula."""
    a, b = uniform(seed, name + "/r", 0, 1, *more), uniform(seed, name + "/a", 0, 1, *more)
    return F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b)


def _gate(seed: int, name: str, p: float) -> Column:
    return uniform(seed, name + "/gate") < p


def axes_of(ndim: int) -> tuple[str, ...]:
    return ("cz", "cy", "cx")[3 - ndim :]


def random_crop(windows: DataFrame, size: tuple[int, ...], seed: int = 0, ndim: int = 2, window: int | None = None) -> DataFrame:
    """Detections in a random box near a random detection; windows in which not all ``window`` frames keep one stay whole.

    ``size`` is one number, one for each axis, or a pair of limits for each axis.  Without ``window`` the frames
    that have a detection must keep one.
    """
    axes = axes_of(ndim)
    if len(size) not in (1, ndim, 2 * ndim):
        raise ValueError(f"size must have 1, {ndim} or {2 * ndim} numbers")
    limits = [(size[0], size[0])] * ndim if len(size) == 1 else [(s, s) for s in size] if len(size) == ndim else list(zip(size[::2], size[1::2]))
    order = uniform(seed, "pick", 0, 1, "t", "label")
    frames = F.count_distinct("t") if window is None else F.lit(window)
    pick = windows.groupBy("movie", "t1").agg(F.min_by(F.struct(*axes), F.struct(order.alias("h"), F.col("t"), F.col("label"))).alias("at"), frames.alias("frames"))
    inside = F.lit(True)
    for a, (low, high) in zip(axes, limits):
        n = F.floor(uniform(seed, f"size {a}", low, high + 1))
        step = F.floor(n / 4) + F.floor(uniform(seed, f"shift {a}") * (F.floor(3 * n / 4) - F.floor(n / 4)))
        pick = pick.withColumn(f"o{a}", F.col(f"at.{a}") - n + 1 + step).withColumn(f"n{a}", n)
        inside = inside & (F.col(a) >= F.col(f"o{a}")) & (F.col(a) < F.col(f"o{a}") + F.col(f"n{a}"))
    rows = windows.join(pick.drop("at"), ["movie", "t1"]).withColumn("inside", inside)
    left = rows.where("inside").groupBy("movie", "t1").agg(F.count_distinct("t").alias("left"))
    both = rows.join(left, ["movie", "t1"], "left")
    return both.where(F.col("inside") | F.col("left").isNull() | (F.col("left") < F.col("frames"))).select(windows.columns)


def random_flip(windows: DataFrame, seed: int = 0, axes: tuple[str, ...] = ("cy", "cx"), p: float = 0.5) -> DataFrame:
    """With probability ``p`` each axis is negated or not, with even chances."""
    on = _gate(seed, "flip", p)
    for a in axes:
        windows = windows.withColumn(a, F.when(on & (uniform(seed, f"flip {a}") < 0.5), -F.col(a)).otherwise(F.col(a)))
    return windows


def affine(windows: DataFrame, m: list[list[Column]], on: Column) -> DataFrame:
    """Detections under the linear map ``m`` of (y, x) or (z, y, x), where ``on`` holds.

    Coordinates are mapped, area grows by the determinant, the diameter by its root (square or cubic), the tensor
    I becomes M I M'; intensities and the border term stay.
    """
    n, columns = len(m), windows.columns
    axes = axes_of(n)
    # The map stands in columns of its own, so that its draws are not repeated in every expression.
    windows = windows.withColumns({f"_m{i}{j}": m[i][j] for i in range(n) for j in range(n)} | {"_on": on})
    m, on = [[F.col(f"_m{i}{j}") for j in range(n)] for i in range(n)], F.col("_on")
    if n == 2:
        det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    else:
        det = sum((m[0][i] * (m[1][(i + 1) % 3] * m[2][(i + 2) % 3] - m[1][(i + 2) % 3] * m[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))
    tensor = lambda i, j: F.element_at("inertia", n * i + j + 1)
    new = {a: sum((m[i][k] * F.col(axes[k]) for k in range(n)), F.lit(0.0)) for i, a in enumerate(axes)} | {
        "area": F.col("area") * det, "eq_diameter": F.col("eq_diameter") * F.pow(F.abs(det), F.lit(1 / n)),
        "inertia": F.array(*[sum((m[i][k] * tensor(k, q) * m[j][q] for k in range(n) for q in range(n)), F.lit(0.0)) for i in range(n) for j in range(n)]),
    }
    old = {"area": F.col("area").cast("double")}
    return windows.select(*[F.when(on, new[c]).otherwise(old.get(c, F.col(c))).alias(c) if c in new else F.col(c) for c in columns])


def random_affine(windows: DataFrame, seed: int = 0, degrees: float = 10, scale: tuple[float, float] = (0.9, 1.1), shear: tuple[float, float] = (0.1, 0.1), p: float = 0.5, ndim: int = 2) -> DataFrame:
    """Rotation in the plane times scaling of each axis times shear in the plane, drawn for the window.

    The shear of (y, x) by a and b is ((1 + a b, a), (b, 1)).  z, where there is one, is scaled only.
    """
    draws = {"_turn": uniform(seed, "angle", -degrees, degrees) * (math.pi / 180), "_a": uniform(seed, "shear y", -shear[0], shear[0]), "_b": uniform(seed, "shear x", -shear[1], shear[1])}
    draws |= {f"_s{k}": uniform(seed, f"scale {k}", *scale) for k in "zyx"[3 - ndim :]}
    a, b, sy, sx, c, s = F.col("_a"), F.col("_b"), F.col("_sy"), F.col("_sx"), F.cos("_turn"), F.sin("_turn")
    plane = [[c * sy * (1 + a * b) - s * sx * b, c * sy * a - s * sx], [s * sy * (1 + a * b) + c * sx * b, s * sy * a + c * sx]]
    if ndim == 3:
        none = F.lit(0.0)
        plane = [[F.col("_sz"), none, none], [none, *plane[0]], [none, *plane[1]]]
    return affine(windows.withColumns(draws), plane, _gate(seed, "affine", p)).select(windows.columns)


def random_brightness(windows: DataFrame, seed: int = 0, scale: tuple[float, float] = (0.5, 2.0), shift: tuple[float, float] = (-0.1, 0.1), p: float = 0.5, columns: tuple[str, ...] = ("int_mean", "int_max", "int_min")) -> DataFrame:
    """Intensities times a factor plus a shift."""
    a, b, on = uniform(seed, "gain", *scale), uniform(seed, "bias", *shift), _gate(seed, "brightness", p)
    return windows.select(*[F.when(on, F.col(c) * a + b).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in windows.columns])


def random_offset(windows: DataFrame, seed: int = 0, offset: tuple[float, float] = (-3, 3), p: float = 0.5, axes: tuple[str, ...] = ("cy", "cx")) -> DataFrame:
    """Every detection moved by a number of its own on each axis."""
    for a in axes:
        windows = windows.withColumn(a, F.when(_gate(seed, "offset", p), F.col(a) + uniform(seed, f"offset {a}", *offset, "t", "label")).otherwise(F.col(a)))
    return windows


def random_movement(windows: DataFrame, seed: int = 0, offset: tuple[float, float] = (-10, 10), p: float = 0.5, axes: tuple[str, ...] = ("cy", "cx")) -> DataFrame:
    """A constant drift for each frame after the window's first."""
    late = F.col("t") - F.min("t").over(_window())
    for a in axes:
        windows = windows.withColumn(a, F.when(_gate(seed, "movement", p), F.col(a) + late * uniform(seed, f"movement {a}", *offset)).otherwise(F.col(a)))
    return windows


def integer_shift(windows: DataFrame, seed: int = 0, most: int = 512, axes: tuple[str, ...] = ("cy", "cx")) -> DataFrame:
    """All coordinates of a window moved by one whole number below ``most`` on each axis."""
    for a in axes:
        windows = windows.withColumn(a, F.col(a) + F.floor(uniform(seed, f"shift {a}", 0, most)))
    return windows


# Chances and ranges of the augmentation levels.
AFFINE = {"degrees": 180, "scale": (0.5, 2.0), "shear": (0.1, 0.1), "p": 0.8}
BRIGHTNESS, MOVEMENT, OFFSET = {"p": 0.8}, {"offset": (-10, 10), "p": 0.3}, {"offset": (-3, 3), "p": 0.8}


def augment(windows: DataFrame, level: int, seed: int = 0, ndim: int = 2) -> DataFrame:
    """Fixed sequences: 0 nothing; 1 flips and affine maps; 2 also brightness and offsets; 3 also movement before the offsets; then a shift."""
    if level not in (0, 1, 2, 3):
        raise ValueError("level must be 0, 1, 2 or 3")
    if level == 0:
        return windows
    axes = axes_of(ndim)
    out = random_affine(random_flip(windows, seed, axes), seed, ndim=ndim, **AFFINE)
    if level >= 2:
        out = random_brightness(out, seed, **BRIGHTNESS)
    if level == 3:
        out = random_movement(out, seed, axes=axes, **MOVEMENT)
    if level >= 2:
        out = random_offset(out, seed, axes=axes, **OFFSET)
    return integer_shift(out, seed, axes=axes)


def augment_coords(windows: DataFrame, seed: int = 0, shift: float = 128, jitter: float = 1.5, ndim: int = 2) -> DataFrame:
    """Coordinates flipped and turned by any angle about the window's mean, then shifted and jittered by normal numbers.

    In three dimensions the turn in (y, x) is followed by one in (z, y) and one in (z, x).
    """
    axes = axes_of(ndim)
    middle = {f"_{a}": F.avg(a).over(_window()) for a in axes}
    out = windows.withColumns(middle)
    out = out.withColumns({a: F.when(uniform(seed, f"flip {a}") < 0.5, F.col(f"_{a}") - F.col(a)).otherwise(F.col(a) - F.col(f"_{a}")) for a in axes})
    for name, p, q in (("turn", "cy", "cx"), ("turn zy", "cz", "cy"), ("turn zx", "cz", "cx")):
        if p in axes:
            theta = uniform(seed, name, 0, 2 * math.pi)
            out = out.withColumns({p: F.cos(theta) * F.col(p) - F.sin(theta) * F.col(q), q: F.sin(theta) * F.col(p) + F.cos(theta) * F.col(q)})
    for a in axes:
        out = out.withColumn(a, F.col(a) + F.col(f"_{a}") + uniform(seed, f"far {a}", -shift, shift) + jitter * normal(seed, f"near {a}", "t", "label"))
    return out.select(windows.columns)


def intensity_scale_shift(pixels: DataFrame, seed: int = 0, scale: tuple[float, float] = (0.5, 2.0), shift: tuple[float, float] = (-0.1, 0.1), clip: bool = True) -> DataFrame:
    """Pixel values of each window (movie, t1) times a factor plus a shift, cut to [0, 1] with ``clip``.

    ``pixels`` that are not in windows count as one window, 0, for each movie.
    """
    rows = pixels if "t1" in pixels.columns else pixels.withColumn("t1", F.lit(0))
    value = F.col("value") * uniform(seed, "gain", *scale) + uniform(seed, "bias", *shift)
    rows = rows.withColumn("value", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) if clip else value)
    return rows.select(pixels.columns)
