"""Joins of boxes that lie over one another, with bounded work for a key however crowded a place is.

Boxes are listed under the grid cells that they reach.  A cell where more than ``crowd`` boxes of both sides are is cut into cells
half as wide, again and again, while that leaves fewer of them in each; where only one side is crowded, or cutting no
longer helps (boxes in one place), the cell's boxes are dealt to slices and every slice of one side meets every
slice of the other.  A pair is made in the one cell that holds the first corner of what both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loops import discard, materialize

CROWD = 2_000  # boxes of either side that meet in one key, about
DEPTH = 8  # times that a cell is cut
_SMALL = 100_000  # crowded cells that are broadcast, at most

Reach = list[tuple[Column, Column]]


def around(column: str, distance: float) -> tuple[Column, Column]:
    """What lies within ``distance``, and a little more than rounding can take away."""
    more = distance + distance * 1e-6 + F.abs(column) * 1e-12
    return F.col(column) - more, F.col(column) + more


def point(column: str) -> tuple[Column, Column]:
    return F.col(column), F.col(column)


def _listed(rows: DataFrame, reach: Reach, grid: float, cells: list[str], level: int) -> DataFrame:
    """``rows`` under each cell of ``level`` that they reach; below level 0 inside the cell that they stand in."""
    for g, (low, high) in zip(cells, reach):
        first, last = (F.floor(c / grid * 2.0**level) for c in (low, high))
        if level:
            first, last = F.greatest(first, 2 * F.col(g)), F.least(last, 2 * F.col(g) + 1)
        rows = rows.withColumn(g, F.explode(F.sequence(first, last)))
    return rows


def _crowded(sides: list[DataFrame], at: list[str], crowd: int, level: int) -> DataFrame:
    """The crowded cells with their boxes of each side, and whether a cell is to be cut."""
    counts = [s.select(*at, (s.was if "was" in s.columns else F.lit(None).cast("long")).alias("was"), F.lit(int(k == 0)).alias("a"), F.lit(int(k == 1)).alias("b")) for k, s in enumerate(sides)]
    total = counts[0].unionByName(counts[1]).groupBy(*at).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.max("was").alias("was"))
    least = F.least("n_a", "n_b")
    helps = F.col("was").isNull() | (least < 0.7 * F.col("was"))
    total = total.where(F.greatest("n_a", "n_b") > crowd)  # those of one side only too: their boxes are left out
    return total.select(*at, "n_a", "n_b", ((least > crowd) & helps & F.lit(level < DEPTH)).alias("cut"))


def placed(a: DataFrame, b: DataFrame, keys: list[str], reach_a: Reach, reach_b: Reach, grid: float, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides under their cells and slices, and the columns that they are to be joined on."""
    cells = [f"cell_{k}" for k in range(len(reach_a))]
    at, reaches = [*keys, *cells], (reach_a, reach_b)
    names = a.columns, b.columns
    sides = [_listed(s, r, grid, cells, 0) for s, r in zip((a, b), reaches)]
    full = materialize(_crowded(sides, at, crowd, 0))
    n = full.count()
    if not n:
        discard(full)
        return *sides, at
    done: list[DataFrame | None] = [None, None]
    for level in range(DEPTH + 1):
        marks = F.broadcast(full) if n <= _SMALL else full
        children = []
        for k, (own, other) in enumerate((("a", "b"), ("b", "a"))):
            marked = sides[k].join(marks, at, "left")
            slices = lambda s: F.coalesce(F.ceil(F.col(f"n_{s}") / crowd), F.lit(1))
            still = marked.where(F.col("cut").isNull() | (~F.col("cut") & (F.least("n_a", "n_b") > 0)))
            still = still.withColumn(f"slice_{own}", F.pmod(F.xxhash64(*names[k]), slices(own))).withColumn(f"slice_{other}", F.explode(F.sequence(F.lit(0).cast("long"), slices(other) - 1)))
            still = still.select(*names[k], F.lit(level).alias("level"), *cells, "slice_a", "slice_b")
            done[k] = still if done[k] is None else done[k].unionByName(still)
            inside = _listed(marked.where("cut").withColumn("was", F.least("n_a", "n_b")), reaches[k], grid, cells, level + 1)
            children.append(inside.select(*names[k], *cells, "was"))
        if not full.where("cut").limit(1).count():
            break
        sides = [materialize(c) for c in children]
        full = materialize(_crowded(sides, at, crowd, level + 1))
        n = full.count()
    return *done, [*at, "level", "slice_a", "slice_b"]


def meet(a: DataFrame, b: DataFrame, keys: list[str], reach_a: Reach, reach_b: Reach, grid: float, crowd: int = CROWD, few: bool = False) -> DataFrame:
    """The pairs of rows with equal ``keys`` whose boxes share a point, edges included, each once.

    Boxes are given by axis as first and last coordinate, expressions over the columns of a side; apart from the keys
    the sides have no column in common.  Rows without a key or a coordinate meet nothing.  Cells are ``grid`` wide.  Counting the
    crowded cells is a job of its own; where none is found, the join is plain.  Slices go by a hash of whole
    rows, so only rows equal in all columns stay together.  With ``few`` all of ``b`` goes to every task under its cells: no row of
    ``a`` is shuffled for the join, so no cell can crowd a task and none is counted, cut or sliced.
    """
    if few:
        cells = [f"cell_{k}" for k in range(len(reach_a))]
        left, right, on = _listed(a, reach_a, grid, cells, 0), F.broadcast(_listed(b, reach_b, grid, cells, 0)), [*keys, *cells]
    else:
        left, right, on = placed(a, b, keys, reach_a, reach_b, grid, crowd)
    out = left.join(right, on)
    scale = F.pow(F.lit(2.0), F.col("level")) if "level" in on else F.lit(1.0)
    for k, ((low_a, high_a), (low_b, high_b)) in enumerate(zip(reach_a, reach_b)):
        corner = F.greatest(low_a, low_b)
        out = out.where((corner <= F.least(high_a, high_b)) & (F.floor(corner / grid * scale) == F.col(f"cell_{k}")))
    return out.drop(*[c for c in on if c not in keys])
