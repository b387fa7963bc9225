"""Scores of detection pairs inside windows, their normalisation and their average over windows.

A pair row has movie, t1 (window), t_i, l_i, t_j, l_j and a logit; only pairs within reach exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crowds import CROWD, around, meet, point
from ..functions.loops import materialize

PAIR = ("movie", "t1", "t_i", "l_i", "t_j", "l_j")
_AXES = ("cz", "cy", "cx")
CELLS = 4_000_000  # logits that a model makes in one call, about
BLOCK = 1_000_000  # logits of a window that are looked at together, about
ROWS = 50_000  # pairs in a batch that a task hands on, at most


def _dist() -> Column:
    square = lambda c: (F.col(f"{c}_i") - F.col(f"{c}_j")) * (F.col(f"{c}_i") - F.col(f"{c}_j"))
    return F.sqrt(sum((square(c) for c in _AXES), F.lit(0.0)))


def _near(a: DataFrame, b: DataFrame, keys: list[str], cutoff: float, crowd: int) -> DataFrame:
    """The pairs of ``a`` (suffix _i) and ``b`` (suffix _j) within ``cutoff`` and their distance."""
    pairs = meet(a, b, keys, [point("cy_i"), point("cx_i")], [around("cy_j", cutoff), around("cx_j", cutoff)], cutoff, crowd)
    return pairs.withColumn("dist", _dist()).where(F.col("dist") <= cutoff)


def window_pairs(windows: DataFrame, cutoff: float = 256, delta_t: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Pairs within a window not farther apart than ``cutoff``, with their distance; forward ones only, if ``delta_t`` is given.

    Both sides are keyed by grid cells of the size of the cutoff, so that a frame's detections meet only near ones; cells with
    more than ``crowd`` of them are cut and sliced.
    """
    side = lambda s: windows.select("movie", "t1", F.col("t").alias(f"t_{s}"), F.col("label").alias(f"l_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in _AXES])
    pairs = _near(side("i"), side("j"), ["movie", "t1"], cutoff, crowd)
    if delta_t is not None:
        pairs = pairs.where((F.col("t_j") > F.col("t_i")) & (F.col("t_j") - F.col("t_i") <= delta_t))
    return pairs.select(*PAIR, "dist")


def detection_pairs(nodes: DataFrame, window: int, cutoff: float = 256, delta_t: int | None = None, crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of detections that share a window of ``window`` frames and lie within ``cutoff``, each made once, with their distance.

    Frames and grid cells are join keys, crowded cells cut and sliced; a pair over two frames is found forward and mirrored.  With
    ``delta_t`` only forward pairs at most that many frames apart come out.  Columns to ``carry`` come out for both ends, with suffixes
    _i and _j.  :func:`in_windows` deals pairs to windows.
    """
    side = lambda s: nodes.select("movie", F.col("t").alias(f"t_{s}"), F.col("label").alias(f"l_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*_AXES, *carry)])
    steps = range(0 if delta_t is None else 1, window if delta_t is None else min(window - 1, delta_t) + 1)
    earlier = side("j").withColumn("t_i", F.explode(F.array(*[F.col("t_j") - k for k in steps])))
    pairs = _near(side("i"), earlier, ["movie", "t_i"], cutoff, crowd)
    keys = ("t_i", "l_i", "t_j", "l_j", *[f"{c}_{s}" for c in carry for s in "ij"])
    if delta_t is not None:
        return pairs.select("movie", *keys, "dist")
    way = lambda names: F.struct(*[F.col(x).alias(y) for x, y in zip(names, keys)])
    back = ("t_j", "l_j", "t_i", "l_i", *[f"{c}_{s}" for c in carry for s in "ji"])
    ways = F.when(F.col("t_i") == F.col("t_j"), F.array(way(keys))).otherwise(F.array(way(keys), way(back)))
    return pairs.select("movie", F.explode(ways).alias("p"), "dist").select("movie", "p.*", "dist")


def named_pairs(nodes: DataFrame, partners: Column, window: int, cutoff: float = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of :func:`detection_pairs` whose second label is among ``partners``, an array over the first one's ``label``, without others being made.

    Labels are the join keys, in blocks of ``window`` frames, so a detection meets its partners of three blocks at most.
    """
    side = lambda s: (F.col("t").alias(f"t_{s}"), F.col("label").alias(f"l_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in (*_AXES, *carry)])
    block = F.floor(F.col("t") / window)
    first = nodes.withColumn("partner", F.explode(partners)).select("movie", *side("i"), "partner", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    second = nodes.select("movie", *side("j"), F.col("label").alias("partner"), block.alias("block"))
    met = first.join(second.hint("merge"), ["movie", "partner", "block"]).where(F.abs(F.col("t_i") - F.col("t_j")) < window)
    keys = ("t_i", "l_i", "t_j", "l_j", *[f"{c}_{s}" for c in carry for s in "ij"])
    return met.withColumn("dist", _dist()).where(F.col("dist") <= cutoff).select("movie", *keys, "dist")


def in_windows(pairs: DataFrame, movies: DataFrame, window: int) -> DataFrame:
    """``pairs`` once for each window (t1) of ``window`` frames that holds both frames; ``movies`` has movie and n_frames, a row for each movie."""
    first, last = F.greatest(F.lit(0), F.greatest("t_i", "t_j") - window + 1), F.least(F.least("t_i", "t_j"), F.col("n_frames") - window)
    return pairs.join(movies, "movie").where(first <= last).withColumn("t1", F.explode(F.sequence(first, last))).drop("n_frames")


def linear_score(max_distance: float) -> Column:
    return 1 - F.col("dist") / F.lit(float(max_distance))


def decay_score(rate: float = 0.01) -> Column:
    return F.exp(-rate * F.col("dist"))


def score_windows(windows: DataFrame, scorer: Column | Callable, cutoff: float = 256, delta_t: int | None = None) -> DataFrame:
    """Logits of the pairs of each window.

    ``scorer`` is an expression over ``dist``, or a function that takes a pandas frame of one window's detections
    and returns one of PAIR columns and logit; the latter runs in a grouped map, one window in memory at a time.
    :func:`score_batches` is for models that take several windows at once.
    """
    if isinstance(scorer, Column):
        return window_pairs(windows, cutoff, delta_t).withColumn("logit", scorer)
    schema = "movie string, t1 int, t_i int, l_i int, t_j int, l_j int, logit double"
    return windows.groupBy("movie", "t1").applyInPandas(scorer, schema)


def _looked_at(frames: list[np.ndarray], most: int, delta_t: int | None) -> Iterator[tuple[slice, slice]]:
    """Ranges of rows and columns that cover all wanted pairs of windows with such sorted frames, about ``BLOCK`` cells each."""
    side = max(1, int((BLOCK / len(frames)) ** 0.5))
    for a in range(0, most, side):
        first, last = 0, most
        if delta_t is not None:
            held = [t for t in frames if len(t) > a]
            first = min(int(np.searchsorted(t, t[a], "right")) for t in held)
            last = max(int(np.searchsorted(t, t[min(a + side, len(t)) - 1] + delta_t, "right")) for t in held)
        for b in range(first, last, side):
            yield slice(a, min(a + side, most)), slice(b, min(b + side, last))


def _scored(make: Callable, batch: int, cutoff: float, delta_t: int | None, width: int, cells: int):
    def flush(score, held: list) -> Iterator[pa.RecordBatch]:
        most = max(len(x[2]) for x in held)
        places, values = np.zeros((len(held), most, 4)), np.zeros((len(held), most, width))
        padding = np.ones((len(held), most), bool)
        for k, (_, _, t, _, at, f) in enumerate(held):
            places[k, : len(t), 0], places[k, : len(t), 1:], values[k, : len(t)], padding[k, : len(t)] = t, at, f, False
        made = score(places, values, padding)
        whole = None if callable(made) else np.asarray(made)
        for rows, columns in _looked_at([x[2] for x in held], most, delta_t):
            logits = made(rows, columns) if whole is None else whole[:, rows, columns]
            for k, (movie, t1, t, label, at, _) in enumerate(held):
                far = np.zeros((len(t[rows]), len(t[columns])))
                for c in at.T:
                    far += (c[rows, None] - c[None, columns]) ** 2
                near = np.sqrt(far, out=far) <= cutoff
                if delta_t is not None:
                    step = t[None, columns] - t[rows, None]
                    near &= (step > 0) & (step <= delta_t)
                i, j = np.nonzero(near)
                for n in range(0, len(i), ROWS):
                    a, b = i[n : n + ROWS], j[n : n + ROWS]
                    names = pa.array([movie] * len(a), pa.string()), pa.array(np.full(len(a), t1, np.int32))
                    ends = t[rows][a], label[rows][a], t[columns][b], label[columns][b]
                    yield pa.RecordBatch.from_arrays([*names, *map(pa.array, ends), pa.array(logits[k, a, b].astype(np.float64))], names=[*PAIR, "logit"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        score, held = make(), []
        for rows in batches:
            d = rows.column("d")
            fields, offsets = d.flatten(), d.offsets.to_numpy()
            column = {x: fields.field(x).to_numpy(zero_copy_only=False) for x in ("t", "label", "cz", "cy", "cx")}
            at = np.stack([column[c] for c in ("cz", "cy", "cx")], axis=1)
            f = fields.field("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if width else np.zeros((len(at), 0))
            for k, (a, b) in enumerate(zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])):
                longest = max([b - a, *[len(x[2]) for x in held]])
                if held and (len(held) == batch or (len(held) + 1) * longest**2 > cells):
                    yield from flush(score, held)
                    held = []
                held.append((rows.column("movie")[k].as_py(), rows.column("t1")[k].as_py(), column["t"][a:b], column["label"][a:b], at[a:b], f[a:b]))
        if held:
            yield from flush(score, held)

    return run


def score_batches(windows: DataFrame, make_scorer: Callable, features: tuple[str, ...] = (), batch: int = 16, cutoff: float = 256, delta_t: int | None = None, cells: int = CELLS) -> DataFrame:
    """Logits of the pairs of each window from a model that scores up to ``batch`` windows in one call.

    ``make_scorer`` is called once in each task, where it loads the model, and returns a function of places (windows, detections,
    4: frame, z, y, x), feature values (windows, detections, features) and padding (true where a window has fewer
    detections than the longest of its batch).  It returns logits (windows, detections, detections), or a function of a slice of
    first and a slice of second detections that returns theirs, so that no window's logits are held at once.  A task's windows are sorted by
    length, so batches are padded little; detections are ordered by frame and label.  Pairs farther apart than ``cutoff``
    are left out, and with ``delta_t`` all but forward ones at most that many frames apart.  A call gets fewer windows where their
    padded logits would have more than ``cells`` cells; a single window is handed over whole, its logits are asked for in blocks.
    """
    one = F.struct(F.col("t").cast("int").alias("t"), F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in ("cz", "cy", "cx")], F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>").alias("f"))
    rows = windows.groupBy("movie", "t1").agg(F.sort_array(F.collect_list(one)).alias("d"))
    rows = rows.withColumn("n", F.size("d")).sortWithinPartitions("n", "movie", "t1").select("movie", "t1", "d")
    return rows.mapInArrow(_scored(make_scorer, batch, cutoff, delta_t, len(features), cells), "movie string, t1 int, t_i int, l_i int, t_j int, l_j int, logit double")


def _block(pairs: DataFrame, over_rows: bool) -> list[str]:
    """The columns that name an entry's block: the fixed side and the frame of the other side, in one window if there are windows."""
    return ["movie", *(["t1"] if "t1" in pairs.columns else []), *(("t_j", "l_j", "t_i") if over_rows else ("t_i", "l_i", "t_j"))]


def parental_norm(pairs: DataFrame, mode: str = "quiet_softmax", eps: float = 1e-6, forward_only: bool = False) -> DataFrame:
    """``value``: the logit normalised over the candidates of one frame.

    For a forward pair these are the detections of i's frame, for given j ("which parent?"); otherwise those of
    j's frame, for given i.  softmax, quiet_softmax (one more logit of 0), linear (sigmoids) or none (sigmoid).
    Linking needs forward pairs only and then one direction is not computed.  Both directions share one
    shuffle.  Where logits do not depend on the window, pairs without ``t1`` give the same values for less.
    """
    if mode not in ("none", "softmax", "quiet_softmax", "linear"):
        raise ValueError(f"unknown mode {mode}")
    rows = pairs.where("t_j > t_i") if forward_only else pairs
    a = F.col("logit")
    sigmoid = 1 / (1 + F.exp(-a))
    if mode == "none":
        return rows.withColumn("value", sigmoid)
    forward = F.col("t_j") > F.col("t_i")
    fixed = lambda i, j: F.when(forward, F.col(j)).otherwise(F.col(i))
    rows = rows.withColumns({"_t": fixed("t_i", "t_j"), "_l": fixed("l_i", "l_j"), "_o": fixed("t_j", "t_i"), "_f": forward})
    block = Window.partitionBy("movie", *(["t1"] if "t1" in pairs.columns else []), "_t", "_l", "_o", "_f")
    if mode == "linear":
        value = sigmoid / (F.sum(sigmoid).over(block) + eps)
    else:
        rows = rows.withColumn("_top", F.greatest(F.max("logit").over(block), F.lit(0.0))).withColumn("_e", F.exp(a - F.col("_top")))
        quiet = F.exp(-F.col("_top")) if mode == "quiet_softmax" else F.lit(0.0)
        value = F.col("_e") / (F.sum("_e").over(block) + quiet + eps)
    return rows.withColumn("value", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).select(*pairs.columns, "value")


def _blocks(kind: str) -> tuple[Column, Column, Column, Callable]:
    """A block's fixed end, the step to its other frame, and where a pair finds a carried column of that end."""
    forward, step = F.col("t_j") > F.col("t_i"), F.col("t_j") - F.col("t_i")
    if kind == "rows":
        return F.col("t_j"), F.col("l_j"), step, lambda c: F.col(f"{c}_j")
    if kind in ("columns", "mirrored"):
        return F.col("t_i"), F.col("l_i"), step if kind == "columns" else -step, lambda c: F.col(f"{c}_i")
    fixed = lambda c: F.when(forward, F.col(f"{c}_j")).otherwise(F.col(f"{c}_i"))
    return fixed("t"), fixed("l"), step, fixed


def carry_blocks(nodes: DataFrame, pairs: DataFrame, window: int, kind: str, how: Column, name: str) -> DataFrame:
    """``nodes`` with an array ``name``: ``how`` over each block of ``pairs`` that a node is the fixed end of, by step between its frames.

    Blocks are rows (fixed j), columns (fixed i) or parents (j of forward pairs, else i); where pairs (i, j) and (j, i) have the same logit, rows are
    also found from i, as mirrored, in place of columns.  Only partial sums are shuffled; pairs made
    again from the nodes bring the results along (:func:`carried`).
    """
    t, label, step, _ = _blocks(kind)
    sums = pairs.groupBy("movie", t.alias("t"), label.alias("label"), step.alias("step")).agg(how.alias("v"))
    wide = sums.groupBy("movie", "t", "label").agg(F.array(*[F.max(F.when(F.col("step") == k, F.col("v"))) for k in range(1 - window, window)]).alias(name))
    return materialize(nodes.join(wide, ["movie", "t", "label"], "left"))


def carried(name: str, window: int, kind: str) -> Column:
    """What :func:`carry_blocks` found for a pair's block."""
    _, _, step, end = _blocks(kind)
    return F.element_at(end(name), step + window)


def carry_norm(nodes: DataFrame, make: Callable, window: int, mode: str = "quiet_softmax", eps: float = 1e-6) -> tuple[DataFrame, tuple[str, ...], Column]:
    """``nodes`` with what normalisation needs, the columns to carry, and the ``value`` of a pair made with them, as of :func:`parental_norm`.

    ``make(nodes, *carry)`` makes pairs with a logit that depends on the two ends alone, the same in each call.  Pairs are made again
    for each pass and none is shuffled.
    """
    if mode not in ("softmax", "quiet_softmax", "linear"):
        raise ValueError(f"unknown mode {mode}")
    a = F.col("logit")
    sigmoid = 1 / (1 + F.exp(-a))
    if mode == "linear":
        nodes, carry = carry_blocks(nodes, make(nodes), window, "parents", F.sum(sigmoid), "_sum"), ("_sum",)
        value = sigmoid / (carried("_sum", window, "parents") + eps)
    else:
        nodes, carry = carry_blocks(nodes, make(nodes), window, "parents", F.greatest(F.max(a), F.lit(0.0)), "_top"), ("_top", "_sum")
        top = carried("_top", window, "parents")
        nodes = carry_blocks(nodes, make(nodes, "_top"), window, "parents", F.sum(F.exp(a - top)), "_sum")
        quiet = F.exp(-top) if mode == "quiet_softmax" else F.lit(0.0)
        value = F.exp(a - top) / (carried("_sum", window, "parents") + quiet + eps)
    return nodes, carry, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def normed_pairs(nodes: DataFrame, make: Callable, window: int, mode: str = "quiet_softmax", eps: float = 1e-6) -> DataFrame:
    """The pairs of ``make`` (see :func:`carry_norm`) with their ``value``."""
    nodes, carry, value = carry_norm(nodes, make, window, mode, eps)
    return make(nodes, *carry).withColumn("value", value).drop(*[f"{c}_{s}" for c in carry for s in "ij"])


def blockwise_reduce(pairs: DataFrame, column: str = "value", over_rows: bool = True, how: str = "sum") -> DataFrame:
    """Sum or maximum over the entries of one frame on one side, at every entry; the maximum counts 0 as well."""
    block = Window.partitionBy(*_block(pairs, over_rows))
    return pairs.withColumn("reduced", F.sum(column).over(block) if how == "sum" else F.greatest(F.max(column).over(block), F.lit(0.0)))


def score_mask(pairs: DataFrame, delta_t: int = 1, threshold: float = 0.05) -> DataFrame:
    """Forward pairs at most ``delta_t`` frames apart with a value of ``threshold`` or more."""
    return pairs.where((F.col("t_j") > F.col("t_i")) & (F.col("t_j") - F.col("t_i") <= delta_t) & (F.col("value") >= threshold))


def average_over_windows(pairs: DataFrame, window: int, weight: float = 0.0) -> DataFrame:
    """Weighted mean value of each pair over the windows that hold it; windows centred on t_i count most if ``weight`` > 0."""
    w = F.exp(-weight * F.pow(F.col("t_i") - (F.col("t1") + (window - 1) / 2), 2))
    keys = ["movie", "t_i", "l_i", "t_j", "l_j"]
    return pairs.groupBy(*keys).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def window_counts(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Detections of each window and its divisions: detections with a frame of two associations and none with more."""
    size = windows.groupBy("movie", "t1").agg(F.count(F.lit(1)).alias("n_objects"))
    most = pairs.where("value > 0").groupBy("movie", "t1", "t_i", "l_i", "t_j").count().groupBy("movie", "t1", "t_i", "l_i").agg(F.max("count").alias("most"))
    divs = most.where("most = 2").groupBy("movie", "t1").agg(F.count(F.lit(1)).alias("n_divs"))
    return size.join(divs, ["movie", "t1"], "left").withColumn("n_divs", F.coalesce("n_divs", F.lit(0)))


def detection_counts(pairs: DataFrame, windows: DataFrame, movies: DataFrame, window: int) -> DataFrame:
    """:func:`window_counts` where associations (``pairs`` without t1) do not depend on the window: each detection's are counted once by step."""
    size = windows.groupBy("movie", "t1").agg(F.count(F.lit(1)).alias("n_objects"))
    steps = F.array(*[F.count_if(F.col("t_j") - F.col("t_i") == k) for k in range(1 - window, window)])
    dealt = in_windows(pairs.groupBy("movie", "t_i", "l_i").agg(steps.alias("n")).withColumn("t_j", F.col("t_i")), movies, window)
    most = F.array_max(F.slice("n", F.col("t1") - F.col("t_i") + window, window))
    divs = dealt.where(most == 2).groupBy("movie", "t1").agg(F.count(F.lit(1)).alias("n_divs"))
    return size.join(divs, ["movie", "t1"], "left").withColumn("n_divs", F.coalesce("n_divs", F.lit(0)))


def division_ratio(counts: DataFrame) -> DataFrame:
    """Divisions over detections, and the window with most divisions (the earliest of those tied), of each movie."""
    best = F.max_by("t1", F.struct("n_divs", -F.col("t1")))
    return counts.groupBy("movie").agg((F.sum("n_divs") / F.sum("n_objects")).alias("ratio"), best.alias("busiest"))


def _entry_loss(rows: Column, cols: Column, div_upweight: float, normalised: bool) -> Column:
    """The weighted loss of an entry, whose row and column hold so many true ones."""
    a, y, p = F.col("logit"), F.col("truth").cast("double"), F.col("value")
    raw = F.greatest(a, F.lit(0.0)) - a * y + F.log1p(F.exp(-F.abs(a)))
    log = lambda x: F.greatest(F.when(x > 0, F.ln(x)).otherwise(-100.0), F.lit(-100.0))
    loss = 0.01 * raw - (y * log(p) + (1 - y) * log(1 - p)) if normalised else raw
    b = y * (rows + cols)
    return loss * (1 + F.when(b == 2, 1.0).otherwise(0.0) + F.when(b > 2, float(div_upweight)).otherwise(0.0))


def _movie_loss(per: DataFrame, eps: float) -> DataFrame:
    share = F.pow("n", F.lit(0.2))
    return per.groupBy("movie").agg((F.sum(share * F.col("total") / (F.col("n") + eps)) / F.sum(share)).alias("loss"))


def detection_loss(nodes: DataFrame, movies: DataFrame, make: Callable, window: int, div_upweight: float = 20.0, eps: float = 2.0**-23) -> DataFrame:
    """:func:`association_loss` where neither logits nor truth depend on the window; ``make`` makes the forward pairs that count, with truth.

    Each pair's loss is summed by pair of frames, and the sums are dealt to windows.
    """
    truth = F.sum(F.col("truth").cast("double"))
    nodes, carry, value = carry_norm(nodes, make, window)
    for kind in ("rows", "columns"):
        nodes = carry_blocks(nodes, make(nodes), window, kind, truth, f"_{kind}")
    pairs = make(nodes, *carry, "_rows", "_columns").withColumn("value", value)
    loss = _entry_loss(carried("_rows", window, "rows"), carried("_columns", window, "columns"), div_upweight, True)
    frames = pairs.groupBy("movie", "t_i", "t_j").agg(F.sum(loss).alias("total"), F.count(F.lit(1)).alias("n"))
    per = in_windows(frames, movies, window).groupBy("movie", "t1").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return _movie_loss(per, eps)


def association_loss(pairs: DataFrame, delta_cutoff: int = 2, div_upweight: float = 20.0, normalised: bool = True, eps: float = 2.0**-23) -> DataFrame:
    """Loss of predicted pairs (logit, value) against truth (0 or 1), per movie.

    Cross entropy of the logits, or 0.01 of it plus that of the normalised values; entries of divisions weigh
    more; each window's mean is weighted by its number of counted entries to the power 0.2.
    """
    keep = (F.col("t_j") > F.col("t_i")) & (F.col("t_j") - F.col("t_i") <= delta_cutoff)
    rows = blockwise_reduce(pairs.withColumn("truth", F.col("truth").cast("double")), "truth", True).withColumnRenamed("reduced", "rows")
    both = blockwise_reduce(rows, "truth", False).withColumnRenamed("reduced", "cols")
    loss = _entry_loss(F.col("rows"), F.col("cols"), div_upweight, normalised)
    per = both.where(keep).groupBy("movie", "t1").agg(F.sum(loss).alias("total"), F.count(F.lit(1)).alias("n"))
    return _movie_loss(per, eps)
