"""Linking: from candidate edges to a forest in which a node has one parent and at most two children."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import CELLS, assignment_parts, best_assignment, certificate
from ..functions.loops import fixpoint, materialize

EDGE = "movie string, src struct<t:int,label:int>, dst struct<t:int,label:int>, dist double, weight double"
#: The cost settings that solutions are compared with.
CONFIGS = {
    "gt": {"nodeW": 0.0, "nodeC": -10.0, "edgeW": -1.0, "edgeC": 0.0, "appearC": 0.25, "disappearC": 0.5, "splitC": 0.25},
    "deepcell_gt": {"nodeW": 0.0, "nodeC": -10.0, "edgeW": -1.0, "edgeC": 0.0, "appearC": 0.25, "disappearC": 0.5, "splitC": 1.0},
    "deepcell_gt_tuned": {"nodeW": 0.0, "nodeC": -10.0, "edgeW": -1.0, "edgeC": 0.0, "appearC": 0.5, "disappearC": 0.5, "splitC": 1.0},
    "deepcell_res_tuned": {"nodeW": 0.0, "nodeC": 0.25, "edgeW": -1.0, "edgeC": -0.25, "appearC": 0.25, "disappearC": 0.25, "splitC": 1.0},
}
MOST_IN_GROUP = 2_000_000  # edges of a frame pair that one task goes through


def _order() -> list:
    return [F.col("weight").desc(), F.col("src.t"), F.col("src.label"), F.col("dst.t"), F.col("dist"), F.col("dst.label")]


def _frame_greedy(children: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, used, keep = set(), {}, []
        for place, (i, j) in enumerate(zip(rows["li"], rows["lj"])):
            if j not in taken and used.get(i, 0) < children:
                taken.add(j)
                used[i] = used.get(i, 0) + 1
                keep.append(place)
        return rows.iloc[keep][["movie", "ti", "li", "tj", "lj", "dist", "weight"]]

    return run


def link_greedy(edges: DataFrame, allow_divisions: bool = True, threshold: float = 0.5, method: str = "rounds") -> DataFrame:
    """Edges taken by descending weight, down to ``threshold``, if the target is free and the source has fewer than two (one) children.

    Ties go by source, target frame, distance and target label.  ``rounds`` takes in each round every edge that
    is the best one left at its target and among the best that its source can still take; that equals the
    sequence and works for any frame distance.  ``frames`` goes through the sequence for each pair of frames in
    one group, and by rounds for pairs of frames with more edges than a task should hold; it is for edges between adjacent
    frames only.  Nodes without an edge are not in the result.
    """
    children = 2 if allow_divisions else 1
    heavy = edges.where(F.col("weight") > 1)
    edges = edges.where(F.col("weight") >= threshold)
    if method == "frames":
        flat = edges.select("movie", F.col("src.t").alias("ti"), F.col("src.label").alias("li"), F.col("dst.t").alias("tj"), F.col("dst.label").alias("lj"), "dist", "weight")
        checked = F.assert_true((F.col("weight") <= 1) & (F.col("tj") == F.col("ti") + 1), F.lit("weights above 1 or edges over several frames"))
        flat = materialize(flat.where(checked.isNull()))
        large = flat.groupBy("movie", "ti").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_GROUP).select("movie", "ti")
        rest = None
        if large.limit(1).count():
            many = flat.join(large, ["movie", "ti"], "left_semi").select("movie", F.struct(F.col("ti").alias("t"), F.col("li").alias("label")).alias("src"), F.struct(F.col("tj").alias("t"), F.col("lj").alias("label")).alias("dst"), "dist", "weight")
            rest, flat = link_greedy(many, allow_divisions, threshold), flat.join(large, ["movie", "ti"], "left_anti")
        flat = flat.repartition("movie", "ti").sortWithinPartitions("movie", "ti", F.col("weight").desc(), "li", "dist", "lj")
        sort = lambda rows: rows.sort_values(["weight", "li", "dist", "lj"], ascending=[False, True, True, True], kind="stable")
        greedy = _frame_greedy(children)
        out = flat.groupBy("movie", "ti").applyInPandas(lambda rows: greedy(sort(rows)), "movie string, ti int, li int, tj int, lj int, dist double, weight double")
        out = out.select("movie", F.struct(F.col("ti").alias("t"), F.col("li").alias("label")).alias("src"), F.struct(F.col("tj").alias("t"), F.col("lj").alias("label")).alias("dst"), "dist", "weight")
        return out if rest is None else out.unionByName(rest)
    if heavy.limit(1).count():
        raise ValueError("weights must not exceed 1")
    start = edges.select("movie", "src", "dst", "dist", "weight", F.lit(0).alias("used"), F.lit(False).alias("taken"))
    by_dst, by_src = Window.partitionBy("movie", "dst"), Window.partitionBy("movie", "src")

    def step(now: DataFrame) -> DataFrame:
        open_ = now.where("not taken").withColumn("best", F.row_number().over(by_dst.orderBy(*_order())) == 1)
        open_ = open_.withColumn("take", F.col("best") & (F.row_number().over(by_src.orderBy(*_order())) + F.col("used") <= children))
        open_ = open_.withColumn("used", (F.col("used") + F.sum(F.col("take").cast("int")).over(by_src)).cast("int")).withColumn("full", F.max("take").over(by_dst))
        done = open_.where("take").select("movie", "src", "dst", "dist", "weight", "used", F.lit(True).alias("taken"))
        left = open_.where(~F.col("full") & (F.col("used") < children)).select("movie", "src", "dst", "dist", "weight", "used", F.lit(False).alias("taken"))
        return now.where("taken").unionByName(done).unionByName(left)

    return fixpoint(start, step, lambda now: now.where("not taken")).select("movie", "src", "dst", "dist", "weight")


def _costs(config: str | dict) -> dict[str, float]:
    return dict(CONFIGS[config]) if isinstance(config, str) else dict(config)


def _node_terms(k: dict[str, float], children: int) -> dict:
    """Columns of a node's two sides under its multiplier ``lam``: what they cost alone, and what a parent or a child adds.

    The target side pays ``lam`` and the source side the rest of the node's cost.  A source side with a first and a second
    child whose costs fall is replaced by their mean, which keeps the bound a bound.
    """
    c, a, d, s = k["nodeW"] + k["nodeC"], k["appearC"], k["disappearC"], k["splitC"]
    lam = F.col("lam")
    into = F.least(F.lit(0.0), lam + a)
    out = F.least(F.lit(0.0), c - lam + d)
    first = c - lam - out
    mean = (first + s) / 2 if children == 2 else first
    falls = first > s if children == 2 else F.lit(False)
    return {
        "alone_in": into, "alone_out": out, "parent": lam - into,
        "child0": F.when(falls, mean).otherwise(first), "child1": F.when(falls, mean).otherwise(F.lit(float(s))),
        "has_in": lam + a < 0, "has_out": c - lam + d < 0,
    }


def optimal_solution(edges: DataFrame, nodes: DataFrame | None = None, config: str | dict = "gt", allow_divisions: bool = True, rounds: int = 60, tolerance: float = 1e-6, cells: int = CELLS) -> dict[str, DataFrame]:
    """``edges`` of a cheapest solution, its ``nodes``, and per movie its ``cost`` with a ``bound`` that no solution undercuts.

    Nodes may be left out, edges may skip frames.  A node's source side and target side are solved apart, tied by a
    multiplier: the cheapest choice of edges between sides is an assignment of targets to the first and second places
    of sources.  Its total bounds the cost; any choice of edges is a solution.  Multipliers move against the disagreement
    of the two sides until cost and bound meet within ``tolerance``, or for ``rounds``; each movie keeps its best solution.
    Where every node is worth selecting alone (as in the first three settings) the sides agree at once and one round is exact.
    ``nodes`` (movie, t, label) adds nodes without edges.  A split that pays by itself, and ties between
    settings, may leave a gap, which the result shows.
    """
    k = _costs(config)
    children = 2 if allow_divisions else 1
    node_cost, alone = k["nodeW"] + k["nodeC"], k["nodeW"] + k["nodeC"] + k["appearC"] + k["disappearC"]
    number = lambda c: F.shiftleft(F.col(f"{c}.t").cast("long"), 32) + F.col(f"{c}.label")
    price = k["edgeW"] * F.col("weight") + k["edgeC"]
    flat = materialize(edges.select("movie", "src", "dst", "dist", "weight", number("src").alias("i"), number("dst").alias("j"), price.alias("price")))
    ends = flat.select("movie", F.col("src").alias("node"), F.col("i").alias("n")).unionByName(flat.select("movie", F.col("dst").alias("node"), F.col("j").alias("n")))
    if nodes is not None:
        more = nodes.select("movie", F.struct(F.col("t").cast("int").alias("t"), F.col("label").cast("int").alias("label")).alias("node"))
        ends = ends.unionByName(more.withColumn("n", number("node")))
    ends = materialize(ends.distinct())
    places = flat.select("movie", "i", "j", "price", F.explode(F.array(*[F.lit(x) for x in range(children)])).alias("slot")).withColumn("a", 2 * F.col("i") + F.col("slot")).withColumn("b", F.col("j"))
    # Where every node stands, an edge without gain stays one; otherwise multipliers may turn any edge's gain.
    fixed = alone < 0
    if fixed:
        first, second = k["disappearC"], -k["splitC"]
        if second > first:
            first = second = max(first, second)
        places = places.where(-F.col("price") + k["appearC"] + F.when(F.col("slot") == 0, first).otherwise(second) > 0)
    places = materialize(places)
    # Where all edges are as long, those from one frame share no node with others, so movies are cut by frames without a search.
    step = flat.agg(F.min(F.col("dst.t") - F.col("src.t")).alias("low"), F.max(F.col("dst.t") - F.col("src.t")).alias("high")).first()
    if step["low"] == step["high"]:
        parts = assignment_parts(places.withColumn("frame", F.shiftright("i", 32)), ["movie", "frame"], cells).drop("frame")
    else:
        parts = assignment_parts(places, ["movie"], cells)
    start = (node_cost - k["appearC"] + k["disappearC"]) / 2
    state = materialize(ends.select("movie", "n", F.lit(float(start)).alias("lam")))
    best = bounds = None
    for turn in range(rounds):
        terms = state.select("movie", "n", "lam", *[v.alias(name) for name, v in _node_terms(k, children).items()])
        terms = materialize(terms)
        rows = places.join(terms.select("movie", F.col("n").alias("i"), "child0", "child1"), ["movie", "i"]).join(terms.select("movie", F.col("n").alias("j"), "parent"), ["movie", "j"])
        gain = -(F.col("price") + F.col("parent") + F.when(F.col("slot") == 0, F.col("child0")).otherwise(F.col("child1")))
        solved = materialize(best_assignment(rows.select("movie", "a", "b", gain.alias("gain")), ["movie"], parts, cells))
        taken = solved.where("matched").select("movie", F.floor(F.col("a") / 2).cast("long").alias("i"), F.col("b").alias("j"))
        chosen = materialize(_trimmed(flat.join(taken, ["movie", "i", "j"]), k))
        of = lambda table, c, name: table.groupBy("movie", F.col(c).alias("n")).agg(F.count(F.lit(1)).alias(name))
        now = terms.join(of(taken, "j", "x_in"), ["movie", "n"], "left").join(of(taken, "i", "x_out"), ["movie", "n"], "left")
        now = now.join(of(chosen, "j", "n_in"), ["movie", "n"], "left").join(of(chosen, "i", "n_out"), ["movie", "n"], "left").na.fill(0, ["x_in", "x_out", "n_in", "n_out"])
        apart = ((F.col("x_in") > 0) | F.col("has_in")).cast("int") - ((F.col("x_out") > 0) | F.col("has_out")).cast("int")
        used = (F.col("n_in") > 0) | (F.col("n_out") > 0) | F.lit(fixed)
        cost = F.when(used, node_cost + F.when(F.col("n_in") == 0, k["appearC"]).otherwise(0.0) + F.when(F.col("n_out") == 0, k["disappearC"]).otherwise(0.0)).otherwise(0.0) + F.when(F.col("n_out") > 1, k["splitC"]).otherwise(0.0)
        now = materialize(now.select("movie", "n", "lam", apart.alias("apart"), cost.alias("cost"), (F.col("alone_in") + F.col("alone_out")).alias("alone")))
        per = now.groupBy("movie").agg(F.sum("cost").alias("cost"), F.sum("alone").alias("alone"), F.sum(F.col("apart") * F.col("apart")).alias("apart2"))
        dual = certificate(solved, ["movie"]).select("movie", "dual")
        per = per.join(dual, "movie", "left").join(chosen.groupBy("movie").agg(F.sum("price").alias("paid")), "movie", "left").na.fill(0.0, ["dual", "paid"])
        per = per.select("movie", (F.col("cost") + F.col("paid")).alias("cost"), (F.col("alone") - F.col("dual")).alias("bound"), "apart2")
        if bounds is None:
            merged = per.withColumn("better", F.lit(True))
        else:
            old = bounds.select("movie", F.col("cost").alias("old_cost"), F.col("bound").alias("old_bound"))
            merged = per.join(old, "movie").select("movie", F.least("cost", "old_cost").alias("cost"), F.greatest("bound", "old_bound").alias("bound"), "apart2", (F.col("cost") < F.col("old_cost")).alias("better"), F.col("bound").alias("here"))
        if "here" not in merged.columns:
            merged = merged.withColumn("here", F.col("bound"))
        bounds = materialize(merged)
        fresh = chosen.join(bounds.where("better").select("movie"), "movie", "left_semi")
        best = materialize(fresh if best is None else fresh.unionByName(best.join(bounds.where("not better").select("movie"), "movie", "left_semi")))
        open_ = (F.col("cost") - F.col("bound") > tolerance * (1 + F.abs("cost"))) & (F.col("apart2") > 0)
        if not bounds.where(open_).limit(1).count():
            break
        step = 1.2 * 0.97**turn * (F.col("cost") - F.col("here")) / F.greatest(F.col("apart2"), F.lit(1))
        state = materialize(now.join(bounds.select("movie", F.when(open_, step).otherwise(0.0).alias("step")), "movie").select("movie", "n", (F.col("lam") + F.col("step") * F.col("apart")).alias("lam")))
    chosen = best.select("movie", "src", "dst", "dist", "weight")
    picked = ends.select("movie", "node")
    if not fixed:
        picked = chosen.select("movie", F.col("src").alias("node")).unionByName(chosen.select("movie", F.col("dst").alias("node"))).distinct()
    return {"edges": chosen, "nodes": picked.select("movie", "node.t", "node.label"), "bounds": bounds.select("movie", "cost", "bound")}


def _trimmed(chosen: DataFrame, k: dict[str, float]) -> DataFrame:
    """``chosen`` without the edges at an end of a track that cost more than they save, one step from each end."""
    c, d, s = k["nodeW"] + k["nodeC"], k["disappearC"], k["splitC"]
    if c + k["appearC"] + d < 0:
        return chosen
    kids = chosen.groupBy("movie", "i").agg(F.count(F.lit(1)).alias("kids"))
    last = chosen.join(kids.select("movie", F.col("i").alias("j"), F.lit(True).alias("goes_on")), ["movie", "j"], "left").join(kids, ["movie", "i"])
    # A leaf's own cost and end go with it; its parent ends in its place, or splits no more.
    leaf = F.col("goes_on").isNull() & (F.col("price") + c + F.when(F.col("kids") > 1, d + s).otherwise(0.0) > 0)
    kept = last.where(~leaf).drop("goes_on", "kids")
    kids = kept.groupBy("movie", "i").agg(F.count(F.lit(1)).alias("kids"))
    has = kept.select("movie", F.col("j").alias("i"), F.lit(True).alias("has_parent"))
    first = kept.join(kids, ["movie", "i"]).join(has, ["movie", "i"], "left")
    root = F.col("has_parent").isNull() & (F.col("kids") == 1) & (F.col("price") + c > 0)
    kept = first.where(~root).drop("kids", "has_parent")
    # Two nodes alone must pay for themselves.
    kids = kept.select("movie", F.col("i").alias("j"), F.lit(True).alias("goes_on")).distinct()
    has = kept.select("movie", F.col("j").alias("i"), F.lit(True).alias("has_parent"))
    n = kept.groupBy("movie", "i").agg(F.count(F.lit(1)).alias("kids"))
    pair = kept.join(kids, ["movie", "j"], "left").join(has, ["movie", "i"], "left").join(n, ["movie", "i"])
    lone = F.col("goes_on").isNull() & F.col("has_parent").isNull() & (F.col("kids") == 1) & (F.col("price") + 2 * c + k["appearC"] + d > 0)
    return pair.where(~lone).drop("goes_on", "has_parent", "kids")


def link_optimal(edges: DataFrame, config: str | dict = "gt", allow_divisions: bool = True, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """The edges of :func:`optimal_solution`."""
    return optimal_solution(edges, nodes, config, allow_divisions, rounds)["edges"]


def solution_cost(nodes: DataFrame, edges: DataFrame, config: str | dict = "gt", allow_divisions: bool = True) -> DataFrame:
    """Per movie: nodes, edges, appearing, ending and splitting nodes, nodes with too many parents or children, and the cost."""
    k = _costs(config)
    most = 2 if allow_divisions else 1
    into = edges.groupBy("movie", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    out = edges.groupBy("movie", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    degree = nodes.select("movie", F.struct("t", "label").alias("node")).distinct().join(into.hint("merge"), ["movie", "node"], "left").join(out.hint("merge"), ["movie", "node"], "left").na.fill(0, ["n_in", "n_out"])
    count = lambda c: F.sum(c.cast("long"))
    per = degree.groupBy("movie").agg(
        F.count(F.lit(1)).alias("n_nodes"), count(F.col("n_in") == 0).alias("n_appear"), count(F.col("n_out") == 0).alias("n_disappear"), count(F.col("n_out") > 1).alias("n_split"),
        count((F.col("n_in") > 1) | (F.col("n_out") > most)).alias("n_violations"),
    )
    sums = edges.groupBy("movie").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("total"))
    both = per.join(sums, "movie", "left").na.fill(0, ["n_edges"]).na.fill(0.0, ["total"])
    split = k["splitC"] * F.col("n_split") if allow_divisions else F.lit(0.0)
    cost = F.col("n_nodes") * (k["nodeW"] + k["nodeC"]) + F.col("total") * k["edgeW"] + F.col("n_edges") * k["edgeC"] + F.col("n_appear") * k["appearC"] + F.col("n_disappear") * k["disappearC"] + split
    return both.select("movie", "n_nodes", "n_edges", "n_appear", "n_disappear", "n_split", "n_violations", cost.alias("cost"))
