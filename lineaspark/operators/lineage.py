"""Tracklets, lineages and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import fixpoint, materialize
from ..functions.numbering import numbered


def _solution_nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    ends = edges.select("movie", F.col("src").alias("node")).unionByName(edges.select("movie", F.col("dst").alias("node")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select("movie", F.struct("t", "label").alias("node")))
    return ends.distinct()


def node_tracklets(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(movie, node, head, parent): the first node of each node's tracklet and the node that the tracklet descends from.

    A tracklet begins where a node has no parent, is one of two children, or follows its parent after a gap.
    ``nodes`` adds nodes without edges.  Pointers to the node before are doubled until all reach a head, in
    rounds logarithmic in the longest tracklet.  Tables of nodes are far smaller as files than in memory, so no join here or below may send
    one through the driver.
    """
    out = edges.groupBy("movie", "src").agg(F.count(F.lit(1)).alias("n_out"))
    wrong = F.assert_true(F.col("n_out") <= 2, F.lit("more than two children"))
    back = edges.join(out.hint("merge"), ["movie", "src"]).where(wrong.isNull()).select("movie", F.col("dst").alias("node"), F.col("src").alias("parent"), ((F.col("n_out") == 2) | (F.col("dst.t") - F.col("src.t") > 1)).alias("starts"))
    first = _solution_nodes(edges, nodes).join(back.hint("merge"), ["movie", "node"], "left")
    first = materialize(first.withColumn("starts", F.coalesce("starts", F.lit(True))))
    start = first.select("movie", "node", F.when(F.col("starts"), F.col("node")).otherwise(F.col("parent")).alias("ptr"), F.lit(True).alias("moved"))

    def step(now: DataFrame) -> DataFrame:
        far = now.select("movie", F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        return now.drop("moved").join(far.hint("merge"), ["movie", "ptr"]).select("movie", "node", F.col("far").alias("ptr"), (F.col("far") != F.col("ptr")).alias("moved"))

    heads = fixpoint(start, step, lambda now: now.where("moved")).select("movie", "node", F.col("ptr").alias("head"))
    parents = first.where("starts").select("movie", F.col("node").alias("head"), "parent")
    return heads.join(parents.hint("merge"), ["movie", "head"]).select("movie", "node", "head", "parent")


def tracklet_labels(members: DataFrame) -> DataFrame:
    """(movie, head, label, t1, t2, parent node): tracklets numbered by first frame, parent node (none first) and head."""
    spans = members.groupBy("movie", "head").agg(F.min("node.t").alias("t1"), F.max("node.t").alias("t2"), F.first("parent").alias("parent"))
    return numbered(spans, ["movie"], ["t1", F.col("parent").asc_nulls_first(), "head"], "label")


def tracklet_table(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The table (movie, label, t1, t2, parent) and the label of every node (movie, t, node label, tracklet)."""
    members = node_tracklets(edges, nodes)
    labels = materialize(tracklet_labels(members))
    of_node = members.join(labels.select("movie", "head", F.col("label").alias("tracklet")).hint("merge"), ["movie", "head"])
    parent = of_node.select("movie", F.col("node").alias("parent"), F.col("tracklet").alias("parent_label"))
    table = labels.join(parent.hint("merge"), ["movie", "parent"], "left").select("movie", "label", "t1", "t2", F.coalesce("parent_label", F.lit(0)).alias("parent"))
    return table, of_node.select("movie", F.col("node.t").alias("t"), F.col("node.label").alias("label"), "tracklet")


def linear_chains(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(movie, chain, node): runs of nodes, numbered by their first two nodes; a branching node is in every chain it touches.

    A chain starts at a node with more edges out than in, once for each child, and runs on while there is one
    successor; gaps do not break it.  Roots without exactly one child are chains of their own.
    """
    degree = _solution_nodes(edges, nodes).join(edges.groupBy("movie", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out")).hint("merge"), ["movie", "node"], "left")
    degree = degree.join(edges.groupBy("movie", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in")).hint("merge"), ["movie", "node"], "left").na.fill(0, ["n_out", "n_in"])
    into = edges.join(degree.select("movie", F.col("node").alias("src"), "n_out", "n_in").hint("merge"), ["movie", "src"])
    links = materialize(into.select("movie", F.col("dst").alias("node"), "src", (F.col("n_out") > F.col("n_in")).alias("starts")))
    start = links.select("movie", "node", F.when(F.col("starts"), F.col("node")).otherwise(F.col("src")).alias("ptr"), F.lit(True).alias("moved"))

    def step(now: DataFrame) -> DataFrame:
        far = now.select("movie", F.col("node").alias("ptr"), F.col("ptr").alias("far"))
        return now.drop("moved").join(far.hint("merge"), ["movie", "ptr"]).select("movie", "node", F.col("far").alias("ptr"), (F.col("far") != F.col("ptr")).alias("moved"))

    run = fixpoint(start, step, lambda now: now.where("moved")).select("movie", "node", F.col("ptr").alias("second"))
    first = links.where("starts").select("movie", F.col("node").alias("second"), F.col("src").alias("first"))
    rows = run.join(first.hint("merge"), ["movie", "second"])
    chains = rows.select("movie", "first", "second", "node").unionByName(rows.select("movie", "first", "second", F.col("first").alias("node")).distinct())
    alone = degree.where("n_in = 0 and n_out <> 1").select("movie", F.col("node").alias("first"), F.lit(None).cast("struct<t:int,label:int>").alias("second"), "node")
    every = materialize(chains.unionByName(alone))
    names = numbered(every.select("movie", "first", "second").distinct(), ["movie"], ["first", F.col("second").asc_nulls_first()], "chain")
    names = names.select(F.col("movie").alias("m"), F.col("first").alias("f"), F.col("second").alias("s"), "chain")
    return every.join(names.hint("merge"), (F.col("movie") == F.col("m")) & (F.col("first") == F.col("f")) & F.col("second").eqNullSafe(F.col("s"))).select("movie", "chain", "node")


def to_tracks(edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("cz", "cy", "cx")) -> tuple[DataFrame, DataFrame]:
    """Track points (movie, track_id, t, columns) and track parents (movie, track_id, parent_id).

    A chain of several nodes that starts where another ends is that one's child and loses its first node.
    """
    chains = materialize(linear_chains(edges, nodes))
    ends = chains.groupBy("movie", "chain").agg(F.min("node").alias("head"), F.max("node").alias("tail"), F.count(F.lit(1)).alias("n"))
    parents = ends.where("n > 1").select("movie", "chain", "head").join(ends.select("movie", F.col("chain").alias("parent_id"), F.col("tail").alias("head")).hint("merge"), ["movie", "head"]).where("parent_id <> chain")
    parents = parents.select("movie", F.col("chain").alias("track_id"), "parent_id", "head")
    points = chains.join(parents.select("movie", F.col("track_id").alias("chain"), F.col("head").alias("node")).distinct().hint("merge"), ["movie", "chain", "node"], "left_anti")
    points = points.select("movie", F.col("chain").alias("track_id"), F.col("node.t").alias("t"), F.col("node.label").alias("label"))
    return points.join(nodes.select("movie", "t", "label", *columns).hint("merge"), ["movie", "t", "label"]).select("movie", "track_id", "t", *columns), parents.select("movie", "track_id", "parent_id")


def labels_to_tracks(detections: DataFrame, tracklets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Track points straight from labels, and parents where the table names one."""
    return detections.select("movie", F.col("label").alias("track_id"), "t", "cz", "cy", "cx"), tracklets.where("parent <> 0").select("movie", F.col("label").alias("track_id"), F.col("parent").alias("parent_id"))


def tracklet_graph(tracklets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A node for each tracklet (t its first frame) and an edge from each parent."""
    return tracklets.select("movie", "label", F.col("t1").alias("t")), tracklets.where("parent <> 0").select("movie", F.col("parent").alias("src"), F.col("label").alias("dst"))


def lineage_closure(tracklets: DataFrame) -> DataFrame:
    """(movie, anc, desc, depth) for every tracklet and each of its ancestors, depth 1 being the parent.

    Known paths are joined with themselves, so that depths double with every round.
    """
    pairs = tracklets.where("parent <> 0").select("movie", F.col("parent").alias("anc"), F.col("label").alias("desc"), F.lit(1).alias("depth")).distinct()
    start = pairs.withColumn("reach", F.lit(1)).withColumn("grown", F.lit(True))

    def step(now: DataFrame) -> DataFrame:
        # All paths up to ``reach`` are known; those of exactly that length lead on to paths up to twice as long.
        full = now.where("depth = reach").select("movie", "anc", F.col("desc").alias("mid"), F.col("depth").alias("d1"), "reach")
        tail = now.select("movie", F.col("anc").alias("mid"), "desc", F.col("depth").alias("d2"))
        new = full.join(tail, ["movie", "mid"]).select("movie", "anc", "desc", (F.col("d1") + F.col("d2")).alias("depth"), (F.col("reach") * 2).alias("reach"), F.lit(True).alias("grown"))
        old = now.select("movie", "anc", "desc", "depth", (F.col("reach") * 2).alias("reach"), F.lit(False).alias("grown"))
        return old.unionByName(new.where("anc <> desc"))

    return fixpoint(start, step, lambda now: now.where("grown"), most=40).select("movie", "anc", "desc", "depth")


def lineage_intervals(tracklets: DataFrame) -> DataFrame:
    """(movie, label, root, first, last): places in a walk through each lineage; b descends from a where a.first <= b.first <= a.last.

    A tracklet is counted where the walk enters it, children in the order of their labels; ``last`` is the place of the last
    one entered before the walk leaves it.  The walk is a list of entries and exits, an entry weighing one: each
    step's pointer and weight to the end of its list are doubled in rounds logarithmic in the lineage, in which steps that have
    arrived take no part.  One row for each tracklet comes out.  A parent without a row of its own counts as none.
    Tables of tracklets are far smaller as files than in memory, so no join may send one through the driver.
    Tables of roots may be sent, since a root may have all tracklets, which one task should not get.
    """
    rows = tracklets.select("movie", F.col("label").cast("long").alias("label"), F.col("parent").cast("long").alias("parent")).groupBy("movie", "label").agg(F.min("parent").alias("parent"))
    known = rows.select("movie", F.col("label").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known.hint("merge"), ["movie", "parent"], "left").select("movie", "label", F.when(F.col("known") & (F.col("parent") != 0), F.col("parent")).alias("parent"))
    rows = materialize(rows)
    children = rows.where("parent is not null").withColumn("next", F.lead("label").over(Window.partitionBy("movie", "parent").orderBy("label")))
    eldest = children.groupBy("movie", F.col("parent").alias("label")).agg(F.min("label").alias("child"))
    # An entry leads to the first child's entry or to the own exit, an exit to the next sibling's entry or to the parent's exit.
    entry = rows.join(eldest.hint("merge"), ["movie", "label"], "left").select("movie", (2 * F.col("label")).alias("e"), F.coalesce(2 * F.col("child"), 2 * F.col("label") + 1).alias("to"), F.lit(1).cast("long").alias("w"))
    leave = rows.select("movie", "label").join(children.select("movie", "label", "parent", "next").hint("merge"), ["movie", "label"], "left").select("movie", (2 * F.col("label") + 1).alias("e"), F.coalesce(2 * F.col("next"), 2 * F.col("parent") + 1).alias("to"), F.lit(0).cast("long").alias("w"))
    # The end of a list is the exit of its root; a step holds the weights from itself up to, not including, the one it points to.
    start = entry.unionByName(leave).select("movie", "e", F.coalesce("to", "e").alias("to"), "w", F.col("to").isNull().alias("done"))

    def step(now: DataFrame) -> DataFrame:
        far = now.select("movie", F.col("e").alias("to"), F.col("to").alias("far"), F.col("w").alias("more"), F.col("done").alias("end"))
        moved = now.where("not done").join(far.hint("merge"), ["movie", "to"])
        # Pointing at the end itself is arriving; the end weighs nothing.
        new = moved.select("movie", "e", F.col("far").alias("to"), (F.col("w") + F.col("more")).alias("w"), F.col("end").alias("done"))
        return now.where("done").unionByName(new)

    ranked = fixpoint(start, step, lambda now: now.where("not done"), most=64)
    at = ranked.groupBy("movie", F.floor(F.col("e") / 2).cast("long").alias("label")).agg(
        F.floor(F.max("to") / 2).cast("long").alias("root"), F.max(F.when(F.col("e") % 2 == 0, F.col("w"))).alias("from_entry"), F.max(F.when(F.col("e") % 2 == 1, F.col("w"))).alias("from_exit")
    )
    whole = at.where("label = root").select("movie", "root", F.col("from_entry").alias("n"))
    return at.join(whole, ["movie", "root"]).select("movie", "label", "root", (F.col("n") - F.col("from_entry")).alias("first"), (F.col("n") - F.col("from_exit") - 1).alias("last"))


def lineage_edges(tracklets: DataFrame, present: DataFrame) -> DataFrame:
    """(movie, t, label, parent): tracklets seen in each of their frames, with the parent where it has been seen by then.

    The parent is 0 where there is none or where no frame up to t shows it.
    """
    frames = tracklets.where("t1 <= t2").select("movie", "label", "parent", F.explode(F.sequence("t1", "t2")).alias("t"))
    seen = frames.join(present.where("label <> 0").select("movie", "t", "label").distinct(), ["movie", "t", "label"])
    first = seen.groupBy("movie", F.col("label").alias("parent")).agg(F.min("t").alias("first"))
    return seen.join(first, ["movie", "parent"], "left").select("movie", "t", "label", F.when((F.col("parent") != 0) & (F.col("first") <= F.col("t")), F.col("parent")).otherwise(0).alias("parent"))


def associations(windows: DataFrame, matching: DataFrame, closure: DataFrame) -> DataFrame:
    """Associated pairs (movie, t1, t_i, l_i, t_j, l_j) inside each window.

    ``matching`` (movie, t, label, truth) names the ground-truth tracklet of matched detections.  Two are
    associated if their tracklets are the same or one descends from the other.  ``closure`` is what :func:`lineage_intervals`
    makes of the tracklets, or the pairs of :func:`lineage_closure`.
    """
    known = windows.select("movie", "t1", "t", "label").join(matching.hint("merge"), ["movie", "t", "label"])
    if "first" in closure.columns:
        return _within(known, closure)
    same = matching.select("movie", F.col("truth").alias("a"), F.col("truth").alias("b")).distinct()
    down = closure.select("movie", F.col("anc").alias("a"), F.col("desc").alias("b"))
    related = same.unionByName(down).unionByName(down.select("movie", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    i = known.select("movie", "t1", F.col("t").alias("t_i"), F.col("label").alias("l_i"), F.col("truth").alias("a"))
    j = known.select("movie", "t1", F.col("t").alias("t_j"), F.col("label").alias("l_j"), F.col("truth").alias("b"))
    return i.join(related, ["movie", "a"]).join(j, ["movie", "t1", "b"]).select("movie", "t1", "t_i", "l_i", "t_j", "l_j")


def _within(known: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pairs of ``known`` in one window of which one's place lies in the other's interval.

    An interval is cut into dyadic segments, two at most for each length, and a place lies in one segment of each
    length; so a pair that belongs together meets once, in the one segment both name, and others never do.
    """
    intervals = intervals.select("movie", F.col("label").cast("long").alias("truth"), "root", "first", "last")
    bits = intervals.groupBy("movie", "root").agg((F.floor(F.log2(F.max("last") + 1.0)) + 1).cast("int").alias("bits"))
    rows = known.withColumn("truth", F.col("truth").cast("long")).join(intervals.join(bits, ["movie", "root"]).hint("merge"), ["movie", "truth"])
    level = F.explode(F.sequence(F.lit(0), F.col("bits"))).alias("level")
    size = F.pow(F.lit(2.0), F.col("level"))
    down = rows.select("movie", "t1", F.col("t").alias("t_j"), F.col("label").alias("l_j"), F.col("truth").alias("b"), "root", "first", level)
    down = down.withColumn("segment", F.floor(F.col("first") / size).cast("long")).drop("first")
    up = rows.select("movie", "t1", F.col("t").alias("t_i"), F.col("label").alias("l_i"), F.col("truth").alias("a"), "root", "first", "last", level)
    low, high = F.ceil(F.col("first") / size).cast("long"), F.floor((F.col("last") + 1) / size).cast("long")
    wide_low, wide_high = F.ceil(F.col("first") / (2 * size)).cast("long"), F.floor((F.col("last") + 1) / (2 * size)).cast("long")
    up = up.withColumn("low", low).withColumn("high", high).withColumn("wl", 2 * wide_low).withColumn("wh", 2 * wide_high)
    up = up.where("low < high").withColumn("segment", F.explode(F.array_distinct(F.array(F.col("low"), F.col("high") - 1)))).where("segment < wl or segment >= wh")
    met = up.select("movie", "t1", "t_i", "l_i", "a", "root", "level", "segment").join(down.hint("merge"), ["movie", "t1", "root", "level", "segment"])
    pairs = met.select("movie", "t1", "t_i", "l_i", "t_j", "l_j", (F.col("a") == F.col("b")).alias("same"))
    back = pairs.where("not same").select("movie", "t1", F.col("t_j").alias("t_i"), F.col("l_j").alias("l_i"), F.col("t_i").alias("t_j"), F.col("l_i").alias("l_j"))
    return pairs.drop("same").unionByName(back)


def identity_matching(detections: DataFrame) -> DataFrame:
    """Detections that are ground truth themselves."""
    return detections.select("movie", "t", "label", F.col("label").alias("truth"))


def _solution_missing(pixels: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("movie", "t", "label").distinct().join(pixels.select("movie", "t", "label").distinct().hint("merge"), ["movie", "t", "label"], "left_anti")


def apply_solution(pixels: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Pixels of the detections in ``nodes``; with ``strict`` nodes without pixels are an error."""
    if strict and _solution_missing(pixels, nodes).limit(1).count():
        raise ValueError("the solution has detections without pixels")
    return pixels.join(nodes.select("movie", "t", "label").distinct().hint("merge"), ["movie", "t", "label"], "left_semi").select(pixels.columns)


def relabel_by_tracklet(pixels: DataFrame, node_labels: DataFrame, strict: bool = True) -> DataFrame:
    """Pixels of labelled nodes (movie, t, label, tracklet) with the tracklet as label; other pixels are left out."""
    if strict and _solution_missing(pixels, node_labels).limit(1).count():
        raise ValueError("the solution has detections without pixels")
    return pixels.join(node_labels.select("movie", "t", "label", "tracklet").hint("merge"), ["movie", "t", "label"]).withColumn("label", F.col("tracklet")).select(pixels.columns)
