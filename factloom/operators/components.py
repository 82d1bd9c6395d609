"""Strongly connected components and reachability without a limit of depth, with state linear in nodes.

Long paths are not walked step by step. Nodes that one edge enters and one leaves are contracted by pointer doubling, so that a chain or
a ring of n nodes takes log2 n turns; nodes without edges in or out are trimmed. What is left is told apart by the least node (by hash)
that reaches each node and the least that it reaches: where the two are the same, it is the node's component. Every
turn is a few equi joins and a written table; only rows that changed are joined in the next turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import Turns, cut

TRIMS = 3  # turns of trimming before the next step; what they leave, later turns take


def _ends(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out, prev, next): degrees over distinct edges, and one neighbour on each side."""
    sides = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(None).cast(edges.schema["src"].dataType).alias("prev"), F.col("dst").alias("next")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("prev"), F.lit(None).cast(edges.schema["src"].dataType).alias("next")),
    )).alias("x")).select("x.*")
    return sides.groupBy("node").agg(F.count("prev").alias("n_in"), F.count("next").alias("n_out"), F.min("prev").alias("prev"), F.min("next").alias("next"))


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are both among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def _chains(ends: DataFrame) -> DataFrame:
    """(node, prev, next, low, open): of nodes with one edge in and one out, the nearest other nodes before and after, by doubling; on a ring of such
    nodes alone there are none (``open`` is false), and ``low`` is the ring's least node."""
    chain = ends.where("n_in = 1 AND n_out = 1")
    turns = Turns(ends.sparkSession)
    state = turns.put(chain.select("node", "prev", "next", F.col("node").alias("low")))
    members = state.select("node")
    inside = lambda side: members.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_in"))
    state = turns.put(state.join(inside("prev"), "prev", "left").join(inside("next"), "next", "left").select("node", "prev", "next", "low", F.coalesce("prev_in", F.lit(False)).alias("p"), F.coalesce("next_in", F.lit(False)).alias("n")))
    while True:
        back = state.select(F.col("node").alias("prev"), F.col("prev").alias("prev2"), F.col("low").alias("low2"), F.col("p").alias("p2"))
        on = state.select(F.col("node").alias("next"), F.col("next").alias("next2"), F.col("n").alias("n2"))
        step = state.join(back, "prev", "left").join(on, "next", "left").select(
            "node", F.when(F.col("p"), F.col("prev2")).otherwise(F.col("prev")).alias("prev"), F.when(F.col("n"), F.col("next2")).otherwise(F.col("next")).alias("next"),
            F.least("low", F.when(F.col("p"), F.col("low2"))).alias("low"), (F.col("p") & F.coalesce("p2", F.lit(False))).alias("p"), (F.col("n") & F.coalesce("n2", F.lit(False))).alias("n"),
            ((F.col("p") & ~F.coalesce("p2", F.lit(False))) | (F.col("n") & ~F.coalesce("n2", F.lit(False))) | (F.col("p") & (F.col("low2") < F.col("low")))).alias("moved"),
        )
        state = turns.put(step)
        if state.where("moved").isEmpty():
            return state.select("node", "prev", "next", "low", (~F.col("p")).alias("open"))


def _spread(edges: DataFrame) -> DataFrame:
    """(node, f, b): the least node, by hash and then by value, among those that reach each node (itself included), and among those that it reaches."""
    mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    turns = Turns(edges.sparkSession)
    state = turns.put(nodes.select("node", mark("node").alias("f"), mark("node").alias("b"), F.lit(True).alias("f_moved"), F.lit(True).alias("b_moved")))
    while True:
        forward = edges.join(state.where("f_moved").select(F.col("node").alias("src"), "f"), "src").select(F.col("dst").alias("node"), F.col("f").alias("f2"), F.lit(None).cast(state.schema["b"].dataType).alias("b2"))
        backward = edges.join(state.where("b_moved").select(F.col("node").alias("dst"), "b"), "dst").select(F.col("src").alias("node"), F.lit(None).cast(state.schema["f"].dataType).alias("f2"), F.col("b").alias("b2"))
        told = forward.unionByName(backward).groupBy("node").agg(F.min("f2").alias("f2"), F.min("b2").alias("b2"))
        state = turns.put(state.join(told, "node", "left").select(
            "node", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), F.coalesce(F.col("f2") < F.col("f"), F.lit(False)).alias("f_moved"), F.coalesce(F.col("b2") < F.col("b"), F.lit(False)).alias("b_moved"),
        ))
        if state.where("f_moved OR b_moved").isEmpty():
            return state.select("node", "f", "b")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of the edges (src, dst) with the least node of its strongly connected component. Edges with a null end don't count; of no edges there are no nodes."""
    every = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    live, found, chains = every.where("src <> dst"), [], []
    while not live.isEmpty():
        for _ in range(TRIMS):
            ends = cut(_ends(live))
            if ends.where("n_in = 0 OR n_out = 0").isEmpty():
                break
            live = cut(_between(live, ends.where("n_in > 0 AND n_out > 0")))
            ends = None
        ends = cut(_ends(live)) if ends is None else ends
        if not ends.where("n_in = 1 AND n_out = 1").isEmpty():
            chain = _chains(ends)
            chains.append((len(found), chain))
            over = chain.where("open AND prev <> next").select(F.col("prev").alias("src"), F.col("next").alias("dst"))
            live = cut(_between(live, ends.where("n_in <> 1 OR n_out <> 1").select("node")).union(over).distinct())
            if live.isEmpty():
                break
        marks = _spread(live)
        settled = cut(marks.where("f = b").select("node", F.col("f.v").alias("component")))
        found.append(settled)
        rest = marks.where("f <> b")
        a = rest.select(F.col("node").alias("src"), F.struct("f", "b").alias("of_src"))
        b = rest.select(F.col("node").alias("dst"), F.struct("f", "b").alias("of_dst"))
        live = cut(live.join(a, "src").join(b, "dst").where("of_src = of_dst").select("src", "dst"))
    labels = None
    for part in found:
        labels = part if labels is None else labels.unionByName(part)
    kind = every.schema["src"].dataType
    if labels is None:
        labels = every.select(F.col("src").alias("node"), F.lit(None).cast(kind).alias("component")).limit(0)
    for _, chain in reversed(chains):
        side = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))  # noqa: B023, E731
        joined = chain.join(side("prev"), "prev", "left").join(side("next"), "next", "left")
        before, after = F.coalesce("of_prev", "prev"), F.coalesce("of_next", "next")
        ours = joined.select("node", F.when(~F.col("open"), F.col("low")).when(before == after, before).otherwise(F.col("node")).alias("component"))
        labels = cut(labels.unionByName(ours))
    nodes = every.select(F.col("src").alias("node")).union(every.select("dst")).distinct()
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("of"))
    least = labelled.groupBy("of").agg(F.min("node").alias("component"))
    return labelled.join(least, "of").select("node", "component")


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, by whatever number of steps: components of two nodes or more, and edges to oneself."""
    c = strong_components(edges)
    shared = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    return c.join(shared, "component", "left_semi").select("node").union(loops).distinct()


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that the roots (column node) reach, themselves included. Nodes that a single other node enters are reached just when that one
    is: they follow it by doubling, and the search itself turns over the others only, so that long chains don't lengthen it."""
    every = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    start = cut(roots.select("node").where("node IS NOT NULL").distinct())
    single = every.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up")).where("n = 1").select("node", "up").join(start, "node", "left_anti")
    turns = Turns(edges.sparkSession)
    state = turns.put(single)
    members = state.select(F.col("node").alias("up"), F.lit(True).alias("in"))
    state = turns.put(state.join(members, "up", "left").select("node", "up", F.coalesce("in", F.lit(False)).alias("in")))
    while not state.where("in").isEmpty():
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("in").alias("in2"))
        state = turns.put(state.join(above, "up", "left").select("node", F.when(F.col("in"), F.col("up2")).otherwise(F.col("up")).alias("up"), (F.col("in") & F.coalesce("in2", F.lit(False))).alias("in"), (F.col("in") & ~F.coalesce("in2", F.lit(False))).alias("moved")))
        if state.where("moved").isEmpty():  # the rest hangs on rings that nothing enters
            break
    follow = state.where("NOT in").select("node", "up")
    lost = state.where("in").select("node")
    short = every.join(state.select(F.col("node").alias("dst")), "dst", "left_anti").join(lost.withColumnRenamed("node", "src"), "src", "left_anti").join(follow.withColumnRenamed("node", "src"), "src", "left")
    short = cut(short.select(F.coalesce("up", "src").alias("src"), "dst").where("src <> dst").distinct())
    seen, front, turn = start, start, 0
    while True:
        turn += 1
        new = cut(short.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if new.isEmpty():
            break
        seen, front = seen.union(new), new
        if turn % 8 == 0:  # a union of written parts; made one before the plan grows long
            seen = cut(seen)
    return seen.union(follow.join(seen.withColumnRenamed("node", "up"), "up", "left_semi").select("node"))
