"""Graphs as tables of edges (a, b), undirected unless said otherwise. Every step is a join; a long loop cuts its plan."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.operators.running import checkpointed


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in either direction, once, without loops and unknown ends."""
    e = edges.select("a", "b").where("a <> b")
    return e.union(e.select("b", "a")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree), the number of different neighbours."""
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))


def distances(edges: DataFrame, sources: DataFrame, few: int = 10_000) -> DataFrame:
    """(node, dist): the least number of edges from any of the sources (node); nodes out of reach are left out.

    What lies next to a round's nodes is of that round, the one before or the next, so a round is held against two others only,
    and none is written twice. Rounds of up to `few` nodes are one job each, by broadcast, and are kept here until they
    make a table.
    """
    e = checkpointed(both_ways(edges))
    spark, kind = e.sparkSession, sources.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("dist", T.IntegerType())])
    table = lambda nodes: spark.createDataFrame([(n,) for n in nodes], T.StructType(schema.fields[:1]))
    seen, held, done = sources.select("node").where("node is not null").distinct(), [], []

    def settled(found: DataFrame) -> set | DataFrame:
        """The nodes themselves if they are few, else a written table of them."""
        some = found.limit(few + 1).collect()
        return {r["node"] for r in some} if len(some) <= few else checkpointed(found)

    last, before = settled(seen), set()
    for k in count():
        if isinstance(last, set):
            held += [(n, k) for n in last]
            if len(held) > 10 * few or not last:
                done.append(checkpointed(spark.createDataFrame(held, schema)))
                held = []
            if not last:
                break
            some = e.join(F.broadcast(table(last).withColumnRenamed("node", "a")), "a").select(F.col("b").alias("node")).distinct()
        else:
            done.append(last.withColumn("dist", F.lit(k)))
            some = e.join(last.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        if isinstance(last, set) and isinstance(before, set):
            # At most 3 * few nodes: those of two small rounds go here.
            rows = some.limit(3 * few + 1).collect()
            if len(rows) <= 3 * few:
                fresh = {r["node"] for r in rows} - last - before
                last, before = fresh if len(fresh) <= few else checkpointed(table(fresh)), last
                continue
        for known in (last, before):
            if not isinstance(known, set) or known:
                some = some.join(F.broadcast(table(known)) if isinstance(known, set) else known, "node", "left_anti")
        some = checkpointed(some)
        last, before = settled(some), last
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, cost, via) over directed edges (a, b, w): the least cost from any of the sources, and the node before on a
    cheapest way (the smallest of several; null for a source). Weights may be negative; a cycle that gets cheaper each time
    round is an error. Only nodes that got cheaper are followed further, for at most as many rounds as there are nodes.
    """
    e = checkpointed(edges.select("a", "b", F.col("w").cast("double").alias("w")).na.drop().groupBy("a", "b").agg(F.min("w").alias("w")))
    n = e.select(F.col("a").alias("node")).union(e.select("b")).union(sources.select("node")).distinct().count()
    kind = dict(e.dtypes)["a"]
    best = checkpointed(sources.select("node").distinct().withColumns({"cost": F.lit(0.0), "via": F.lit(None).cast(kind)}))
    moved = best
    for _ in range(n + 1):
        ways = e.join(moved, e["a"] == moved["node"]).groupBy(F.col("b").alias("node")).agg(F.min(F.struct((F.col("cost") + F.col("w")).alias("cost"), F.col("a").alias("via"))).alias("s")).select("node", "s.*")
        moved = checkpointed(ways.join(best.select("node", F.col("cost").alias("was")), "node", "left").where("was is null or cost < was").select("node", "cost", "via"))
        if moved.isEmpty():
            return best
        better = F.min(F.struct("cost", "via")).alias("s")
        best = checkpointed(best.union(moved).groupBy("node").agg(better).select("node", "s.*"))
    raise ValueError("a cycle of negative weight can be reached")


def path_to(paths: DataFrame, node) -> list:
    """The nodes of the way that `shortest_paths` found to one node, from its source on; empty if it can't be reached. A step
    is one lookup, so this is for single nodes."""
    way, at = [], node
    while at is not None:
        row = paths.where(F.col("node") == at).select("via").first()
        if row is None:
            return []
        way.append(at)
        at = row["via"]
    return way[::-1]


def _reach(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, color): the greatest label (node, color) that reaches each node along the edges, its own included."""
    color = checkpointed(labels)
    while True:
        sent = edges.join(color, edges["a"] == color["node"]).groupBy(F.col("b").alias("node")).agg(F.max("color").alias("got"))
        after = checkpointed(color.join(sent, "node", "left").select("node", F.greatest("color", "got").alias("color"), (F.col("got") > F.col("color")).alias("up")))
        color = after.select("node", "color")
        if after.where("up").isEmpty():
            return color


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) over directed edges: nodes that reach each other, named by their smallest node.

    By colours: every node takes the greatest node that reaches it. Nodes of a colour that in turn reach their colour's
    node, within the colour, are a component; they go, and the rest are coloured anew. Nodes without a way in or out
    are components of one and go first.
    """
    left = checkpointed(edges.select("a", "b").na.drop().distinct())
    nodes = checkpointed(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
    left = checkpointed(left.where("a <> b"))
    done = []
    while not nodes.isEmpty():
        inner = left.select(F.col("a").alias("node")).intersect(left.select(F.col("b").alias("node")))
        single = checkpointed(nodes.join(inner, "node", "left_anti"))
        if not single.isEmpty():
            done.append(single.select("node", F.col("node").alias("component")))
            nodes, gone = checkpointed(nodes.join(single, "node", "left_anti")), single
        else:
            color = _reach(left, nodes.withColumn("color", F.col("node")))
            ends = left.join(color.select(F.col("node").alias("a"), F.col("color").alias("ca")), "a").join(color.select(F.col("node").alias("b"), F.col("color").alias("cb")), "b")
            back = checkpointed(ends.where("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("c")))
            found = checkpointed(color.where("node = color"))
            edge = found
            while True:
                met = back.join(edge.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"), F.col("c").alias("color")).distinct()
                edge = checkpointed(met.join(found, "node", "left_anti"))
                if edge.isEmpty():
                    break
                found = checkpointed(found.union(edge))
            names = found.groupBy("color").agg(F.min("node").alias("component"))
            done.append(checkpointed(found.join(names, "color").select("node", "component")))
            nodes, gone = checkpointed(nodes.join(found, "node", "left_anti")), found
        left = checkpointed(left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti"))
    out = edges.sparkSession.createDataFrame([], nodes.schema).select("node", F.col("node").alias("component"))
    for d in done:
        out = out.union(d)
    return out


def triangles(edges: DataFrame) -> DataFrame:
    """(n): the number of triangles. Edges point to the end with more neighbours, so that no node has many ahead."""
    e, d = both_ways(edges), degrees(edges)
    key = lambda side: F.struct(F.col(f"d{side}"), F.col(side))
    known = e.join(d.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
    ahead = checkpointed(known.where(key("a") < key("b")).select("a", "b", "da", "db"))
    x = ahead.select("a", F.col("b").alias("x"), F.col("db").alias("dx"))
    y = ahead.select("a", F.col("b").alias("y"), F.col("db").alias("dy"))
    wedges = x.join(y, "a").where(F.struct("dx", "x") < F.struct("dy", "y"))
    return wedges.join(ahead.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").agg(F.count("*").alias("n"))


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) over directed edges; ranks add up to 1. What nodes without a way out hold is spread evenly."""
    e = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    out = e.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("out"))
    n = nodes.count()
    rank = checkpointed(nodes.join(out, "node", "left").withColumn("rank", F.lit(1.0 / n if n else 0.0)))
    for _ in range(rounds if n else 0):
        sent = e.join(rank, e["a"] == rank["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        stuck = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("stuck"))
        to = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("stuck") / n)
        rank = checkpointed(rank.drop("rank").join(sent, "node", "left").join(F.broadcast(stuck)).select("node", "out", to.alias("rank")))
    return rank.select("node", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of the edges, the smallest node that it reaches.

    Large-star and small-star steps in turn: each round ties every node's larger neighbours to the smallest node next
    to it, then its smaller ones, until nothing changes. Rounds grow with the logarithm of the longest path. A node
    with many neighbours is aggregated before the shuffle; nothing gathers a component in one place.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        else:
            both = e.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
        lowest = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        tied = both.join(lowest, "n")
        if large:
            tied = tied.where("m > n").select(F.col("m").alias("a"), F.col("low").alias("b"))
        else:
            tied = tied.select(F.col("m").alias("a"), F.col("low").alias("b")).union(lowest.select(F.col("n").alias("a"), F.col("low").alias("b")))
        return tied.where("a <> b").distinct()

    e = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    was = None
    while True:
        e = checkpointed(star(star(e, True), False))
        if (now := tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())) == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
        was = now


def cycles(edges: DataFrame) -> DataFrame:
    """(nodes, edges, components, cycles) of the graph; cycles counts the edges beyond a spanning forest."""
    e = checkpointed(both_ways(edges).where("a < b"))
    c = connected_components(e).agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    return c.join(F.broadcast(e.agg(F.count("*").alias("edges")))).select("nodes", "edges", "components", (F.col("edges") - F.col("nodes") + F.col("components")).alias("cycles"))


def bipartite(edges: DataFrame) -> DataFrame:
    """(component, bipartite) of whole-number nodes: a component is not if a node meets itself in the graph's double cover."""
    e = checkpointed(both_ways(edges).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a < b"))
    side = lambda c, s: (2 * F.col(c) + s)
    cover = e.select(side("a", 0).alias("a"), side("b", 1).alias("b")).union(e.select(side("a", 1).alias("a"), side("b", 0).alias("b")))
    found = connected_components(cover).select(F.floor(F.col("node") / 2).alias("node"), F.col("component").alias("part"))
    apart = found.groupBy("node").agg((F.min("part") != F.max("part")).alias("apart"))
    return connected_components(e).join(apart, "node").groupBy("component").agg(F.every("apart").alias("bipartite"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the lightest edges that keep all nodes connected; ties go to smaller ends.

    By Boruvka's rounds: each component takes its lightest edge out, then components that met become one; their
    number at least halves each round, and edges inside a component are dropped.
    """
    some = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("double").alias("w")).na.drop().where("a <> b")
    left = checkpointed(some.groupBy("a", "b").agg(F.min("w").alias("w")).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    taken = []
    while not left.isEmpty():
        edge = F.struct("w", "a", "b", "ca", "cb")
        ways = left.select(F.col("ca").alias("c"), edge.alias("e")).union(left.select(F.col("cb").alias("c"), edge.alias("e")))
        best = checkpointed(ways.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        taken.append(best.select("a", "b", "w"))
        merged = checkpointed(connected_components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        for c in ("ca", "cb"):
            left = left.join(merged.select(F.col("node").alias(c), F.col("component").alias("__c")), c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
        left = checkpointed(left.where("ca <> cb"))
    out = left.select("a", "b", "w")
    for t in taken:
        out = out.union(t)
    return out


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) over directed edges: 0 without a way in, else one more than the highest before it. Nodes on or
    behind a cycle are left out, so a graph without cycles has as many rows as nodes."""
    left = checkpointed(edges.select("a", "b").na.drop().distinct())
    nodes = checkpointed(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
    levels = None
    for k in count():
        free = checkpointed(nodes.join(left.select(F.col("b").alias("node")), "node", "left_anti").withColumn("level", F.lit(k)))
        if free.isEmpty():
            return free if levels is None else levels
        levels = free if levels is None else checkpointed(levels.union(free))
        nodes = checkpointed(nodes.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.select(F.col("node").alias("a")), "a", "left_anti"))
