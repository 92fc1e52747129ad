"""Property graphs as two tables: nodes (``id``, ``type``) and edges (``src``, ``type``, ``dst``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retrix.sources.tables import cut, release


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist, each once."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept.select("src", "type", "dst").distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after deleting nodes (column ``id``) with all edges at them."""
    rest = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), rest


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "type", "dst").union(edges.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges at every node, 0 where there are none. Counted before the join, so hubs are no burden."""
    counted = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """Nodes within ``depth`` steps of each seed (column ``id``): ``seed``, ``id``, ``hops`` (the fewest)."""
    steps = (edges if directed else both_ways(edges)).select("src", "dst").distinct()
    reached = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"))
    frontier = reached
    for hop in range(1, depth + 1):
        near = frontier.join(steps, frontier["id"] == steps["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = near.join(reached.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop))
        if hop < depth:
            frontier = cut(frontier)
        reached = reached.unionByName(frontier)
    return reached


def path_patterns(edges: DataFrame, length: int) -> DataFrame:
    """How many directed paths of ``length`` edges have each sequence of types: ``pattern``, ``paths``.

    Paths are counted node by node (a product of counts), never listed.
    """
    paths = edges.groupBy(F.col("dst").alias("at"), F.col("type").alias("pattern")).agg(F.count(F.lit(1)).alias("paths"))
    out = edges.groupBy("src", "type", "dst").agg(F.count(F.lit(1)).alias("k"))
    for step in range(1, length):
        if step == length - 1:  # the last node doesn't matter
            by_node = out.groupBy("src", "type").agg(F.sum("k").alias("k"))
            joined = paths.join(by_node, paths["at"] == by_node["src"])
            return joined.groupBy(F.concat_ws(">", "pattern", "type").alias("pattern")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        joined = paths.join(out, paths["at"] == out["src"])
        paths = joined.groupBy(F.col("dst").alias("at"), F.concat_ws(">", "pattern", "type").alias("pattern")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
    return paths.groupBy("pattern").agg(F.sum("paths").alias("paths"))


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``id`` and ``rank``; the rank of nodes without outgoing edges is spread over all."""
    total = nodes.count()
    if not total:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    weighted = cut(edges.select("src", "dst").join(out, "src"))
    ranks = nodes.select("id", F.lit(1.0 / total).alias("rank"))
    sinks = cut(nodes.select("id").join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    for number in range(1, rounds + 1):
        loose = ranks.join(sinks, "id", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s")).first()["s"]  # one row
        given = weighted.join(ranks, weighted["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        base = (1 - damping) / total + damping * loose / total
        before, ranks = ranks, cut(nodes.select("id").join(given, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        release(before)
    return ranks


#: Rounds whose turns a node carries at once, a bit each.
TURNS = 32


def _turns(number: int) -> Column:
    """Whether a node may change in round ``number`` and those after it, as bits, the first the lowest."""
    bits = F.lit(0).cast("long")
    for k in range(TURNS):
        bits = bits + F.when(F.pmod(F.xxhash64("id", F.lit(number + k)), F.lit(2)) == 0, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def communities(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``id`` and ``community`` by label propagation: a node takes the label most of its neighbours have (the
    smallest among several) if that is more than have its own, until no node would change (or for ``rounds``).

    Half of the nodes, another half in each round, may change: if all did at once, the two sides of a graph
    without odd cycles could swap labels for ever.

    Nodes are numbered in the order of their ids. All rounds have one and the same plan, with one join, which is never
    a broadcast: the driver holds no relation, and compiles nothing anew.
    """
    named = cut(nodes.select("id").where("id is not null").distinct().orderBy("id").withColumn("node", F.monotonically_increasing_id()))
    ends = lambda name: named.select(F.col("id").alias(name), F.col("node").alias(f"{name}_node")).hint("merge")
    pairs = both_ways(edges).where("src <> dst").select("src", "dst").distinct()
    steps = cut(pairs.join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("node")))
    labels = named.select("node", F.col("node").alias("community"), _turns(1).alias("turns"))
    number, last = 0, None
    while rounds is None or number < rounds:
        number += 1
        heard = steps.join(labels.select(F.col("node").alias("src"), "community").hint("merge"), "src").select("node", "community", F.lit(1).alias("n"), F.lit(None).cast("long").alias("turns"))
        votes = heard.unionByName(labels.select("node", "community", F.lit(0).alias("n"), "turns")).groupBy("node", "community").agg(F.sum("n").alias("n"), F.max("turns").alias("turns"))
        own = F.col("turns").isNotNull()
        best = votes.groupBy("node").agg(
            F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "community"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("kept"),
            F.max(F.when(own, F.col("community"))).alias("community"), F.max("turns").alias("turns"),
        )
        moved = cut(best.select("node", "community", F.when(-F.col("b.n") > F.col("kept"), F.col("b.community")).alias("next"), "turns"))
        if not moved.where("next is not null").limit(1).count():
            release(moved)
            break
        if last is not None:
            release(last)  # what the labels before were read from
        last = moved
        if number % TURNS:
            later, turns = moved, F.shiftrightunsigned("turns", 1)
        else:
            later, turns = moved.join(named.select("node", _turns(number + 1).alias("later")).hint("merge"), "node"), F.col("later")
        labels = later.select("node", F.when(F.col("turns").bitwiseAND(1) == 1, F.coalesce("next", "community")).otherwise(F.col("community")).alias("community"), turns.alias("turns"))
    names = named.select(F.col("node").alias("community"), F.col("id").alias("name")).hint("merge")
    placed = labels.select("node", "community").join(names, "community").join(named.hint("merge"), "node").select("id", F.col("name").alias("community"))
    found = cut(nodes.select("id").join(placed.hint("merge"), "id", "left"))
    for held in (steps, named, *([last] if last is not None else [])):
        release(held)
    return found


def modularity(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``community``, ``members`` and its part of the ``modularity`` (their sum is that of the whole) in the undirected
    graph without repeated edges. No table is broadcast."""
    steps = cut(both_ways(edges).where("src <> dst").select("src", "dst").distinct())
    placed = steps.join(found.select(F.col("id").alias("src"), "community").hint("merge"), "src").join(found.select(F.col("id").alias("dst"), F.col("community").alias("other")).hint("merge"), "dst")
    total = float(max(steps.count(), 1))  # each edge both ways
    inside = placed.groupBy("community").agg(F.sum((F.col("community") == F.col("other")).cast("long")).alias("within"), F.count(F.lit(1)).alias("ends"))
    share = F.coalesce("within", F.lit(0)) / total - F.pow(F.coalesce("ends", F.lit(0)) / total, F.lit(2))
    return found.groupBy("community").agg(F.count(F.lit(1)).alias("members")).join(inside.hint("merge"), "community", "left").select("community", "members", share.alias("modularity"))


def top_central(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes with the highest degree centrality (degree over the other nodes)."""
    total = nodes.count()
    scored = degrees(nodes, edges).withColumn("centrality", F.round(F.col("degree") / F.lit(float(max(total - 1, 1))), 9))
    return scored.orderBy(F.desc("centrality"), "id").limit(k).select("id", "centrality")


def _brandes(spark: SparkSession, core: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the nodes of ``core`` (``src``, ``dst`` both ways), pairs of other nodes, weighted by how many nodes each stands
    for, whose shortest paths lead through them (``id``, ``pairs``), and the nodes of their part of the graph (``id``, ``part``).
    Sources are spread over tasks; every task holds the whole core."""
    rows = weights.join(core.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near")), "id").collect()
    number = {r["id"]: k for k, r in enumerate(rows)}
    shared = spark.sparkContext.broadcast(([r["id"] for r in rows], [r["w"] for r in rows], [[number[x] for x in r["near"]] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, near = shared.value
        total, parts = [0.0] * len(names), {}
        for batch in batches:
            for source in batch.column(0).to_pylist():
                away, paths, order = {source: 0}, {source: 1}, [source]
                for v in order:  # grows on the way
                    for u in near[v]:
                        if u not in away:
                            away[u], paths[u] = away[v] + 1, 0
                            order.append(u)
                        if away[u] == away[v] + 1:
                            paths[u] += paths[v]
                parts[source] = sum(weight[v] for v in order)
                behind = dict.fromkeys(order, 0.0)
                for u in reversed(order):
                    for v in near[u]:
                        if away[v] == away[u] - 1:
                            behind[v] += paths[v] / paths[u] * (weight[u] + behind[u])
                    if u != source:
                        total[u] += weight[source] * behind[u] / 2
        kept = [k for k, x in enumerate(total) if x or k in parts]
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in kept], pa.string()), pa.array([total[k] for k in kept], pa.float64()), pa.array([parts.get(k) for k in kept], pa.int64())], names=["id", "pairs", "part"])

    spread = spark.range(0, len(rows), 1, max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))
    found = cut(spread.mapInArrow(run, "id string, pairs double, part long").groupBy("id").agg(F.sum("pairs").alias("pairs"), F.max("part").alias("part")))
    return found.select("id", "pairs"), found.select("id", "part")


def betweenness(nodes: DataFrame, edges: DataFrame, peels: int = 20) -> DataFrame:
    """``id``, ``degree`` (neighbours; 2 for an edge to itself) and ``betweenness`` (share of the pairs of other nodes whose
    shortest paths lead through it) in the undirected graph without repeated edges; ends of edges are nodes too.

    Nodes with one neighbour are taken off, round by round, and stand in their neighbour's weight, for which sums in
    closed form suffice; what is left after ``peels`` rounds is searched from every node. Both are exact.
    """
    spark = nodes.sparkSession
    every = both_ways(edges).where("src is not null and dst is not null").select("src", "dst").distinct()
    live = cut(every.where("src <> dst"))
    counted = every.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).alias("degree"))
    everyone = cut(nodes.select("id").where("id is not null").union(every.select(F.col("src").alias("id"))).distinct().join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")))
    n = everyone.count()
    state = everyone.select("id", F.lit(1).cast("long").alias("w"), F.lit(0.0).alias("squares"))
    gone: list[DataFrame] = []
    for _ in range(peels):
        ends = cut(live.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("parent")).where("n = 1").select("id", "parent"))
        twins = ends.select(F.col("parent").alias("id"), F.col("id").alias("parent")).where("id < parent")
        leaves = ends.join(twins, ["id", "parent"], "left_anti")  # of two that have only each other the larger goes
        taken = cut(leaves.join(state, "id"))
        if not taken.limit(1).count():
            break
        gone.append(taken)
        given = taken.groupBy(F.col("parent").alias("id")).agg(F.sum("w").alias("more"), F.sum(F.col("w").cast("double") * F.col("w")).alias("extra"))
        state = cut(
            state.join(taken.select("id"), "id", "left_anti").join(given, "id", "left")
            .select("id", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("squares") + F.coalesce("extra", F.lit(0.0))).alias("squares"))
        )
        off = taken.select(F.col("id").alias("src"))
        live = cut(live.join(off, "src", "left_anti").join(off.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    pairs, parts = _brandes(spark, live, state) if live.limit(1).count() else (None, None)
    if pairs is None:
        out = state.select("id", "w", "squares", F.col("w").alias("part"), F.lit(0.0).alias("pairs"))
    else:
        out = state.join(parts, "id", "left").join(pairs, "id", "left").select("id", "w", "squares", F.coalesce("part", "w").alias("part"), F.coalesce("pairs", F.lit(0.0)).alias("pairs"))
    out = cut(out)
    known = out
    for taken in reversed(gone):  # the size of a part comes from the parent
        back = cut(taken.join(known.select(F.col("id").alias("parent"), "part"), "parent").select("id", "w", "squares", "part", F.lit(0.0).alias("pairs")))
        known = known.unionByName(back)
    w, part = F.col("w").cast("double"), F.col("part").cast("double")
    through = ((w - 1) * (w - 1) - F.col("squares")) / 2 + (w - 1) * (part - w) + F.col("pairs")
    return everyone.join(known, "id").select("id", "degree", (through / max((n - 1) * (n - 2) / 2, 1.0)).alias("betweenness"))


def central_entities(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes with the highest mean of degree centrality and betweenness."""
    found = cut(betweenness(nodes, edges))
    scored = found.withColumn("centrality", F.round(0.5 * F.col("degree") / F.lit(float(max(found.count() - 1, 1))) + 0.5 * F.col("betweenness"), 9))
    return scored.orderBy(F.desc("centrality"), "id").limit(k).select("id", "degree", F.round("betweenness", 9).alias("betweenness"), "centrality")


def triples(lines: DataFrame, line_col: str) -> DataFrame:
    """Edges written as ``A -> relation -> B``, one a row; other lines give none."""
    parts = F.transform(F.split(line_col, "->"), lambda x: F.trim(x))
    return lines.withColumn("p", parts).where(F.size("p") == 3).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("type"), F.col("p")[2].alias("dst")).where("src <> '' AND dst <> ''")


def first_per(df: DataFrame, by: str, order: str) -> DataFrame:
    window = Window.partitionBy(by).orderBy(order)
    return df.withColumn("n", F.row_number().over(window)).where("n = 1").drop("n")
