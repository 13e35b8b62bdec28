"""Graph and tree measures as rounds of joins and map-side combined aggregates.

Every loop stops on a counted change, and cuts its lineage by reliable checkpoints,
so a lost executor costs at most the rounds since the last cut.  A hub's edges are
spread by adaptive skew joins; its messages are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.ordering import meet
from tallyloom.session import Log, Steps, cut_lineage, remove


def vertices_of(edges: DataFrame) -> DataFrame:
    """Adding an edge creates its nodes."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, rounds: int = 50, omega: float = 0.85, inverse: bool = False,
             cut_every: int = 5) -> DataFrame:
    """Rank of every vertex; ``inverse`` walks edges backwards.  Rank of dead ends is not handed on.

    Parallel edges become one weighted link, and degrees and vertices are read from the links,
    not from the edges.  A round is one join and one sum: the base rank enters the sum as a row
    per vertex, so no outer join is needed.  Ranks are written at rounds 2, 4 and every
    ``cut_every``; if none differs from the last ones written beyond the noise of a sum's order,
    they are the fixed point, and further rounds would not move them.
    """
    a, b = ("dst", "src") if inverse else ("src", "dst")
    met = cut_lineage(edges.groupBy(F.col(a).alias("u"), F.col(b).alias("v")).agg(F.count(F.lit(1)).alias("_m")))
    degree = met.groupBy("u").agg(F.sum("_m").alias("_d"))
    links = cut_lineage(met.join(degree, "u").select("u", "v", (F.col("_m") / F.col("_d")).alias("share")))
    nodes = cut_lineage((vertices if vertices is not None else vertices_of(met.select(F.col("u").alias("src"), F.col("v").alias("dst")))).select("id"))
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    base = nodes.select("id", F.lit((1 - omega) / n).alias("p"))
    rank, steps, written = nodes.select("id", F.lit(1.0 / n).alias("p")), Steps(), None
    for i in range(1, rounds + 1):
        sent = links.join(rank, links["u"] == rank["id"]).select(F.col("v").alias("id"), (F.col("share") * F.col("p") * omega).alias("p"))
        rank = base.unionByName(sent).groupBy("id").agg(F.sum("p").alias("p"))
        if (i in (2, 4) or i % cut_every == 0) and i < rounds:
            rank = steps.cut(rank)
            if written is not None:
                moved = rank.join(written.select("id", F.col("p").alias("_p")), "id").where(~(F.abs(F.col("p") - F.col("_p")) <= 1e-13 * F.col("p")))
                if moved.isEmpty():
                    break
            written = rank
    return rank.withColumnRenamed("p", "rank")


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Smallest vertex id of each undirected component (id, component).

    Each round takes the smallest label among the neighbours, hooks it to the own
    label's root, then jumps once along the labels: the number of rounds grows with the
    logarithm of the diameter.
    """
    pairs = cut_lineage(both_ways(edges.select("src", "dst")).where("src <> dst").distinct())
    nodes = (vertices if vertices is not None else vertices_of(edges)).select("id")
    steps = Steps()
    labels = steps.cut(nodes.select("id", F.col("id").alias("component")))
    kind = labels.schema["component"].dataType
    while True:
        own = labels.select(F.col("id").alias("src"), F.col("component").alias("_own"))
        theirs = labels.select(F.col("id").alias("dst"), F.col("component").alias("_near"))
        met = pairs.join(own, "src").join(theirs, "dst")
        # the neighbour's label reaches the vertex and the vertex's root; both offers leave one pass over the joined pairs
        offers = met.where("_near < _own").select(F.explode(F.array("src", "_own")).alias("id"), F.col("_near").alias("c"), F.lit(None).cast(kind).alias("_o"))
        # the own label travels along, so that no join with the last round is needed to see a change
        low = labels.select("id", F.col("component").alias("c"), F.col("component").alias("_o")).union(offers).groupBy("id").agg(F.min("c").alias("component"), F.min("_o").alias("_old"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("_root"))
        after = steps.cut(low.join(jump, "component").select("id", F.col("_root").alias("component"), (F.col("_root") != F.col("_old")).alias("_moved")))
        labels = after.select("id", "component")
        if after.where("_moved").isEmpty():
            return labels


def topo_order(edges: DataFrame, vertices: DataFrame | None = None, fold_at: int = 32) -> DataFrame:
    """Level of each vertex of a DAG: the number of peeling rounds before it has no open in-edge.

    Ordering by (level, id) is a topological order.  Vertices on or behind cycles have
    no row.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    nodes = (vertices if vertices is not None else vertices_of(edges)).select("id").distinct()
    waiting = cut_lineage(links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("open")))
    done, taken, level = Log(edges.sparkSession), Log(edges.sparkSession), 0
    free = done.add(nodes.join(waiting, "id", "left_anti").withColumn("level", F.lit(0)))
    total = lambda rows: rows.groupBy("id").agg(F.sum("gone").alias("gone"))
    while not free.isEmpty():
        level += 1
        # edges taken away are added to a log; only vertices they point at this round are looked up in it
        taken.fold(total, fold_at)
        met = taken.add(free.join(links, free["id"] == links["src"]).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("gone")))
        gone = total(taken.read().join(met.select("id"), "id", "left_semi"))
        free = done.add(gone.join(waiting, "id").where("gone = open").select("id", F.lit(level).alias("level")))
    return done.read()


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after sources and sinks are trimmed round by round."""
    steps = Steps()
    core = steps.cut(edges.select("src", "dst").distinct())
    size = core.count()
    while size:
        heads, tails = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        kept = steps.cut(core.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
        now = kept.count()
        core = kept
        if now == size:
            break
        size = now
    return core


def feedback_edges(edges: DataFrame) -> DataFrame:
    """A set of edges whose removal makes the graph acyclic.

    Inside the cyclic core vertices are ordered by (out-degree − in-degree) descending,
    then id; edges that do not go forward in that order are the set.  It is a valid set,
    not the one a depth-first search would pick.
    """
    core = cyclic_core(edges)
    balance = core.select(F.col("src").alias("id"), F.lit(1).alias("d")).union(core.select(F.col("dst").alias("id"), F.lit(-1).alias("d"))) \
        .groupBy("id").agg(F.sum("d").alias("d"))
    place = lambda name: balance.select(F.col("id").alias(name), F.struct((-F.col("d")).alias("d"), F.col("id").alias("i")).alias(f"_{name}"))
    return core.join(place("src"), "src").join(place("dst"), "dst").where(F.col("_src") >= F.col("_dst")).select("src", "dst")


def mst(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (src, dst, weight), by Borůvka rounds.

    Ties break by the end points, so the forest is unique.  A round finds the lightest
    edge leaving each component, joins the components it links, and drops inner edges.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    steps = Steps()
    live = steps.cut(edges.where("src <> dst").groupBy(low.alias("src"), high.alias("dst")).agg(F.min("weight").alias("weight"))
                       .withColumn("a", F.col("src")).withColumn("b", F.col("dst")))
    chosen = None
    while not live.isEmpty():
        key = F.struct("weight", "src", "dst")
        ends = live.select(F.col("a").alias("c"), key.alias("k")).union(live.select(F.col("b").alias("c"), key.alias("k")))
        best = ends.groupBy("c").agg(F.min("k").alias("k")).select("k.*").distinct()
        picked = cut_lineage(best.join(live, ["src", "dst", "weight"]).select("src", "dst", "weight", "a", "b"))
        new = picked.select("src", "dst", "weight")
        chosen = new if chosen is None else chosen.unionByName(new)
        comp = connected_components(picked.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        ca = comp.select(F.col("id").alias("a"), F.col("component").alias("_a"))
        cb = comp.select(F.col("id").alias("b"), F.col("component").alias("_b"))
        moved = live.join(ca, "a", "left").join(cb, "b", "left").select(
            "src", "dst", "weight", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        # parallel edges between two components can never all be needed: keep the lightest
        pair = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(key).alias("k"))
        live = steps.cut(pair.select("k.src", "k.dst", "k.weight", "a", "b"))
    return chosen if chosen is not None else live.select("src", "dst", "weight")


def distances(edges: DataFrame, sources: DataFrame, directed: bool = False, fold_at: int = 32) -> DataFrame:
    """Shortest distances (source, id, distance) from every source by relaxation rounds.

    Only vertices improved in the last round send messages.  Improvements are added to a
    log, which a round reads but does not write again; after ``fold_at`` rounds it is folded
    to the least distances.  Unreached vertices have no row.
    """
    return _relaxed(_links(edges, directed), sources, fold_at)


def _links(edges: DataFrame, directed: bool) -> DataFrame:
    """The lightest edge of each pair, written once: vertices and rounds read this table, not the edges."""
    links = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    return cut_lineage((links if directed else both_ways(links)).groupBy("src", "dst").agg(F.min("weight").alias("weight")))


def _relaxed(links: DataFrame, sources: DataFrame, fold_at: int = 32) -> DataFrame:
    least = lambda rows: rows.groupBy("source", "id").agg(F.min("distance").alias("distance"))
    known, front = Log(links.sparkSession), Steps()
    moved = known.add(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance")))
    while True:
        sent = front.cut(moved.join(links, moved["id"] == links["src"]).select(
            "source", F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("_d")).groupBy("source", "id").agg(F.min("_d").alias("_d")))
        known.fold(least, fold_at)
        met = known.read().join(sent, ["source", "id"]).where("distance <= _d").select("source", "id").distinct()
        moved = known.add(sent.join(met, ["source", "id"], "left_anti").select("source", "id", F.col("_d").alias("distance")))
        if moved.isEmpty():
            return least(known.read())


def sssp(edges: DataFrame, source, directed: bool = False) -> DataFrame:
    """Distance of every vertex from one source; infinity where no path exists."""
    links = _links(edges, directed)
    # undirected links hold every vertex as a start
    nodes = vertices_of(links) if directed else links.select(F.col("src").alias("id")).distinct()
    found = _relaxed(links, nodes.where(F.col("id") == source)).select("id", "distance")
    return nodes.join(found, "id", "left").withColumn("distance", F.coalesce("distance", F.lit(float("inf"))))


def pivot_distances(edges: DataFrame, pivots: int, first=None, directed: bool = False) -> DataFrame:
    """Distances (pivot_no, pivot, id, distance) from pivots chosen to be far apart.

    The next pivot is the vertex farthest from all earlier ones (smallest id on a tie).
    The number of pivots is a small parameter; only the pivot ids reach the driver.
    """
    nodes = cut_lineage(vertices_of(edges))
    pivot = first if first is not None else nodes.agg(F.min("id")).first()[0]
    out = None
    for k in range(pivots):
        d = distances(edges, nodes.where(F.col("id") == pivot), directed).select("id", "distance")
        row = cut_lineage(nodes.join(d, "id", "left").select(
            F.lit(k).alias("pivot_no"), F.lit(pivot).alias("pivot"), "id", F.coalesce("distance", F.lit(float("inf"))).alias("distance")))
        out = row if out is None else out.unionByName(row)
        if k + 1 < pivots:
            near = out.groupBy("id").agg(F.min("distance").alias("d"))
            pivot = near.orderBy(F.desc("d"), F.asc("id")).first()["id"]
    return out


def all_pairs(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Distances between all pairs that are connected.  The result has up to V² rows by
    definition; use :func:`pivot_distances` on large graphs."""
    return distances(edges, vertices_of(edges), directed)


def layout_stress(edges: DataFrame, coordinates: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Σ (l·D − d)² / (l·D)² over ordered pairs; l is the mean edge length."""
    length = edges.agg(F.avg("weight")).scalar()
    d = (paths if paths is not None else all_pairs(edges)).where("source <> id")
    at = lambda name: coordinates.select(F.col("id").alias(name), F.col("x").alias(f"_x_{name}"), F.col("y").alias(f"_y_{name}"))
    both = d.join(at("source"), "source").join(at("id"), "id").withColumn("_D", F.col("distance") * length)
    gap = F.sqrt(F.pow(F.col("_x_source") - F.col("_x_id"), F.lit(2)) + F.pow(F.col("_y_source") - F.col("_y_id"), F.lit(2)))
    return both.agg(F.sum(F.pow(F.col("_D") - gap, F.lit(2)) / (F.col("_D") * F.col("_D"))).alias("stress"), F.count(F.lit(1)).alias("pairs"))


def tree_metrics(edges: DataFrame, per_task: int = 200000) -> DataFrame:
    """Per node of a forest (parent, child): depth below the root, height, leaf count.

    In round k every node knows its ancestor 2^k above and what lies less than 2^k below it;
    the nodes 2^k below add what they know.  So a path of n nodes takes log2(n) rounds, not
    n.  Nodes on or below a cycle have no row.
    """
    links = cut_lineage(edges.select("parent", "child").distinct())
    ids = links.select(F.col("parent").alias("id")).union(links.select("child")).distinct()
    inner = links.select(F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(True))
    steps = Steps()
    own = ids.join(links.select(F.col("child").alias("id"), F.col("parent").alias("up")), "id", "left").join(inner, "id", "left")
    state = steps.cut(own.select("id", "up", F.col("up").isNotNull().cast("int").alias("depth"), F.lit(0).alias("height"),
                                 F.when(F.col("_inner"), 0).otherwise(1).cast("long").alias("leaves")))
    reach, nodes = 1, state.count()
    while reach <= nodes and not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(
            F.sum("leaves").alias("_l"), (F.max("height") + reach).cast("int").alias("_h"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        told = state.join(below, "id", "left").select("id", "up", "depth", F.greatest("height", F.coalesce("_h", F.lit(0))).alias("height"),
                                                      (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"))
        told = cut_lineage(told)
        # a node with many children is asked by all of them; nodes that have met their root ask nobody
        asking = meet(told.where("up is not null"), above, ["up"], per_task, nodes)
        state = steps.cut(told.where("up is null").unionByName(asking.select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), "height", "leaves")))
        remove(told)
        reach *= 2
    return state.where("up is null").select("id", "depth", "height", "leaves")
