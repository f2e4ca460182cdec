"""Graphs of couplings: communities by modularity, average linkage with its leaf order, and the neighbourhood of a node.

All of it are rounds of joins and aggregates over edge tables that are written between rounds; the driver sees counts and
sums alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.operators.corpus import mirrored
from lineupkit.runtime import drop_stash, stash

_EXACT = "decimal(38,0)"


def _whole(x: Column) -> Column:
    return x.cast(_EXACT)


def _quality(edges: DataFrame, loops: DataFrame, nodes: DataFrame, total: int) -> tuple[int, int]:
    """4 m² times the modularity, exactly: Σ over communities of 4 m L - D², L the weight inside and D the degrees' sum; and the nodes moved."""
    own = nodes.select("node", "comm")
    inside = edges.join(own.toDF("u", "cu"), "u").join(own.toDF("v", "cv"), "v").where("cu = cv").select(F.col("cu").alias("comm"), "w")
    inside = inside.unionByName(loops.join(own, "node").select("comm", "w")).agg(_whole(F.sum("w")).alias("l"))
    degrees = nodes.groupBy("comm").agg(_whole(F.sum("k")).alias("d"), F.sum(F.col("moved").cast("long")).alias("moved"))
    degrees = degrees.agg(_whole(F.sum(F.col("d") * F.col("d"))).alias("d2"), F.sum("moved").alias("moved"))
    row = inside.crossJoin(degrees).first()  # one row beside one row
    return 4 * total * int(row.l or 0) - int(row.d2 or 0), row.moved


def _proposals(edges: DataFrame, nodes: DataFrame, total: int, level: int, part: int) -> DataFrame:
    """(node, k, own, comm, gain): nodes of one half that gain by another community, with the best, ties to the first name."""
    degree = nodes.groupBy("comm").agg(_whole(F.sum("k")).alias("d"))
    both = edges.select("u", "v", "w").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    asked = nodes.where(F.crc32(F.concat_ws(":", F.lit(level), "node")) % 2 == part).select("node", "k", F.col("comm").alias("own"))
    met = both.join(asked.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v"), "comm"), "v").select(F.col("u").alias("node"), "comm", "w")
    # The own community is a choice even where no neighbour is in it; the node itself is taken out of its sums.
    stay = asked.select("node", F.col("own").alias("comm"), F.lit(0).cast("long").alias("w"))
    scored = met.unionByName(stay).groupBy("node", "comm").agg(F.sum("w").alias("w")).join(asked, "node").join(degree, "comm")
    rest = F.col("d") - F.when(F.col("comm") == F.col("own"), _whole(F.col("k"))).otherwise(_whole(F.lit(0)))
    gain = (_whole(F.col("w")) * F.lit(2 * total).cast(_EXACT)).cast(_EXACT) - (_whole(F.col("k")) * rest).cast(_EXACT)
    scored = scored.select("node", "k", "own", "comm", gain.cast(_EXACT).alias("gain"))
    best = scored.groupBy("node", "k", "own").agg(F.min(F.struct((-F.col("gain")).alias("g"), F.col("comm"))).alias("b"), F.max(F.when(F.col("comm") == F.col("own"), F.col("gain"))).alias("now"))
    best = best.select("node", "k", "own", F.col("b.comm").alias("comm"), (-F.col("b.g") - F.col("now")).cast(_EXACT).alias("gain"))
    return best.where("gain > 0")


def _apart(proposals: DataFrame) -> DataFrame:
    """Those that are the best, by gain and name, of both communities they touch: their gains add up exactly."""
    rank = F.struct((-F.col("gain")).alias("g"), F.col("node").alias("n"))
    touched = proposals.select(F.col("own").alias("c"), rank.alias("r")).unionByName(proposals.select(F.col("comm").alias("c"), rank.alias("r")))
    first = touched.groupBy("c").agg(F.min("r").alias("r"))
    return proposals.join(first.toDF("own", "ro"), "own").join(first.toDF("comm", "rc"), "comm").where((F.col("ro.n") == F.col("node")) & (F.col("rc.n") == F.col("node")))


def _moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    to = moves.select(F.col("node").alias("n_"), F.col("comm").alias("to_"))
    return nodes.join(to, F.col("node") == F.col("n_"), "left").select("node", "k", F.coalesce("to_", "comm").alias("comm"), F.col("to_").isNotNull().alias("moved"))


def communities(edges: DataFrame, scale: int = 1_000_000, max_levels: int = 20, max_rounds: int = 30, least_gain: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """(node, community) of every node with an edge, and the modularity after each level.

    ``edges`` (i, j, weight > 0; i < j).  Weights count as whole numbers of 1/``scale``, so that sums do not depend on their
    order.  A level: the two halves of the nodes, by a hash, take turns to move to the neighbouring community of largest gain;
    where all moves of a round together do not raise the modularity, those are made that are the best of both
    communities they touch, whose gains add up.  The level ends when neither half gains ``least_gain``, or after
    ``max_rounds``; then a community becomes a node, named by its first member.  It ends with a level that gains less than
    ``least_gain``.  Edges of no weight and loops are ignored; without edges there are no rows.
    """
    w = F.round(F.col("weight") * scale).cast("long")
    edges = edges.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), w.alias("w")).where("u <> v AND w > 0")
    edges = stash(edges.groupBy("u", "v").agg(F.sum("w").alias("w")), "graph")
    total = edges.agg(F.sum("w")).first()[0]
    ends = edges.select("u", "w").union(edges.select("v", "w")).toDF("node", "w")
    member = stash(ends.select("node").distinct().withColumn("community", F.col("node")), "communities")
    if not total:
        return member, []
    loops = edges.limit(0).select(F.col("u").alias("node"), "w")
    out: list[float] = []
    for level in range(max_levels):
        ends = edges.select("u", "w").union(edges.select("v", "w")).toDF("node", "w").unionByName(loops.select("node", (2 * F.col("w")).alias("w")))
        nodes = stash(ends.groupBy("node").agg(F.sum("w").alias("k")).select("node", "k", F.col("node").alias("comm"), F.lit(False).alias("moved")), "graph-nodes")
        (quality, _), idle = _quality(edges, loops, nodes, total), 0
        at_first = quality
        for turn in range(max_rounds):
            if idle == 2:
                break
            asked = stash(_proposals(edges, nodes, total, level, turn % 2), "graph-moves")
            new = stash(_moved(nodes, asked), "graph-nodes")
            better, count = _quality(edges, loops, new, total)
            if count and better <= quality:  # too many at once
                drop_stash(new)
                new = stash(_moved(nodes, _apart(asked)), "graph-nodes")
                better, count = _quality(edges, loops, new, total)
            idle = 0 if better - quality > least_gain * 4 * total * total else idle + 1
            drop_stash(nodes)
            drop_stash(asked)
            nodes, quality = new, better
        out.append(quality / (4 * total * total))
        if quality - at_first <= least_gain * 4 * total * total:
            break
        # A community is named by its first member from here on.
        first = nodes.groupBy("comm").agg(F.min("node").alias("name"))
        named = stash(nodes.join(first, "comm").select("node", "name"), "graph-names")
        member = stash(member.join(named.toDF("community", "name"), "community").select("node", F.col("name").alias("community")), "communities")
        a, b = named.toDF("u", "nu"), named.toDF("v", "nv")
        joined = edges.join(a, "u").join(b, "v")
        inner = joined.where("nu = nv").select(F.col("nu").alias("node"), "w").unionByName(loops.join(named, "node").select(F.col("name").alias("node"), "w"))
        outer = joined.where("nu <> nv").groupBy(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).agg(F.sum("w").alias("w"))
        loops, edges = stash(inner.groupBy("node").agg(F.sum("w").alias("w")), "graph-loops"), stash(outer, "graph")
    return member, out


def profile_distances(couplings: DataFrame) -> DataFrame:
    """(i, j, distance; i < j): one minus the cosine of the features' coupling rows, at least 0; features without couplings have no row."""
    rows = mirrored(couplings.where("coupling <> 0"), "coupling")
    norm = rows.groupBy("i").agg(F.sqrt(F.sum(F.col("coupling") * F.col("coupling"))).alias("n"))
    unit = rows.join(norm, "i").select("i", "j", (F.col("coupling") / F.col("n")).alias("x"))
    names = norm.select("i")
    dots = unit.toDF("i", "k", "x").join(unit.toDF("j", "k", "y"), "k").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    # Profiles that share no partner are at distance 1: every pair of the (bounded) vocabulary has a row.
    every = names.join(names.toDF("j"), F.col("i") < F.col("j"))
    return every.join(dots, ["i", "j"], "left").select("i", "j", F.greatest(1 - F.coalesce("dot", F.lit(0.0)), F.lit(0.0)).alias("distance"))


def average_linkage(distances: DataFrame, max_rounds: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """Merges (a, b, height, size) and leaves (node, position).

    ``distances`` has a row (i, j, distance; i < j) for every pair.  In a round all pairs that are each other's nearest merge,
    which for average linkage gives the tree of one merge at a time.  A cluster is named by its first member and
    stands left of one with a later name; ties go to the first names.  A pair table shrinks with every round.
    """
    now = stash(distances.select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("distance").alias("s")), "linkage")
    names = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    leaves = stash(names.select("node", F.col("node").alias("c"), F.lit(0).cast("long").alias("position")), "leaves")
    sizes = stash(names.select(F.col("node").alias("c"), F.lit(1).cast("long").alias("n")), "sizes")
    merges = None
    for _ in range(max_rounds):
        far = now.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        far = far.select(F.struct((F.col("s") / (F.col("na") * F.col("nb"))).alias("d"), "a", "b").alias("p"))
        near = far.select(F.col("p.a").alias("c"), "p").union(far.select(F.col("p.b").alias("c"), "p")).groupBy("c").agg(F.min("p").alias("p"))
        pairs = near.groupBy("p").agg(F.count("*").alias("k")).where("k = 2").select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.d").alias("height"))
        both = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        found = stash(both.select("a", "b", "height", "na", (F.col("na") + F.col("nb")).alias("size")), "merges")
        if found.isEmpty():
            break
        one = found.select("a", "b", "height", "size")
        merges = one if merges is None else merges.unionByName(one)
        into = found.select(F.col("b").alias("c"), F.col("a").alias("to"), F.col("na").alias("left"))
        moved = leaves.join(into, "c", "left")
        leaves = stash(moved.select("node", F.coalesce("to", "c").alias("c"), (F.col("position") + F.coalesce("left", F.lit(0))).alias("position")), "leaves")
        grown = sizes.join(into.select("c"), "c", "left_anti").join(found.select(F.col("a").alias("c"), "size"), "c", "left")
        sizes = stash(grown.select("c", F.coalesce("size", "n").alias("n")), "sizes")
        to = into.select("c", "to")
        joined = now.join(to.toDF("a", "ta"), "a", "left").join(to.toDF("b", "tb"), "b", "left")
        ends = joined.select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"), "s").where("x <> y")
        new = stash(ends.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")), "linkage")
        drop_stash(now)
        now = new
    if merges is None:
        merges = now.limit(0).select("a", "b", F.col("s").alias("height"), F.lit(0).cast("long").alias("size"))
    return merges, leaves.select("node", "position")


def ego_network(couplings: DataFrame, k_positive: int = 8, k_negative: int = 8) -> DataFrame:
    """(ego, i, j, coupling, spoke): of every feature its strongest partners of either sign, and the couplings among these.

    ``spoke`` marks the ego's own couplings; ties go to the first name.
    """
    both = mirrored(couplings.where("coupling <> 0"), "coupling")
    order = Window.partitionBy("i", F.col("coupling") > 0).orderBy(F.desc(F.round(F.abs("coupling"), 12)), "j")
    ranked = both.withColumn("rank", F.row_number().over(order))
    spokes = ranked.where(F.col("rank") <= F.when(F.col("coupling") > 0, k_positive).otherwise(k_negative)).select(F.col("i").alias("ego"), F.col("j").alias("partner"), "coupling")
    spokes = stash(spokes, "spokes")
    a, b = spokes.select("ego", F.col("partner").alias("i")), spokes.select("ego", F.col("partner").alias("j"))
    rim = couplings.where("coupling <> 0").join(a, "i").join(b, ["ego", "j"]).select("ego", "i", "j", "coupling", F.lit(False).alias("spoke"))
    return spokes.select("ego", F.col("ego").alias("i"), F.col("partner").alias("j"), "coupling", F.lit(True).alias("spoke")).unionByName(rim)
