"""Species blocks of a pair model, from the couplings that exist: what has none counts 0 without a row.

``features`` is (feature, species, m), ``couplings`` (i, j, coupling) once a pair.  Every quantity is a sum over known
couplings, corrected by the number of items of a species, so nothing grows with the square of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def item_weights(features: DataFrame, n_teams: float) -> DataFrame:
    """(feature, species, weight, appearances): m over its species' sum (uniform if that is nothing); Σ m n of the species."""
    sums = features.groupBy("species").agg(F.sum("m").alias("sum_"), F.count("*").alias("k_"))
    share = F.when(F.col("sum_") > TINY, F.col("m") / F.col("sum_")).otherwise(1.0 / F.col("k_"))
    return features.join(sums, "species").select("feature", "species", share.alias("weight"), (F.col("sum_") * n_teams).alias("appearances"))


def entries(couplings: DataFrame, features: DataFrame) -> DataFrame:
    """Both directions of every coupling between species: (i, p, j, q, b) with the numbers of items np, nq."""
    both = couplings.select("i", "j", F.col("coupling").alias("b")).unionByName(couplings.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("coupling").alias("b")))
    counts = features.groupBy("species").agg(F.count("*").alias("k"))
    site = features.select("feature", "species").join(counts, "species")
    a, b = site.toDF("p", "i", "np"), site.toDF("q", "j", "nq")
    return both.join(a, "i").join(b, "j").where("p <> q")


def row_modulation(cells: DataFrame) -> DataFrame:
    """(p, q, i, j, modulation) of the known couplings: less the mean of their column within the block."""
    column = cells.groupBy("p", "j").agg(F.sum("b").alias("s_"))
    return cells.join(column, ["p", "j"]).select("p", "q", "i", "j", (F.col("b") - F.col("s_") / F.col("np")).alias("modulation"))


def modulation_scores(cells: DataFrame, features: DataFrame) -> DataFrame:
    """(species, n_items, mod_frob, mod_rms, mod_frac, synergy_frob) of every species."""
    columns = cells.groupBy("p", "q", "np", "nq", "j").agg(F.sum("b").alias("s"), F.sum(F.col("b") * F.col("b")).alias("ss"))
    blocks = columns.groupBy("p", "q", "np", "nq").agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("np")).alias("mod"), F.sum("ss").alias("full"), F.sum("s").alias("s"))
    mean = F.col("s") / (F.col("np") * F.col("nq"))
    sums = blocks.groupBy(F.col("p").alias("species")).agg(F.greatest(F.sum("mod"), F.lit(0.0)).alias("mod"), F.sum("full").alias("full"), F.sum(mean * mean).alias("syn"))
    counts = features.groupBy("species").agg(F.count("*").alias("n_items"))
    size = counts.agg(F.sum("n_items").alias("v_"))
    rows = counts.crossJoin(F.broadcast(size)).join(sums, "species", "left").fillna(0.0, ["mod", "full", "syn"])
    cellcount = F.col("n_items") * (F.col("v_") - F.col("n_items"))
    return rows.select(
        "species", "n_items", F.sqrt("mod").alias("mod_frob"), F.when(cellcount > 0, F.sqrt(F.col("mod") / cellcount)).otherwise(0.0).alias("mod_rms"),
        F.when(F.col("full") > TINY, F.col("mod") / F.col("full")).otherwise(0.0).alias("mod_frac"), F.sqrt("syn").alias("synergy_frob"),
    )


def item_magnitudes(cells: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, species, magnitude): norm of a feature's deviations from its species' column means over all partners."""
    column = cells.groupBy("p", "np", "j").agg(F.sum("b").alias("s_"))
    base = column.groupBy(F.col("p").alias("species")).agg(F.sum(F.pow(F.col("s_") / F.col("np"), 2)).alias("base_"))
    own = cells.join(column.drop("np"), ["p", "j"]).groupBy(F.col("i").alias("feature")).agg(F.sum(F.col("b") * F.col("b") - 2 * F.col("b") * F.col("s_") / F.col("np")).alias("own_"))
    rows = features.select("feature", "species").join(base, "species", "left").join(own, "feature", "left").fillna(0.0, ["base_", "own_"])
    return rows.select("feature", "species", F.sqrt(F.greatest(F.col("base_") + F.col("own_"), F.lit(0.0))).alias("magnitude"))


def item_partners(cells: DataFrame, features: DataFrame, top: int = 3) -> DataFrame:
    """(feature, j, delta, side, rank): partners that a feature pulls most toward (1) and away (-1), among those its species has a coupling with."""
    column = cells.groupBy("p", "np", "j").agg(F.sum("b").alias("s_"))
    rows = features.select(F.col("feature").alias("i"), F.col("species").alias("p")).join(column, "p").join(cells.select("i", "j", "b"), ["i", "j"], "left")
    rows = rows.select(F.col("i").alias("feature"), "j", (F.coalesce("b", F.lit(0.0)) - F.col("s_") / F.col("np")).alias("delta"))
    sides = rows.select("*", F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    order = Window.partitionBy("feature", "side").orderBy(F.desc(F.round(F.col("delta") * F.col("side"), 9)), "j")
    return sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def apc_graph(cells: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(species_a, species_b, frob, apc, corrected, synergy) of all species pairs."""
    w = weights.select("feature", "weight")
    weighted = cells.where("p < q").join(w.toDF("i", "wi"), "i").join(w.toDF("j", "wj"), "j")
    pairs = weighted.groupBy("p", "q", "np", "nq").agg(F.sum("b").alias("s"), F.sum(F.col("b") * F.col("b")).alias("ss"), F.sum(F.col("b") * F.col("wi") * F.col("wj")).alias("synergy"))
    frob = F.sqrt(F.greatest(F.col("ss") - F.col("s") * F.col("s") / (F.col("np") * F.col("nq")), F.lit(0.0)))
    pairs = pairs.select("p", "q", frob.alias("frob"), "synergy")
    rows = pairs.select(F.col("p").alias("species"), "frob").unionByName(pairs.select(F.col("q").alias("species"), "frob")).groupBy("species").agg(F.sum("frob").alias("f"))
    # The species are a short list: each row has those that follow it.
    names = features.select("species").distinct()
    all_ = names.agg(F.sort_array(F.collect_list("species")).alias("all_"))
    total = rows.agg(F.sum("f").alias("total_"))
    sites = names.join(rows, "species", "left").fillna(0.0, ["f"])
    grid = sites.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(total)).withColumn("n_", F.size("all_"))
    grid = grid.select(F.col("species").alias("p"), F.col("f").alias("fp"), "n_", "total_", F.explode(F.filter("all_", lambda x: x > F.col("species"))).alias("q"))
    grid = grid.join(sites.toDF("q", "fq"), "q").join(pairs, ["p", "q"], "left").fillna(0.0, ["frob", "synergy"])
    grand = F.col("total_") / (F.col("n_") * (F.col("n_") - 1))
    apc = F.when(grand > TINY, F.col("fp") * F.col("fq") / F.pow(F.col("n_") - 1, 2) / grand).otherwise(0.0)
    return grid.select(F.col("p").alias("species_a"), F.col("q").alias("species_b"), "frob", apc.alias("apc"), (F.col("frob") - apc).alias("corrected"), "synergy")


def species_synergy(cells: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, species, synergy): Σ J m / Σ m over a species' features, their plain mean if Σ m is nothing."""
    m = features.select(F.col("feature").alias("j"), F.col("m"))
    sums = features.groupBy(F.col("species").alias("q")).agg(F.sum("m").alias("sum_"))
    own = cells.join(m, "j").groupBy("i", "q", "nq").agg(F.sum(F.col("b") * F.col("m")).alias("bm"), F.sum("b").alias("s")).join(sums, "q")
    value = F.when(F.col("sum_") > TINY, F.col("bm") / F.col("sum_")).otherwise(F.col("s") / F.col("nq"))
    return own.select(F.col("i").alias("feature"), F.col("q").alias("species"), value.alias("synergy"))
