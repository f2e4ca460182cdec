"""Statistics of scores and outcomes, and the completion test: ranks, quantiles, nulls, bootstrap, pseudo-likelihood.

Orders over whole tables go through ``running_sums`` (stretches of values), never through one task.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.operators.corpus import mirrored, pairs_of
from lineupkit.operators.evaluation import running_sums
from lineupkit.runtime import stash


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) drawn by hash from the parts, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def pooled_ranks(rows: DataFrame, value: str, width: float) -> DataFrame:
    """``rows`` with ``rank_<value>``: rank over the whole table, ties share their mean."""
    by = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c_"))
    run = running_sums(by, value, ["c_"], width)
    return rows.join(run.select(value, (F.col("c__below") + (F.col("c_") + 1) / 2).alias(f"rank_{value}")), value)


def quantiles(rows: DataFrame, value: str, at: list[float], width: float) -> DataFrame:
    """(q, value): linear quantiles of a whole column."""
    by = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c_"))
    total = by.agg(F.sum("c_").alias("n_"))
    run = running_sums(by, value, ["c_"], width).crossJoin(F.broadcast(total))
    asked = run.withColumn("q", F.explode(F.array(*map(F.lit, at))))
    place = F.col("q") * (F.col("n_") - 1)
    inside = lambda k: (k >= F.col("c__below")) & (k < F.col("c__below") + F.col("c_"))
    low, high = F.floor(place), F.ceil(place)
    part = F.when(inside(low), F.col(value) * (1 - (place - low))).otherwise(0.0) + F.when(inside(high), F.col(value) * (place - low)).otherwise(0.0)
    return asked.where(inside(low) | inside(high)).groupBy("q").agg(F.sum(part).alias("value"))


def quantile_bins(rows: DataFrame, value: str, outcome: str, bins: int, width: float) -> DataFrame:
    """Outcomes by equal-count bins of a value: n, mean, p10, p50, p90, spread, shares of at least .75 and .95."""
    known = rows.where(F.col(value).isNotNull() & F.col(outcome).isNotNull())
    edges = quantiles(known, value, [k / bins for k in range(1, bins)], width).agg(F.sort_array(F.collect_list("value")).alias("edges_"))
    binned = known.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges_", lambda e: e <= F.col(value))))
    o = F.col(outcome)
    p = lambda q: F.percentile(outcome, F.lit(q))
    return binned.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(o).alias("mean"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"),
        (p(0.9) - p(0.1)).alias("spread"), F.avg((o >= 0.75).cast("double")).alias("top75"), F.avg((o >= 0.95).cast("double")).alias("top95"),
    )


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, width: float) -> DataFrame:
    """One row: rank correlations of three columns, that of x and y given z, R² of y on x, on z and on both."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    for c in (x, y, z):
        ranked = pooled_ranks(ranked, c, width)
    r = ranked.agg(F.corr(f"rank_{x}", f"rank_{y}").alias("xy"), F.corr(f"rank_{x}", f"rank_{z}").alias("xz"), F.corr(f"rank_{z}", f"rank_{y}").alias("zy"))
    partial = (F.col("xy") - F.col("xz") * F.col("zy")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("zy") ** 2))
    both = (F.col("xy") ** 2 + F.col("zy") ** 2 - 2 * F.col("xy") * F.col("zy") * F.col("xz")) / (1 - F.col("xz") ** 2)
    return r.select("xy", "xz", "zy", partial.alias("partial"), (F.col("xy") ** 2).alias("r2_x"), (F.col("zy") ** 2).alias("r2_z"), both.alias("r2_both"))


def equal_windows(events: DataFrame, order: str, count: int) -> DataFrame:
    """``window`` of every event (one row each): equally many, the last takes what is left."""
    n = events.agg(F.floor(F.count("*") / count).alias("size_"))
    placed = events.withColumn("k_", F.row_number().over(Window.orderBy(order)) - 1).crossJoin(F.broadcast(n))
    number = F.least(F.floor(F.col("k_") / F.greatest(F.col("size_"), F.lit(1))), F.lit(count - 1))
    return placed.select(*events.columns, number.cast("int").alias("window"))


def newest_held_out(sizes: DataFrame, order: str, share: float) -> DataFrame:
    """``held_out`` for (order, n): the newest events until they hold ``share`` of all."""
    newer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("newer_", newer).crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("t_")))).select(*sizes.columns, (F.col("newer_") < F.col("t_") * share).alias("held_out"))


def random_split(rows: DataFrame, key: str, share: float) -> DataFrame:
    """``test`` for exactly round(n share) rows with the smallest hashes of their key (unique)."""
    hashed = rows.withColumn("u_", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 13), 16, 10).cast("long"))
    by = hashed.groupBy("u_").agg(F.count("*").alias("c_"))
    run = running_sums(by, "u_", ["c_"], float(1 << 42)).select("u_", F.col("c__below").alias("below_"))
    size = rows.agg(F.bround(F.count("*") * share).alias("size_"))
    return hashed.join(run, "u_").crossJoin(F.broadcast(size)).select(*rows.columns, (F.col("below_") < F.col("size_")).alias("test"))


def dealt_correlations(rows: DataFrame, event: str, key: str, x: str, y: str, replicates: int) -> DataFrame:
    """(replicate, r): correlation of ``x`` with ``y`` dealt anew among each event's rows: in order of ``key`` they take the values in order of a hash.

    ``key`` is unique.  Rows are shuffled once, by event, and copied for no replicate: means and deviations stay as they are, so an event
    gives a sum of products for each.  An event's numbers stand in one task.
    """
    known = rows.where(F.col(event).isNotNull() & F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    c = [F.avg(x).alias("x_"), F.avg(y).alias("y_"), (F.count("*") * F.stddev_pop(x) * F.stddev_pop(y)).alias("d_")]
    whole = known.agg(*c)
    name, runs = F.col(key).cast("string").alias("name_"), [f"{r}|".encode() for r in range(1, replicates + 1)]
    centred = known.crossJoin(F.broadcast(whole)).select(event, key, name, (F.col(x) - F.col("x_")).alias("x_"), (F.col(y) - F.col("y_")).alias("y_"))

    def work(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(key)
        xs, ys, names = own["x_"].to_numpy(), own["y_"].to_numpy(), [n.encode() for n in own["name_"]]
        sums = []
        for run in runs:
            draw = np.frombuffer(b"".join([md5(run + n).digest() for n in names]), ">u8").reshape(-1, 2)
            sums.append(float(xs @ ys[np.lexsort((draw[:, 1], draw[:, 0]))]))
        return pd.DataFrame({"replicate": np.arange(1, len(runs) + 1, dtype=np.int32), "s_": sums})

    # Events are few: a fixed number of tasks keeps them from being put together.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = centred.repartition(tasks, event).groupBy(event).applyInPandas(work, "replicate int, s_ double")
    return sums.groupBy("replicate").agg(F.sum("s_").alias("s_")).crossJoin(F.broadcast(whole)).select("replicate", F.when(F.col("d_") > 0, F.col("s_") / F.col("d_")).alias("r"))


def bootstrap(rows: DataFrame, key: str, delta: str, replicates: int) -> DataFrame:
    """(replicate, delta): means of resampled rows, each row counted a Poisson(1) number of times drawn by hash."""
    many = rows.select(key, delta, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = uniform(F.col("replicate").cast("string"), F.col(key).cast("string"))
    times = F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda p: p <= u))
    drawn = many.withColumn("w_", times).where("w_ > 0")
    return drawn.groupBy("replicate").agg((F.sum(F.col("w_") * F.col(delta)) / F.sum("w_")).alias("delta"))


#: P(at most k) of a Poisson variable with mean 1.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def leave_out(members: DataFrame, k: int, least: int) -> DataFrame:
    """(team_id, feature, held_out): ``k`` members of every team of at least ``least``, drawn by hash."""
    draw = F.md5(F.concat_ws("|", F.col("team_id").cast("string"), "feature"))
    team = Window.partitionBy("team_id")
    placed = members.select("team_id", "feature", F.row_number().over(team.orderBy(draw)).alias("k_"), F.count("*").over(team).alias("n_"))
    return placed.where(F.col("n_") >= least).select("team_id", "feature", (F.col("k_") <= k).alias("held_out"))


def marginal_ranks(problems: DataFrame, counts: DataFrame) -> DataFrame:
    """(team_id, truth, rank): 1 + features not held in that are more frequent; no team meets the vocabulary."""
    order = counts.select("feature", F.col("n"), F.rank().over(Window.orderBy(F.desc("n"))).alias("r_"))
    truth = problems.where("held_out").join(order, "feature").select("team_id", F.col("feature").alias("truth"), F.col("n").alias("n_true"), "r_")
    known = problems.where(~F.col("held_out")).join(order, "feature").select("team_id", "n")
    above = truth.join(known, "team_id", "left").groupBy("team_id", "truth", "r_").agg(F.sum(F.when(F.col("n") > F.col("n_true"), 1).otherwise(0)).alias("a_"))
    return above.select("team_id", "truth", (F.col("r_") - F.col("a_")).alias("rank"))


def cooccurrence_ranks(problems: DataFrame, counts: DataFrame, value: str = "n") -> DataFrame:
    """(team_id, truth, rank): 1 + features not held in that meet the held ones more often; unmet ones score 0 and are never above.

    ``value`` is what is summed over the held ones (counts, or shifted PPMI), not negative."""
    held = problems.where(~F.col("held_out")).select("team_id", F.col("feature").alias("j"))
    met = held.join(mirrored(counts, value), "j").groupBy("team_id", "i").agg(F.round(F.sum(value), 9).alias("score"))
    met = met.join(held.toDF("team_id", "i"), ["team_id", "i"], "left_anti")
    truth = problems.where("held_out").select("team_id", F.col("feature").alias("truth"))
    own = truth.join(met.toDF("team_id", "truth", "own"), ["team_id", "truth"], "left").fillna(0, ["own"])
    above = own.join(met, "team_id", "left").groupBy("team_id", "truth").agg(F.sum(F.when(F.col("score") > F.col("own"), 1).otherwise(0)).alias("a_"))
    return above.select("team_id", "truth", (F.col("a_") + 1).alias("rank"))


def masked_ranks(problems: DataFrame, features: DataFrame) -> DataFrame:
    """(team_id, truth, valid, rank): by frequency among features that share no species or item with the held ones, and the truth.

    ``features`` (feature, species, item, n) is a vocabulary, held by every row as one array.
    """
    named = problems.join(features, "feature")
    held = named.where(~F.col("held_out")).groupBy("team_id").agg(F.collect_set("species").alias("s_"), F.collect_set("item").alias("t_"))
    vocab = features.agg(F.collect_list(F.struct("feature", "species", "item", "n")).alias("all_"))
    rows = named.where("held_out").select("team_id", F.col("feature").alias("truth"), F.col("n").alias("own")).join(held, "team_id").crossJoin(F.broadcast(vocab))
    free = lambda f: ~F.array_contains("s_", f["species"]) & ~F.coalesce(F.array_contains("t_", f["item"]), F.lit(False)) & (f["feature"] != F.col("truth"))
    valid = F.filter("all_", free)
    above = F.size(F.filter(valid, lambda f: f["n"] > F.col("own")))
    return rows.select("team_id", "truth", (F.size(valid) + 1).alias("valid"), (above + 1).alias("rank"))


def ranking_metrics(ranks: DataFrame) -> DataFrame:
    """One row: n, hit1, hit5, hit10, mrr."""
    hit = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"hit{k}")
    return ranks.agg(F.count("*").alias("n"), hit(1), hit(5), hit(10), F.avg(1.0 / F.col("rank")).alias("mrr"))


def pseudo_likelihood(members: DataFrame, fields: DataFrame, couplings: DataFrame) -> DataFrame:
    """(team_id, pll): Σ_i ln P(s_i | rest).  Features without a coupling to the team share one sum, so a team has a row for
    each feature that it touches, not for the vocabulary.

    A member touches itself as well, without a coupling, so one grouping has both: members that are dealt by team meet a short
    model and are summed where they are.
    """
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    h = fields.select("feature", "h")
    base = h.agg(F.sum(soft(F.col("h"))).alias("base_"))
    known = fields.select(F.col("feature").alias("j"))
    touch = mirrored(couplings, "coupling").join(known, "j", "left_semi").select("j", "i", "coupling", F.lit(0).alias("on_"))
    touch = touch.unionByName(known.select("j", F.col("j").alias("i"), F.lit(0.0).alias("coupling"), F.lit(1).alias("on_")))
    met = members.select("team_id", F.col("feature").alias("j")).join(touch, "j")
    both = met.groupBy("team_id", "i").agg(F.sum("coupling").alias("pull"), F.max("on_").alias("on_")).join(h.toDF("i", "h"), "i")
    z = F.col("h") + F.col("pull")
    sums = both.groupBy("team_id").agg(F.sum(F.when(F.col("on_") == 1, z).otherwise(0.0) - soft(z) + soft(F.col("h"))).alias("d_"))
    return sums.crossJoin(F.broadcast(base)).select("team_id", (F.col("d_") - F.col("base_")).alias("pll"))


def last_slices(windows: DataFrame, slices: int) -> DataFrame:
    """(event, last): every event of the last 1, 2, ... ``slices`` windows, for sweeps over the length of the training time.

    ``windows`` (event, window) counts windows from 0 to ``slices`` - 1; one row an event, so a sweep repeats rows ``slices`` times at most.
    """
    return windows.select("event", F.explode(F.sequence(F.lit(slices) - F.col("window"), F.lit(slices))).alias("last"))


def third_moments(members: DataFrame, weights: DataFrame, top: int) -> DataFrame:
    """(i, j, k, c3, se, z) for all triples of the ``top`` most weighted features (ties by name): connected third moment, its error, their quotient.

    The error is the root of Σ W² (E[(x-m)²(y-m)²(z-m)²] - c3²), W the weights over their sum.  Indicators make every centred
    product a sum of raw moments, so teams are met once, for pairs and triples of what they hold of the top features.
    """
    if not 3 <= top <= 200:
        raise ValueError("top must lie from 3 to 200")
    sums = weights.agg(F.sum("w").alias("all_"), (F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), 2)).alias("w2_"))
    known = members.join(weights, "team_id")
    first = known.groupBy("feature").agg(F.sum("w").alias("s_")).orderBy(F.desc(F.round("s_", 9)), "feature").limit(top)
    m = first.crossJoin(F.broadcast(sums)).select("feature", (F.col("s_") / F.col("all_")).alias("m"))
    m = F.broadcast(stash(m, "third-moments"))  # at most ``top`` rows
    held = known.join(m.select("feature"), "feature").groupBy("team_id", "w").agg(F.sort_array(F.collect_set("feature")).alias("r"))
    rest = lambda k: F.slice("r", k + 2, F.size("r"))
    pair = F.transform("r", lambda x, k: F.transform(rest(k), lambda y: F.array(x, y)))
    triple = F.transform("r", lambda x, k: F.transform(pairs_of(rest(k)), lambda p: F.array(x, p["i"], p["j"])))
    sets = held.select("w", F.explode(F.concat(F.flatten(pair), F.flatten(triple))).alias("key"))
    raw = sets.groupBy("key").agg(F.sum("w").alias("s_")).crossJoin(F.broadcast(sums)).select("key", (F.col("s_") / F.col("all_")).alias("p"))
    raw = stash(raw, "third-moments-raw")  # at most a table of ``top`` to the third power
    a, b, c = (m.toDF(f, f"m{f}") for f in "ijk")
    out = a.join(b, F.col("i") < F.col("j")).join(c, F.col("j") < F.col("k")).crossJoin(F.broadcast(sums.select("w2_")))
    for name, key in (("pij", "ij"), ("pik", "ik"), ("pjk", "jk"), ("t", "ijk")):
        out = out.withColumn("key", F.array(*key)).join(raw.withColumnRenamed("p", name), "key", "left").drop("key").fillna(0.0, [name])
    x, y, z = (F.col(f"m{f}") for f in "ijk")
    c3 = F.col("t") - x * F.col("pjk") - y * F.col("pik") - z * F.col("pij") + 2 * x * y * z
    (ai, bi), (aj, bj), (ak, bk) = ((1 - 2 * v, v * v) for v in (x, y, z))
    square = ai * aj * ak * F.col("t") + ai * aj * bk * F.col("pij") + ai * bj * ak * F.col("pik") + bi * aj * ak * F.col("pjk")
    square = square + ai * x * bj * bk + aj * y * bi * bk + ak * z * bi * bj + bi * bj * bk
    se = F.sqrt(F.greatest(F.col("w2_") * (square - c3 * c3), F.lit(0.0)))
    out = out.select("i", "j", "k", c3.alias("c3"), se.alias("se"))
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("c3") / F.col("se")))


def calibration(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(kind, n, r, mae): moments (i, j, p, i = j for first ones) of two samples: ``marginal``, and ``connected`` p - m m for pairs.

    Pairs that one side never saw have p = 0 there; features that a side lacks leave.
    """

    def connected(moments: DataFrame) -> DataFrame:
        m = moments.where("i = j").select(F.col("i").alias("f_"), F.col("p").alias("m_"))
        both = moments.where("i <> j").join(m.toDF("i", "a_"), "i").join(m.toDF("j", "b_"), "j")
        return both.select("i", "j", "p", (F.col("p") - F.col("a_") * F.col("b_")).alias("c"))

    a, b = (x.where("i = j").select(F.col("i").alias("feature"), F.col("p").alias(n)) for x, n in ((ours, "a"), (theirs, "b")))
    first = a.join(b, "feature")
    inside = first.select("feature")
    both = connected(ours).select("i", "j", F.col("c").alias("ca")).join(connected(theirs).select("i", "j", F.col("c").alias("cb")), ["i", "j"], "full")
    both = both.join(inside.toDF("i"), "i", "left_semi").join(inside.toDF("j"), "j", "left_semi")
    left, right = (first.select(F.col("feature").alias(k), F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}")) for k in "ij")
    both = both.join(left, "i").join(right, "j")
    pairs = both.select(F.coalesce("ca", -F.col("ai") * F.col("aj")).alias("a"), F.coalesce("cb", -F.col("bi") * F.col("bj")).alias("b"))
    rows = first.select(F.lit("marginal").alias("kind"), "a", "b").unionByName(pairs.select(F.lit("connected").alias("kind"), "a", "b"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))


def popularity_field(m: Column) -> Column:
    """Logit of a marginal, kept off 0 and 1: the field of a model without couplings."""
    p = F.least(F.greatest(m, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.ln(p / (1 - p))


def swept_metrics(problems: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Ranking metrics of every setting ``keys`` of a sweep; ``counts`` (keys, feature, n) scores the features in that setting.

    Ranks are as in ``marginal_ranks`` (n equal to nine digits is a tie); a truth that a setting never saw is left out there.
    """
    n = F.round("n", 9)
    order = counts.select(*keys, "feature", n.alias("n"), F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(n))).alias("r_"))
    truth = problems.where("held_out").join(order, "feature").select(*keys, "team_id", F.col("feature").alias("truth"), F.col("n").alias("n_true"), "r_")
    known = problems.where(~F.col("held_out")).join(order, "feature").select(*keys, "team_id", "n")
    above = truth.join(known, [*keys, "team_id"], "left").groupBy(*keys, "team_id", "truth", "r_").agg(F.sum(F.when(F.col("n") > F.col("n_true"), 1).otherwise(0)).alias("a_"))
    rank = F.col("r_") - F.col("a_")
    hit = lambda k: F.avg((rank <= k).cast("double")).alias(f"hit{k}")
    return above.groupBy(*keys).agg(F.count("*").alias("n"), hit(1), hit(5), hit(10), F.avg(1.0 / rank).alias("mrr"))
