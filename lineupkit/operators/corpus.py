"""Weights, vocabularies, marginals, co-occurrence and what is derived from them.

Members are (team_id, feature) rows without repeats.  Pairs are formed inside a team's sorted array,
so one shuffle by team serves all pair tables, and counts are combined before theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.sources.domain import rosters


def weighed(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (team_id, ...) with their teams' weights.

    Both grow with the teams, and a stashed table's files are a small part of its rows, so size by files must not get either broadcast.
    """
    return rows.join(weights.hint("merge"), "team_id")


def _beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a single-row aggregate."""
    return df.crossJoin(F.broadcast(one_row))


def team_weights(teams: DataFrame, tau: float | None, in_person: float = 1.0) -> DataFrame:
    """(team_id, w): exponential recency in days times the in-person multiplier, mean 1.

    ``tau`` None leaves age out.  The newest day of the table is the reference; with ``tau`` a team without a day has
    no weight and no row.
    """
    if tau is not None and tau <= 0:
        raise ValueError("tau must be positive")
    teams = teams.where("day IS NOT NULL") if tau is not None else teams
    age = F.datediff(F.col("ref_"), F.col("day")) if tau is not None else F.lit(0)
    raw = _beside(teams, teams.agg(F.max("day").alias("ref_"))).select(
        "team_id", (F.exp(-age / F.lit(tau or 1.0)) * F.when(F.col("in_person"), in_person).otherwise(1.0)).alias("raw_")
    )
    total = raw.agg(F.sum("raw_").alias("sum_"), F.count("*").alias("n_"))
    return _beside(raw, total).select("team_id", (F.col("raw_") * F.col("n_") / F.col("sum_")).alias("w"))


def vocabulary(members: DataFrame, weights: DataFrame, cutoff: float, prior: DataFrame | None = None) -> DataFrame:
    """Features with raw and weighted count of at least ``cutoff``, and all of ``prior``; ids in order."""
    counts = weighed(members, weights).groupBy("feature").agg(
        F.count("*").alias("raw_count"), F.sum("w").alias("weighted_count")
    )
    kept = counts.where((F.col("raw_count") >= cutoff) & (F.col("weighted_count") >= cutoff))
    if prior is not None:
        kept = kept.select("feature").union(prior.select("feature")).distinct().join(counts, "feature", "left")
        kept = kept.fillna(0, ["raw_count", "weighted_count"])
    # A vocabulary is a short list: one partition orders it.
    return kept.withColumn("feature_id", F.row_number().over(Window.orderBy("feature")) - 1)


def marginals(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(feature, m): weighted share of all weighted teams, those without members included."""
    total = weights.agg(F.sum("w").alias("total_"))
    sums = weighed(members, weights).groupBy("feature").agg(F.sum("w").alias("sum_"))
    return _beside(sums, total).select("feature", (F.col("sum_") / F.col("total_")).alias("m"))


def pairs_of(roster: Column) -> Column:
    """All (i, j) with i before j of a sorted array."""
    return F.flatten(
        F.transform(roster, lambda x, k: F.transform(F.slice(roster, k + 2, F.size(roster)), lambda y: F.struct(x.alias("i"), y.alias("j"))))
    )


def team_pairs(members: DataFrame) -> DataFrame:
    """(team_id, i, j) for all pairs of a team's features, i < j."""
    return rosters(members).select("team_id", F.inline(pairs_of(F.col("roster"))).alias("i", "j"))


def cooccurrence(members: DataFrame) -> DataFrame:
    """(i, j, n): teams that hold both, i < j."""
    return team_pairs(members).groupBy("i", "j").agg(F.count("*").alias("n"))


def empirical_moments(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, j, p): weighted second moments, i <= j; the diagonal has the first moments."""
    total = weights.agg(F.sum("w").alias("total_"))
    pairs = team_pairs(members).unionByName(members.select("team_id", F.col("feature").alias("i"), F.col("feature").alias("j")))
    sums = weighed(pairs, weights).groupBy("i", "j").agg(F.sum("w").alias("sum_"))
    return _beside(sums, total).select("i", "j", (F.col("sum_") / F.col("total_")).alias("p"))


def mirrored(pairs: DataFrame, *values: str) -> DataFrame:
    """Both orders of every pair."""
    return pairs.select("i", "j", *values).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *values))


def shifted_ppmi(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(i, j, ppmi) of a pair-count table (i < j, n): max(ln(n N / (r_i r_j)) - ln shift, 0), N the full sum."""
    if shift <= 0:
        raise ValueError("shift must be positive")
    both = mirrored(counts, "n")
    rows = both.groupBy("i").agg(F.sum("n").alias("r"))
    # A negative count is an error; a table without any positive one has no rows.
    refused = F.raise_error(F.lit("counts must not be negative"))
    total = both.agg(F.when(F.min("n") < 0, refused.cast("double")).otherwise(F.sum("n")).alias("total_"))
    left = rows.select("i", F.col("r").alias("ri"))
    right = rows.select(F.col("i").alias("j"), F.col("r").alias("rj"))
    lift = F.ln(F.col("n") * F.col("total_") / (F.col("ri") * F.col("rj"))) - F.ln(F.lit(float(shift)))
    joined = _beside(counts.where("n > 0").join(left, "i").join(right, "j"), total)
    return joined.select("i", "j", F.greatest(lift, F.lit(0.0)).alias("ppmi"))


def binary_moments(usage: DataFrame, counts: DataFrame, team_size: int) -> DataFrame:
    """(i, j, mi, mj, p): usage as first moments, joint moments from counts scaled to a team size."""
    total = mirrored(counts, "n").agg(F.sum("n").alias("total_"))
    m = usage.select("feature", "m")
    both = counts.join(m.toDF("i", "mi"), "i").join(m.toDF("j", "mj"), "j")
    scale = F.col("n") * F.lit(team_size * (team_size - 1)) / F.col("total_")
    return _beside(both, total).select("i", "j", "mi", "mj", scale.alias("p"))


def binary_correlation(moments: DataFrame) -> DataFrame:
    """(i, j, corr): covariance of two indicators over their deviations; a constant one gives 0."""
    spread = F.sqrt(F.col("mi") * (1 - F.col("mi")) * F.col("mj") * (1 - F.col("mj")))
    value = F.when(spread > 0, (F.col("p") - F.col("mi") * F.col("mj")) / spread).otherwise(0.0)
    return moments.select("i", "j", value.alias("corr"))


def support_mask(counts: DataFrame, least: int) -> DataFrame:
    """Pairs with at least ``least`` teams."""
    return counts.where(F.col("n") >= least).select("i", "j")


def roster_counts(members: DataFrame) -> DataFrame:
    """(roster_key, n): how many teams have exactly this set."""
    keyed = rosters(members).select(F.array_join("roster", "-").alias("roster_key"))
    return keyed.groupBy("roster_key").agg(F.count("*").alias("n"))


def species_rollup(counts: DataFrame, site_of: DataFrame) -> DataFrame:
    """Pair counts summed over the features' sites; pairs within a site are left out."""
    a, b = site_of.toDF("i", "site_i"), site_of.toDF("j", "site_j")
    named = counts.join(a, "i").join(b, "j").where("site_i <> site_j")
    ordered = named.select(F.least("site_i", "site_j").alias("i"), F.greatest("site_i", "site_j").alias("j"), "n")
    return ordered.groupBy("i", "j").agg(F.sum("n").alias("n"))


def teammates(counts: DataFrame, appearances: DataFrame, top: int) -> DataFrame:
    """Each feature's ``top`` partners: count, share of the feature's teams, rank."""
    both = mirrored(counts.where("n > 0"), "n").join(appearances.toDF("i", "teams"), "i")
    order = Window.partitionBy("i").orderBy(F.desc("n"), "j")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("i", "j", "n", (F.col("n") / F.col("teams")).alias("share"), "rank")


def effective_size(weights: DataFrame) -> DataFrame:
    """(ess): squared sum over sum of squares."""
    return weights.agg((F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("ess"))


def align_prior(vocab: DataFrame, fields: DataFrame, couplings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A prior model's fields and couplings on a new vocabulary; what is new starts at 0."""
    h = vocab.select("feature").join(fields.select("feature", "h"), "feature", "left").fillna(0.0, ["h"])
    known = vocab.select("feature")
    kept = couplings.join(known.toDF("i"), "i", "left_semi").join(known.toDF("j"), "j", "left_semi")
    return h, kept


def support_census(pair_support: DataFrame, levels: list[int]) -> DataFrame:
    """(level, pairs): how many pairs have at least so many teams."""
    sums = [F.sum((F.col("n") >= k).cast("long")).alias(str(k)) for k in levels]
    wide = pair_support.agg(*sums)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("pairs")) for k in levels])))


def log_odds_model(members: DataFrame, weights: DataFrame, support: int = 10) -> tuple[DataFrame, DataFrame]:
    """A closed-form pairwise model: fields (feature, m, h = logit m) and couplings (i < j, j_ij).

    A coupling is ln(p_ij / (m_i m_j)) where at least ``support`` teams hold both, else absent.
    """
    m = marginals(members, weights)
    fields = m.where("m > 0 AND m < 1").select("feature", "m", F.ln(F.col("m") / (1 - F.col("m"))).alias("h"))
    total = weights.agg(F.sum("w").alias("total_"))
    # Teams are merged with their weights before their pairs are formed: there are fewer of them.
    pairs = weighed(rosters(members), weights).select("w", F.inline(pairs_of(F.col("roster"))).alias("i", "j")).groupBy("i", "j").agg(F.count("*").alias("n"), F.sum("w").alias("sum_"))
    pairs = _beside(pairs.where(F.col("n") >= support), total)
    both = pairs.join(fields.select("feature", "m").toDF("i", "mi"), "i").join(fields.select("feature", "m").toDF("j", "mj"), "j")
    return fields, both.select("i", "j", F.ln(F.col("sum_") / F.col("total_") / (F.col("mi") * F.col("mj"))).alias("coupling"))
