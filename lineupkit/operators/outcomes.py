"""Matches and what they say: nulls by flipped winners over slices of rounds, pair support by matches played, overlaps of rankings.

Replicates are columns, not copies of the rows: a row is read once and every replicate is one more sum beside the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineupkit.operators.corpus import pairs_of
from lineupkit.sources.domain import rosters


def flipped(match: Column, replicate: int) -> Column:
    """Whether a match's winner and loser change places in a replicate: one bit of a hash."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(replicate)), match.cast("string"))), 1, 1) < "8"


def match_icc(sides: DataFrame, slices: dict[str, Column], replicates: int, least: int = 0) -> DataFrame:
    """(slice, matches, groups, n, icc, null_mean, null_sd, excess): agreement of outcomes within groups, by slice.

    ``sides`` (match_id, round, key, won) has two rows a match; groups are the sides of one ``key``, of which those with two
    sides at least count.  The null flips whole matches; ``excess`` is in its deviations.  A slice is a condition on ``round``;
    slices of fewer than ``least`` matches have no row, and where a correlation is undefined it is null.  Sides are summed by
    key and round first, so a slice adds up short rows and no key meets in one task as a whole.
    """
    runs = range(replicates + 1)  # run 0 is what was observed
    won = F.col("won").cast("boolean")
    value = [won.cast("long"), *[(won != flipped(F.col("match_id"), r)).cast("long") for r in runs[1:]]]
    known = sides.where(F.col("key").isNotNull() & F.col("won").isNotNull() & F.col("match_id").isNotNull())
    short = known.groupBy("key", "round").agg(F.count("*").alias("k"), *[F.sum(v).alias(f"s{r}") for r, v in enumerate(value)])
    names = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]), lambda x: x.isNotNull())
    cut = short.withColumn("slice", F.explode(names))
    per = cut.groupBy("slice", "key").agg(F.sum("k").alias("k"), *[F.sum(f"s{r}").alias(f"s{r}") for r in runs])
    big = F.col("k") >= 2
    only = lambda c: F.sum(F.when(big, c).otherwise(0))
    k = F.col("k")
    sums = per.groupBy("slice").agg(
        (F.sum("k") / 2).cast("long").alias("matches"), F.sum(big.cast("long")).alias("groups"), only(k).alias("n"), only(k * k).alias("kk"),
        *[only(F.col(f"s{r}")).alias(f"s{r}") for r in runs], *[only(F.col(f"s{r}") * F.col(f"s{r}") / k).alias(f"q{r}") for r in runs],
    )

    def icc(r: int) -> Column:
        s, q = F.col(f"s{r}"), F.col(f"q{r}")  # outcomes are 0 or 1, so they are their own squares
        between = (q - s * s / F.col("n")) / F.nullif(F.col("groups") - 1, F.lit(0))
        within = (s - q) / F.nullif(F.col("n") - F.col("groups"), F.lit(0))
        size = (F.col("n") - F.col("kk") / F.col("n")) / F.nullif(F.col("groups") - 1, F.lit(0))
        below = between + (size - 1) * within
        return F.when(below > 1e-12, (between - within) / below)

    nulls = F.filter(F.array(*[icc(r) for r in runs[1:]]), lambda x: x.isNotNull())
    rows = sums.where(F.col("n") > 0).where(F.col("matches") >= least).select("slice", "matches", "groups", "n", icc(0).alias("icc"), nulls.alias("nulls"))
    total = lambda f: F.aggregate("nulls", F.lit(0.0), lambda a, x: a + f(x))
    rows = rows.withColumn("null_mean", F.when(F.size("nulls") > 0, total(lambda x: x) / F.size("nulls")))
    rows = rows.withColumn("null_sd", F.sqrt(total(lambda x: (x - F.col("null_mean")) * (x - F.col("null_mean"))) / F.size("nulls")))
    excess = F.when(F.col("null_sd") > 0, (F.col("icc") - F.col("null_mean")) / F.col("null_sd"))
    return rows.select("slice", "matches", "groups", "n", "icc", "null_mean", "null_sd", excess.alias("excess"))


def played_pairs(members: DataFrame, sides: DataFrame) -> DataFrame:
    """(i, j, n): pairs of features, a team counted once for each match that it played."""
    played = sides.groupBy("team_id").agg(F.count("*").alias("w_"))
    pairs = rosters(members).join(played, "team_id").select("w_", F.inline(pairs_of(F.col("roster"))).alias("i", "j"))
    return pairs.groupBy("i", "j").agg(F.sum("w_").alias("n"))


def contingency(rows: DataFrame, row: str, column: str, max_columns: int = 1_000) -> DataFrame:
    """Counts of every value of ``column`` (in order, at most ``max_columns``, else an error) as columns, by ``row``; nulls are left out."""
    values = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(max_columns + 1).collect()]
    if len(values) > max_columns:
        raise ValueError(f"more than {max_columns} columns")
    return rows.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def site_appearances(members: DataFrame, top: int) -> DataFrame:
    """(species, teams, rosters, rank, roster, n): teams and distinct rosters that hold a site in any form, and its ``top`` rosters.

    ``members`` (team_id, species, feature); a team that holds two features of a site counts once.
    """
    kept = members.groupBy("team_id").agg(F.collect_set("species").alias("sites"), F.array_join(F.sort_array(F.collect_set("feature")), " - ").alias("roster"))
    counts = kept.groupBy("roster").agg(F.first("sites").alias("sites"), F.count("*").alias("n"))  # a roster tells its sites
    by_site = counts.select(F.explode("sites").alias("species"), "roster", "n")
    sums = by_site.groupBy("species").agg(F.sum("n").alias("teams"), F.count("*").alias("rosters"))
    order = Window.partitionBy("species").orderBy(F.desc("n"), "roster")
    first = by_site.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(sums, "species").select("species", "teams", "rosters", "rank", "roster", "n")


def top_pairs(pairs: DataFrame, value: str, top: int, keys: list[str] | None = None) -> DataFrame:
    """The ``top`` pairs at either end of ``value``: (keys, positive, rank, i, j, value); equal to nine digits is a tie, which names decide."""
    keys = keys or []
    both = pairs.where(F.col(value).isNotNull()).withColumn("positive", F.explode(F.array(F.lit(True), F.lit(False))))
    place = F.round(F.when(F.col("positive"), -F.col(value)).otherwise(F.col(value)), 9)
    order = Window.partitionBy(*keys, "positive").orderBy(place, "i", "j")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, common, either, jaccard) of two short lists of pairs."""
    both = a.select(*by, "i", "j").withColumn("a_", F.lit(1)).join(b.select(*by, "i", "j").withColumn("b_", F.lit(1)), [*by, "i", "j"], "full")
    common = F.sum((F.col("a_").isNotNull() & F.col("b_").isNotNull()).cast("long"))
    return both.groupBy(*by).agg(common.alias("common"), F.count("*").alias("either"), (common / F.count("*")).alias("jaccard"))


def smoothed_couplings(counts: DataFrame, singles: DataFrame, total: DataFrame, eps: list[float]) -> DataFrame:
    """(eps, i, j, coupling): log lift of every pair met, with ``eps`` added to each of the three shares.

    ``counts`` (i, j, n), ``singles`` (feature, n), ``total`` one row (n): the number of teams.
    """
    share = lambda c: F.col(c) / F.col("all_")
    both = counts.join(singles.toDF("i", "ni"), "i").join(singles.toDF("j", "nj"), "j").crossJoin(F.broadcast(total.toDF("all_")))
    both = both.withColumn("eps", F.explode(F.array(*map(F.lit, eps))))
    value = F.ln((share("n") + F.col("eps")) / ((share("ni") + F.col("eps")) * (share("nj") + F.col("eps"))))
    return both.select("eps", "i", "j", value.alias("coupling"))
