"""Splits, outcome statistics and block analysis of a fitted model, as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronological_split(sizes: DataFrame, order: str, share: float) -> DataFrame:
    """``cumulative`` and ``train`` added to (order, n): training ends at the first cumulative count of
    at least ``round(total * share)``, halves to even.  One row an event, so one window orders them."""
    run = sizes.withColumn("cumulative", F.sum("n").over(Window.orderBy(order)))
    total = sizes.agg(F.sum("n").alias("total_"))
    both = run.crossJoin(F.broadcast(total)).withColumn("train", F.col("cumulative") - F.col("n") < F.bround(F.col("total_") * share))
    return both.drop("total_")


def placement(teams: DataFrame, event: str, placing: str) -> DataFrame:
    """``placement`` from 1 (first) to 0 (the largest placing of the event); null where all have one placing."""
    field = F.max(placing).over(Window.partitionBy(event))
    return teams.withColumn("placement", F.when(field > 1, 1 - (F.col(placing) - 1) / (field - 1)))


def win_rate() -> Column:
    """Wins over all games of (wins, losses, ties); null without games."""
    games = F.col("wins") + F.col("losses") + F.col("ties")
    return F.when(games > 0, F.col("wins") / games)


def average_rank(value: str, by: str) -> Column:
    """Rank within ``by``; ties share their mean rank."""
    ties = F.count("*").over(Window.partitionBy(by, value))
    return F.rank().over(Window.partitionBy(by).orderBy(value)) + (ties - 1) / 2


def spearman_within(rows: DataFrame, event: str, x: str, y: str, least: int = 8) -> DataFrame:
    """(event, n, rho) of every event that has ``least`` rows with both values."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.select(event, average_rank(x, event).alias("rx"), average_rank(y, event).alias("ry"))
    return ranked.groupBy(event).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).where(F.col("n") >= least)


def running_sums(rows: DataFrame, value: str, sums: list[str], width: float) -> DataFrame:
    """Sums of ``sums`` over all smaller values (``<name>_below``) for a table with one row a value.

    Values are cut into stretches of ``width``: each is summed on its own, and only the stretches'
    totals are put in one order, so no task holds all values.
    """
    cut = rows.withColumn("stretch_", F.floor(F.col(value) / width))
    inner = Window.partitionBy("stretch_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("stretch_").agg(*[F.sum(c).alias(f"{c}_t") for c in sums])
    before = Window.orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stretch_", *[F.coalesce(F.sum(f"{c}_t").over(before), F.lit(0)).alias(f"{c}_b") for c in sums])
    both = cut.withColumns({f"{c}_i": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}).join(totals, "stretch_")
    return both.select(*rows.columns, *[(F.col(f"{c}_i") + F.col(f"{c}_b")).alias(f"{c}_below") for c in sums])


def auc(rows: DataFrame, score: str, positive: str, width: float = 0.01) -> DataFrame:
    """(auc): probability that a positive scores above a negative, ties count half."""
    by = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    won = running_sums(by, score, ["q"], width)
    wins = F.sum(F.col("p") * (F.col("q_below") + F.col("q") / 2))
    return won.agg((wins / (F.sum("p") * F.sum("q").cast("double"))).alias("auc"))


def icc(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, n, icc): one-way intraclass correlation over groups of two rows at least; null if undefined."""
    v = F.col(value)
    per = rows.where(v.isNotNull()).groupBy(group).agg(F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")).where("k >= 2")
    sums = per.agg(
        F.count("*").alias("g"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("kk"),
        F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("sk"),
    )
    between = (F.col("sk") - F.col("s") * F.col("s") / F.col("n")) / (F.col("g") - 1)
    within = (F.col("ss") - F.col("sk")) / (F.col("n") - F.col("g"))
    k0 = (F.col("n") - F.col("kk") / F.col("n")) / (F.col("g") - 1)
    below = between + (k0 - 1) * within
    return sums.select(F.col("g").alias("groups"), "n", F.when((F.col("g") >= 2) & (below > 0), (between - within) / below).alias("icc"))


def blocks(cells: DataFrame) -> DataFrame:
    """The known couplings of every species pair split into synergy (the block's mean), row and column effects and interaction.

    ``cells`` as ``operators.blocks.entries`` gives them; sums over known couplings are divided by the block's sides, so a pair
    without a coupling counts 0 and needs no row.
    """
    half = cells.where("p < q")
    whole = half.groupBy("p", "q").agg(F.sum("b").alias("s_"))
    row = half.groupBy("p", "q", "i").agg(F.sum("b").alias("r_"))
    col = half.groupBy("p", "q", "j").agg(F.sum("b").alias("c_"))
    named = half.join(whole, ["p", "q"]).join(row, ["p", "q", "i"]).join(col, ["p", "q", "j"])
    mean, r, c = F.col("s_") / (F.col("np") * F.col("nq")), F.col("r_") / F.col("nq"), F.col("c_") / F.col("np")
    return named.select(
        "p", "q", "i", "j", F.col("b").alias("coupling"), mean.alias("synergy"), (r - mean).alias("row"), (c - mean).alias("col"), (F.col("b") - r - c + mean).alias("inter")
    )
