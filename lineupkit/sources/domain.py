"""Rosters from the relational tables: an order is a team, its parts' brands and types are features.

``p_brand`` plays the species (site) and ``p_type`` the item; a team counts each feature once.
The month of the order date is the tournament, urgent orders are the in-person ones, and the
rank by total price within the month is the placing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineupkit.runtime import dealt, table, table_bytes


def _members(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """Distinct team_id and columns of its parts, dealt by team: what follows by team needs no shuffle of its own.

    Parts grow with the lines, so they are merged with them, not broadcast.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("team_id"), "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", *columns).hint("merge")
    size = table_bytes(spark, sf_dir, "lineitem")
    both = dealt(lines, "l_partkey", size).join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
    return dealt(both, "team_id", size).distinct()


def pair_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (team_id, species, item, feature); feature is ``species @ item``."""
    both = _members(spark, sf_dir, F.col("p_brand").alias("species"), F.col("p_type").alias("item"))
    return both.withColumn("feature", F.concat_ws(" @ ", "species", "item"))


def species_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (team_id, feature) with the species as the feature."""
    return _members(spark, sf_dir, F.col("p_brand").alias("feature"))


def rosters(members: DataFrame) -> DataFrame:
    """(team_id, roster): each team's features in order; a roster is a small set by its nature."""
    return members.groupBy("team_id").agg(F.sort_array(F.collect_set("feature")).alias("roster"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a team: day, month (tournament), in_person, price, placing within the month."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = orders.select(
        F.col("o_orderkey").alias("team_id"),
        F.to_date("o_orderdate").alias("day"),
        month.alias("month"),
        (F.col("o_orderpriority") == "1-URGENT").alias("in_person"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("player"),
    )
    by_price = Window.partitionBy("month").orderBy(F.desc("price"), "team_id")
    return rows.withColumn("placing", F.row_number().over(by_price))


#: The same tables in SQL, for the oracles.
MEMBERS_SQL = """
mem AS (SELECT DISTINCT l_orderkey AS team_id, p_brand AS feature
        FROM lineitem JOIN part ON l_partkey = p_partkey),
pmem AS (SELECT DISTINCT l_orderkey AS team_id, p_brand AS species, p_type AS item,
                p_brand || ' @ ' || p_type AS feature
         FROM lineitem JOIN part ON l_partkey = p_partkey),
teams AS (SELECT o_orderkey AS team_id, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month,
                 o_orderpriority = '1-URGENT' AS in_person, o_totalprice AS price, o_custkey AS player,
                 row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')
                                    ORDER BY o_totalprice DESC, o_orderkey) AS placing
          FROM orders)"""
