"""Usage reports: one row a species with its usage and its teammates' weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPORT = "struct<info:struct<metagame:string,cutoff:double,`number of battles`:long>,data:map<string,struct<usage:double,Teammates:map<string,double>>>>"


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """(metagame, cutoff, battles, name, usage, teammates) of JSON reports, one file a metagame."""
    files = spark.read.text(path, wholetext=True).select(F.from_json("value", _REPORT).alias("r"))
    about = [F.col("r.info.metagame").alias("metagame"), F.col("r.info.cutoff").cast("int").alias("cutoff"), F.col("r.info.`number of battles`").alias("battles")]
    rows = files.select(*about, F.explode("r.data").alias("name", "e"))
    return rows.select("metagame", "cutoff", "battles", "name", F.col("e.usage").alias("usage"), F.col("e.Teammates").alias("teammates"))


def usage_vocabulary(usage: DataFrame, least: float = 0.0) -> DataFrame:
    """Species of at least that usage, most used first, ties by name."""
    return usage.where(F.col("usage") >= least).select("name", "usage").orderBy(F.desc("usage"), "name")


def usage_cooccurrence(usage: DataFrame, vocab: DataFrame) -> DataFrame:
    """(i, j, weight) in both directions, as reported, where both names are in ``vocab`` (name)."""
    known = vocab.select("name")
    rows = usage.join(known, "name", "left_semi").select(F.col("name").alias("i"), F.explode("teammates").alias("j", "weight"))
    return rows.join(known.toDF("j"), "j", "left_semi").select("i", "j", "weight")
