"""Fitted models on disk: tables with a line of metadata, the list of models, and the triangle order of couplings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.operators.corpus import mirrored
from lineupkit.runtime import remove_path

VERSION = 1
TABLES = ["fields", "couplings", "team_counts"]
_META = "version int, id string, type string, regulation string, V long, n_corpus_teams long, team_size int"


def write_model(tables: dict[str, DataFrame], path: str, meta: dict, force: bool = False) -> None:
    """Write fields (feature, h, m), couplings (i, j, coupling) and team_counts, then the metadata; without ``force`` an existing model is an error.

    The metadata come last, and those of an overwritten model go first, so a model that was cut short is never listed.
    """
    spark = next(iter(tables.values())).sparkSession
    if set(tables) != set(TABLES):
        raise ValueError(f"a model has the tables {TABLES}")
    if force:
        remove_path(spark, f"{path}/meta")
    for name in TABLES:
        tables[name].write.mode("overwrite" if force else "error").parquet(f"{path}/{name}")
    line = json.dumps({"version": VERSION, **meta, "V": spark.read.parquet(f"{path}/fields").count()})
    spark.sql("SELECT :line AS value", args={"line": line}).coalesce(1).write.mode("overwrite" if force else "error").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of one model, or of all below a pattern."""
    return spark.read.schema(_META).json(f"{path}/meta")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a model, couplings in both directions; another version is an error."""
    meta = read_meta(spark, path).first()
    if meta is None or meta.version != VERSION:
        raise ValueError(f"{path} is no model of version {VERSION}")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return out | {"couplings": mirrored(out["couplings"], "coupling")}


def manifest(models: DataFrame, preferred: str, default: str | None = None) -> DataFrame:
    """``models`` (id, ...) with ``is_default``, the default first: as given (an error if unknown), else the preferred, else the first id."""
    marks = models.agg(F.max((F.col("id") == F.lit(default or preferred)).cast("int")).alias("has_"), F.min("id").alias("first_"))
    unknown = F.raise_error(F.lit(f"no model {default}")).cast("string")
    chosen = F.when(F.col("has_") == 1, F.lit(default or preferred)).otherwise(unknown if default is not None else F.col("first_"))
    rows = models.crossJoin(F.broadcast(marks)).withColumn("is_default", F.col("id") == chosen).drop("has_", "first_")
    return rows.orderBy(F.desc("is_default"), "id")


def pack_triangle(couplings: DataFrame, ids: DataFrame) -> DataFrame:
    """(position, value): couplings at their place in the strict lower triangle, row by row; what is absent is 0.

    ``ids`` (feature, feature_id) counts from 0.
    """
    a, b = (ids.select(F.col("feature").alias(k), F.col("feature_id").cast("long").alias(f"{k}_")) for k in "ij")
    low, high = F.least("i_", "j_"), F.greatest("i_", "j_")
    return couplings.join(a, "i").join(b, "j").select((F.expr("greatest(i_, j_) * (greatest(i_, j_) - 1) div 2") + low).alias("position"), F.col("coupling").cast("float").alias("value")).where(high > low)


def unpack_triangle(packed: DataFrame, ids: DataFrame) -> DataFrame:
    """(i, j, coupling) of packed couplings, i before j by id; a position beyond the triangle is an error."""
    root = F.floor((1 + F.sqrt(1.0 + 8.0 * F.col("position"))) / 2)
    # The root may be off by one for large positions.
    row = F.when(root * (root - 1) / 2 > F.col("position"), root - 1).when((root + 1) * root / 2 <= F.col("position"), root + 1).otherwise(root)
    size = ids.agg(F.count("*").alias("v_"))
    placed = packed.withColumn("j_", row.cast("long")).crossJoin(F.broadcast(size))
    beyond = F.raise_error(F.lit("a position lies beyond the triangle")).cast("long")
    placed = placed.withColumn("j_", F.when(F.col("j_") < F.col("v_"), F.col("j_")).otherwise(beyond)).withColumn("i_", F.expr("position - j_ * (j_ - 1) div 2"))
    a, b = (ids.select(F.col("feature_id").cast("long").alias(f"{k}_"), F.col("feature").alias(k)) for k in "ij")
    return placed.join(a, "i_").join(b, "j_").select("i", "j", F.col("value").cast("double").alias("coupling"))
