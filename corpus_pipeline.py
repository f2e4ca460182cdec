"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.llm import jaccard_join, language_id, line_dedup, mixing, packing
from lineupkit.runtime import stash, table

#: A document goes if no language of the model reaches this probability.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents written in a known language.

    Texts that are null, without a letter, or like no learned language go.  Where no row has a
    label nothing can be learned, and only texts without a letter go.
    """
    net = language_id.fit(docs.where(~language_id.held_out()).select("text", "lang"))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = [f"c{i}_" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    found = language_id.identify(docs.toDF(*names).withColumnRenamed(at["text"], "text"), net)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in at.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three documents share, but in the last; a document left blank goes."""
    found = line_dedup.drop_shared_lines(docs)
    n = len(docs.columns)
    own = [f"c{i}_" for i in range(n)]
    found = found.toDF(*own, "lines_", "dropped_", "kept_").where((F.col("dropped_") == 0) | F.col("kept_").rlike(r"\S"))
    changed = F.col("dropped_") > 0
    at = dict(zip(docs.columns, own, strict=True))
    new = {"text": F.col("kept_"), "n_chars": F.length("kept_").cast("long")}
    return found.select(*[(F.when(changed, new[c]).otherwise(F.col(k)) if c in new else F.col(k)).alias(c) for c, k in at.items()])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Decisions are by row, not by doc_id: a row is known by doc_id and text, rows without doc_id come
    after all others, and of rows that share a doc_id that with the smaller hash of its text stays.  Of rows
    equal in doc_id and text one stays.  Null and blank texts are copies of nothing and all stay.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"),
    )
    found = jaccard_join.near_duplicates(docs.select(key.alias("doc_id"), "text"), n=5, percent=80)
    known = found.where("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("rows_"), F.first("component_id").alias("first_"))
    verdicts = known.select(F.col("doc_id").alias("key_"), (F.col("doc_id") == F.col("first_")).alias("stays_"), "rows_")
    verdicts = stash(verdicts.where("NOT stays_ OR rows_ > 1"), "copies")
    names = [f"c{i}_" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)], key.alias("row_"))
    one = rows.join(verdicts, rows["row_"] == F.col("key_"), "left_anti").select(*names)
    # Rows equal in doc_id and text: one of them, by its other columns.
    repeated = rows.join(verdicts.where("stays_"), rows["row_"] == F.col("key_"), "left_semi")
    least = F.min_by(F.struct(*names), F.to_json(F.struct(*[n for c, n in zip(docs.columns, names, strict=True) if c != "text"])))
    repeated = repeated.groupBy("row_").agg(least.alias("least_")).select("least_.*")
    return one.unionByName(repeated).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn to the sources' target weights, repeated where a source is short.

    A null text has no words and is never drawn; null is a source of its own; rows alike in doc_id and text are
    dealt alike; without words nothing is drawn.
    """
    mixed = mixing.mix(docs, whole_documents=True)
    own = [f"c{i}_" for i in range(len(docs.columns))]
    mixed = mixed.toDF(*own, "size_", "source_size_", "target_", "taken_", "draws")
    return mixing.emit(mixed, own).select(*[F.col(k).alias(c) for c, k in zip(docs.columns, own, strict=True)])


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of windows of at most 4,096 ids, with their ids.

    A null text is the end id alone; null and repeated doc_ids are packed each row on its own.
    """
    return packing.pack_documents(docs, block_tokens=4_000_000, with_ids=True, table_words=200_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("windows", windows),
]
#: Language ID by a trained network cannot be said in SQL; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
