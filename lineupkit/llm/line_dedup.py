"""Operator 8: drop lines that many documents share, keeping one holder of each.

Lines are exploded with their position, normalised and hashed (128 bits: two seeded xxhash64 values);
only hash, document and position are shuffled, never the lines.  Distinct documents are counted per
hash; positions to drop are gathered per document and the text is put together again from the other
positions, in order.

Hot lines: the count is aggregated before its shuffle, first by (hash, document); the join back is a
plain equi-join of two exchanges, which adaptive execution splits where a hash is hot.

Nulls and edge cases: a null or empty text is one empty line; rows that share a doc_id count as one
document, and each row keeps its own lines; a row without doc_id is left as it is and not counted;
an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineupkit.runtime import stash, table

#: The white space that a line's key is stripped of, and the letters it folds.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line stripped of outer blanks, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drop_shared_lines(docs: DataFrame, min_length: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``kept`` (text without its dropped lines), ``n_lines`` and ``n_dropped`` added.

    Only doc_id and text of ``docs`` are read for the decision; its own columns keep their values.
    """
    rows = docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("row_"), "text")
    lines = rows.where("id_ IS NOT NULL").select("id_", "row_", F.posexplode(lines_of(F.col("text"))).alias("pos_", "line_"))
    keyed = lines.select("id_", "row_", "pos_", line_key(F.col("line_")).alias("key_"))
    hashed = keyed.where(F.length("key_") >= min_length).select(
        "id_", "row_", "pos_", F.xxhash64("key_").alias("a_"), F.xxhash64(F.lit("second"), "key_").alias("b_")
    )
    # One row a (hash, document) first, so that a line of every document is counted in parallel.
    per_doc = hashed.groupBy("a_", "b_", "id_").agg(F.lit(1).alias("one_"))
    shared = (
        per_doc.groupBy("a_", "b_")
        .agg(F.count("*").alias("docs_"), F.max("id_").alias("keeper_"))
        .where(F.col("docs_") >= min_docs)
        .select("a_", "b_", "keeper_")
    )
    shared = stash(shared, "shared-lines")
    hit = hashed.join(shared, ["a_", "b_"]).where("id_ <> keeper_")
    drops = hit.groupBy("id_", "row_").agg(F.collect_set("pos_").alias("drop_"))

    names = [f"c{i}_" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    joined = plain.join(
        drops, (F.col(at["doc_id"]) == F.col("id_")) & (F.xxhash64(F.col(at["text"])) == F.col("row_")), "left"
    )
    # The lines are bound to a lambda's variable: split once a text, then picked by position.
    gone = F.coalesce(F.col("drop_"), F.array().cast("array<int>"))
    pick = F.transform(
        F.array(lines_of(F.col(at["text"]))),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n"),
            F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone),
                    lambda i: F.get(lines, i),
                ),
                "\n",
            ).alias("kept"),
        ),
    )
    out = joined.select(*names, F.size(gone).cast("long").alias("gone_"), F.inline(pick).alias("n_", "kept_"))
    own = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return out.select(*own, F.col("n_").alias("n_lines"), F.col("gone_").alias("n_dropped"), F.col("kept_").alias("kept"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that 3 documents hold stay in the last of them only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_shared_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, text, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.text, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, text
"""
