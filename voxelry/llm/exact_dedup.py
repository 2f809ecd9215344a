"""Exact duplicates by a heavy-hitter split.

Digests are computed once. A Misra-Gries summary (the frequent-items sketch behind Spark's
``approx_top_k``, merged map-side) proposes frequent digests; an exact map-side count verifies them; the
verified winners, a bounded table, are broadcast so that hot groups never shuffle. All other digests
are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import SPACE, free_names, text_or_empty, written

#: The summary tracks so many digests and proposes so many; both bound what is broadcast.
TRACKED, PROPOSED = 8192, 1000
#: A proposed digest is a winner from this many rows on; smaller groups are cheap to shuffle.
HOT_ROWS = 100


def digest(column: str = "text") -> Column:
    """SHA-256 of the text after each run of white space became one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), f"{SPACE}+", " "), 256))


def _winners(rows: DataFrame, tracked: int, proposed: int, hot_rows: int) -> DataFrame:
    """digest, n, first (of its rows) for each verified heavy hitter; at most ``proposed`` rows."""
    sketch = rows.agg(F.expr(f"approx_top_k(xxhash64(digest), {proposed}, {tracked})").alias("top"))
    likely = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") >= hot_rows).select(F.col("t.item").alias("h"))
    return (
        rows.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(likely), "h", "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
        .where(F.col("n") >= hot_rows)
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, proposed: int = PROPOSED, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. The row with the smallest id stays; null ids come
    last, and of rows with equal text and id exactly one stays. An empty table gives an empty result;
    extra columns are ignored, whatever their names.
    """
    unique = F.monotonically_increasing_id()
    rows = docs.select(
        digest(text_col).alias("digest"), F.struct(F.col(id_col).isNull().alias("null_id"), F.col(id_col).alias("id"), unique.alias("at")).alias("row")
    )
    rows = written(rows, "digests")
    winners = written(_winners(rows, tracked, proposed, hot_rows).coalesce(1), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners), "digest", "left_anti")
    # Grouped map-side first, so that a group beyond the broadcast ones does not gather its rows either.
    groups = cold.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    cold = cold.join(groups, "digest")
    return hot.unionByName(cold).select(
        F.col("row.id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the smallest id; all columns kept.

    Null and empty texts are equal. Survivors are found by id and digest, so rows that share an id but
    not a text are told apart; rows that share both are reduced to one. Which of these stays is not
    said, as their ids and texts agree. An empty table gives an empty result.
    """
    id_name, digest_name, many, own = free_names(docs, "kept_id", "kept_digest", "repeated", "own_digest")
    kept = exact_dedup(docs, **options)
    one = kept.groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    one = written(one.where("kept").select(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name), (F.col("n") > 1).alias(many)), "kept")
    marked = docs.withColumn(own, digest())
    found = marked.join(one, docs["doc_id"].eqNullSafe(F.col(id_name)) & (F.col(own) == F.col(digest_name)))
    repeated = one.where(many).limit(1).count() > 0
    single = found.where(~F.col(many)) if repeated else found
    out = single.unionByName(found.where(many).dropDuplicates(["doc_id", own])) if repeated else single
    return out.drop(id_name, digest_name, many, own)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
