"""Exact deduplication by a content sort (DataFrame functions only).

Texts are equal when identical after replacing every run of white space by one space.
A sampled range partitioning over (short content prefix, content hash, salt) and one
external sort inside the partitions put equal texts beside each other; the window
operator then compares every row's whole normalised text with its neighbour's and keeps
the smallest identifier of each run.

Skew: contents are counted first by hash (map-side combined, no texts move).  A content
with at least max(64, rows / MAX_HOT) rows is hot.  There are at most MAX_HOT of those, so
their list has a proven bound and is broadcast; their rows are salted into runs of about
that many rows, and the run heads (at most two per that many rows) are merged afterwards.

Defined results: null text counts as empty, all empty texts are one group; a null
identifier sorts after every other; repeated rows (same identifier, same text) are
separate rows of one group of which exactly one is kept; an empty table gives no rows;
other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.llm.common import SPACE_CLASS, cut, table, text_of, unwrap

#: Most contents that can be hot; bounds the broadcast list.
MAX_HOT = 65_536
#: Contents with fewer rows are never split.
MIN_HOT = 64
#: Characters of the text that the sampled splitters see (whole texts are compared later).
SPLITTER_CHARS = 24


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry_text: bool = True) -> DataFrame:
    """One row per input row: __row (its columns), keep_id, group_size, kept, text_sha256.
    Without carry_text, __row holds only the identifier."""
    norm = lambda c: F.regexp_replace(c, SPACE_CLASS, " ")
    others = [c for c in docs.columns if c != text_col] if carry_text else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__rest"),
                       F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = (rows.withColumn("__norm", norm(text_of("__text")))
            .withColumn("__hash", F.xxhash64("__norm"))
            .withColumn("__head", F.substring("__norm", 1, SPLITTER_CHARS)).drop("__norm"))

    counts = rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    limit = F.greatest(F.lit(float(MIN_HOT)), F.col("__total") / F.lit(MAX_HOT))
    hot = (counts.filter(F.col("__n") >= MIN_HOT).crossJoin(F.broadcast(total))
           .filter(F.col("__n") >= limit)
           .select("__hash", F.ceil(F.col("__n") / limit).cast("int").alias("__salts")))

    salt = F.pmod(F.xxhash64("__id", F.spark_partition_id()), F.col("__salts")).cast("int")
    keyed = (rows.join(F.broadcast(hot), "__hash", "left")
             .withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(salt)))
    ranged = keyed.repartitionByRange("__head", "__hash", "__salt").withColumn("__norm", norm(text_of("__text")))

    # the range partitioning already clusters these keys: one sort, no further exchange
    run = Window.partitionBy("__head", "__hash", "__salt", "__norm")
    first = run.orderBy(F.col("__id").asc_nulls_last())
    carried = [F.col("__rest")] + ([F.col("__text")] if carry_text else [])
    marked = cut(ranged.withColumn("__pos", F.row_number().over(first))
                 .withColumn("__min", F.first("__id").over(first))
                 .withColumn("__size", F.count(F.lit(1)).over(run))
                 .select(*carried, "__salt", "__salts", "__pos", "__min", "__size",
                         F.sha2("__norm", 256).alias("text_sha256")))

    # heads of the runs of hot contents, at most 2 * MAX_HOT rows: the smallest identifier
    # wins, the lowest salt among equal ones
    least = F.min(F.struct(F.col("__min").isNull().alias("none"), F.col("__min").alias("id"),
                           F.col("__salt").alias("salt")))
    merged = (marked.filter("__salts IS NOT NULL AND __pos = 1").groupBy("text_sha256")
              .agg(least.alias("__first"), F.sum("__size").alias("__all")))
    joined = marked.join(F.broadcast(merged), "text_sha256", "left")
    single = F.col("__first").isNull()
    row = F.struct(*[(F.col("__text") if c == text_col else F.col("__rest").getField(c)).alias(c)
                     for c in (docs.columns if carry_text else [id_col])])
    return joined.select(
        row.alias("__row"),
        F.when(single, F.col("__min")).otherwise(F.col("__first.id")).alias("keep_id"),
        F.coalesce("__all", "__size").cast("long").alias("group_size"),
        ((F.col("__pos") == 1) & (single | (F.col("__salt") == F.col("__first.salt")))).alias("kept"),
        "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    marked = mark_copies(docs, id_col, text_col, carry_text=False)
    return marked.select(F.col("__row").getField(id_col).alias("doc_id"), "keep_id", "group_size", "kept",
                         "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows whose text another row with a smaller identifier has."""
    return unwrap(mark_copies(docs, id_col, text_col).filter("kept"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
