"""Filter interaction audit by min-plus removal ranks.

Every document fails a set of the filters, its mask.  For a mask and an order of the filters, the
step that removes the document is the least position of a filter it fails: the min-plus product

    step[mask, order] = min over filters f of (M[mask, f] + P[f, order])

of the masks' matrix M (0 where the filter fails, infinite where not) and the inverse permutations
P (where f stands in the order).  The product is one small fixed table for all data.  Everything else is a
weighted scatter along it: documents are counted by part and mask, and the counts are added where the
table points (removals, losses), or at the positions of the other failing filters (redundancies).

Documents: texts are read once, where they are stored; from there on a document is its part, its
mask of the text filters and the 256-bit digest that stands for its text.  The filter on copies needs the
smallest doc_id of each text; it is found by a map-side combined aggregate and joined back on (digest, doc_id),
so that no task holds a group of copies.  A part has at most one row per mask when its matrices are filled.

Defined results: null text is empty, null source is the empty part; a null doc_id is neither smaller nor
larger than others and has no label; rows that repeat both doc_id and text are separate documents of
which neither comes first, so the copy filter treats them alike; a doc_id with several labels counts for
each value that one of them has; null labels are neither; no documents give no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.common import map_batches, table
from logsieve.session import written

FILTERS = "ABCDE"
COPY_BIT = 1 << FILTERS.index("E")
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Parts whose result rows are made at once.
PARTS_AT_ONCE = 256

UPPER = bytes(range(ord("A"), ord("Z") + 1))
INNER = bytes(range(0x80, 0xC0))
MARKS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text (in UTF-8) fails."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, INNER))
    upper = len(text) - len(text.translate(None, UPPER))
    return ((n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * upper > 2 * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of the text filters and the text's digest, of every document."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text_mask(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                ["doc_id", "part", "mask", "digest"])

    return map_batches(slim, run, "doc_id long, part string, mask int, digest binary", __name__)


def with_copies(rows: DataFrame) -> DataFrame:
    """doc_id, part, mask, n: equal rows counted, with the copy filter's bit in the mask."""
    rows = written(rows)
    counted = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return counted.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(F.lit(COPY_BIT))).otherwise(F.col("mask")).alias("mask"), "n")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and of them those of quality 1 and toxic ones."""
    marks = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good OR toxic"))
    # null identifiers have no label: they stay out of the join, where they would meet in one task
    named = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    no = F.lit(None).cast("boolean")
    nameless = rows.filter("doc_id IS NULL").withColumn("good", no).withColumn("toxic", no)
    return (named.unionByName(nameless).groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))


def removal_tables(n_filters: int) -> dict[str, np.ndarray]:
    """orders[o, k]: the filter at place k.  steps[m, o]: min-plus product, the place that removes mask m (n_filters
    where none does).  removes[m, o, k] and repeats[m, o, k]: 1 where the filter at place k removes mask m, and
    where it fails but an earlier one has removed it."""
    orders = np.array(list(permutations(range(n_filters))), np.int64)
    position = np.argsort(orders, axis=1)                                   # inverse permutations
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    far = n_filters                                                         # stands for infinity
    steps = (np.where(fails == 1, 0, far)[:, None, :] + position[None, :, :]).min(axis=2)
    steps = np.minimum(steps, far)
    place = np.arange(n_filters)
    removes = steps[:, :, None] == place
    repeats = (fails[:, orders] == 1) & (steps[:, :, None] < place)
    return {"orders": orders, "steps": steps, "removes": removes.astype(np.int64), "repeats": repeats.astype(np.int64)}


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order and step; `counts` has part, mask, n, good, toxic, a mask once per part."""
    k = len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = removal_tables(k)
        orders, removes, repeats = t["orders"], t["removes"], t["repeats"]
        n_orders = len(orders)
        names = ["".join(filters[f] for f in o) for o in orders]
        flat = {"removed": removes.reshape(1 << k, -1), "redundant": repeats.reshape(1 << k, -1)}
        for whole in batches:
            for start in range(0, whole.num_rows, PARTS_AT_ONCE):
                batch = whole.slice(start, PARTS_AT_ONCE)
                size = batch.num_rows
                weights = np.zeros((3, size, 1 << k), np.int64)             # documents, good ones, toxic ones
                for i, cells in enumerate(batch.column(1).to_pylist()):
                    for c in cells:
                        weights[:, i, c["mask"]] += (c["n"], c["good"], c["toxic"])
                scatter = lambda w, how: (w @ flat[how]).reshape(size, n_orders, k)
                removed = scatter(weights[0], "removed")
                by_filter = np.zeros((size, k), np.int64)                   # removals over all orders
                for f in range(k):
                    by_filter[:, f] = removed[:, orders == f].sum(axis=1)
                alone = weights[0][:, 1 << np.arange(k)]
                cells = {"kept": weights[0].sum(axis=1)[:, None, None] - removed.cumsum(axis=2), "removed": removed,
                         "redundant": scatter(weights[0], "redundant"), "unique_fails": alone[:, orders],
                         "good_lost": scatter(weights[1], "removed"), "toxic_lost": scatter(weights[2], "removed"),
                         "shapley": by_filter[:, orders]}
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(size), n_orders * k))),
                     pa.array(np.tile(np.repeat(np.array(names), k), size).tolist()),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size * n_orders)),
                     *[pa.array(cells[c].reshape(-1)) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_batches(by_part, run, schema, __name__)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(masked(table(spark, sf_dir, "documents")))
    return audit(mask_counts(rows, table(spark, sf_dir, "labels")))


SQL = r"""
WITH f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
places AS (
  SELECT filter_order, step, filter_order[step] AS f, f.b
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders) JOIN f ON f.f = filter_order[step]),
w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM w GROUP BY t),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
gone AS (
  SELECT mask, filter_order, coalesce(min(step) FILTER (mask & b <> 0), 6) AS gone_at
  FROM (SELECT DISTINCT mask FROM m), places GROUP BY ALL),
cells AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & b <> 0 AND gone_at < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone_at = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM m JOIN gone USING (mask) JOIN places USING (filter_order) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM cells
"""
