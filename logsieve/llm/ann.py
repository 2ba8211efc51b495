"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector v of dimension d is normalised, padded with zeros to CODE_BITS dimensions and rotated
at random (the rotation is a seeded orthogonal matrix).  The signs of the result are its code:
CODE_BITS bits, packed.  Two correction scalars stay beside it: its length |v| and
a = <o, x>, the inner product of the rotated unit vector o with its code vector
x in {-1, 1}^D / sqrt(D).  For a query q, <x, q> / a estimates <o, q>, and with high
probability the error is at most EPSILON * sqrt((1 - a^2) / a^2 / (D - 1)) * |q|.

Search: queries and candidates are dealt to blocks of bounded size, and a task compares one
block of queries with one block of candidates.  A query keeps those candidates of the block
whose upper bound reaches the k-th largest lower bound, ranks them again by exact inner
products in double precision, and passes its k best of the block on; the best of all
blocks are merged per query.  Queries are a fixed set
against all rows, in blocks; no pair of rows leaves a task but a query's k best of a block.

Defined results: vectors that are null, zero or empty, or that hold null or non-finite components take no part;
vectors meet those of their own length; a query's own row is never its neighbour;
rows repeated with equal identifier and vector count once, other vectors under the same
identifier are rows of their own; ties go to the smaller identifier; fewer than k candidates give
fewer rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm.common import cut, table

NEAREST = 20
CODE_BITS = 256
EPSILON = 2.5
#: Rows of a block of candidates and of queries, on average.
CANDIDATES, QUERIES = 8_192, 1_024
#: Query rows whose estimates are held at once.
STRIP = 64

FOUND = "query_id long, query_copy long, vec_id long, score double"


def rotation(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """The first `dim` rows of a random orthogonal matrix: padding with zeros is implied."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def bits_for(dim: int) -> int:
    return max(CODE_BITS, 64 * -(-dim // 64))


def codes_of(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes as bytes, lengths, corrections <o, x>)."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    o = (vectors / length[:, None]) @ turn
    a = np.abs(o).sum(axis=1) / np.sqrt(o.shape[1])
    return np.packbits(o > 0, axis=1), length, a


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray,
                 codes: np.ndarray, length: np.ndarray, a: np.ndarray, k: int = NEAREST, epsilon: float = EPSILON,
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best of the block for each query."""
    bits = codes.shape[1] * 8
    turn = rotation(queries.shape[1], bits)
    rotated = queries @ turn
    reach = np.sqrt((rotated * rotated).sum(axis=1))
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    slack = epsilon * np.sqrt(np.maximum(1 - a * a, 0) / (a * a) / (bits - 1)) * length
    rows, found, scores = [], [], []
    for i in range(0, len(queries), STRIP):
        part = slice(i, i + STRIP)
        estimate = (rotated[part].astype(np.float32) @ signs.T) * (length / a / np.sqrt(bits))
        # estimates are rounded to single precision: widen the bounds by as much
        error = reach[part, None] * (slack + 1e-5 * length)
        own = query_ids[part, None] == vec_ids[None, :]
        lower = np.where(own, -np.inf, estimate - error)
        n = min(k, lower.shape[1])
        cutoff = np.partition(lower, lower.shape[1] - n, axis=1)[:, lower.shape[1] - n]
        for j in range(len(lower)):
            keep = np.flatnonzero((estimate[j] + error[j] >= cutoff[j]) & ~own[j])
            exact = (vectors[keep] * queries[i + j]).sum(axis=1)
            best = np.lexsort((vec_ids[keep], -exact))[:k]
            rows.append(np.full(len(best), i + j))
            found.append(keep[best])
            scores.append(exact[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (array<double>) of the vectors that take part, each once."""
    v = F.col("vec")
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = slim.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fine & F.exists(v, lambda x: x != 0))
    return slim.dropDuplicates(["vec_id", "vec"])


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score.  `is_query`: Column -> Column, of the identifier."""
    rows = cut(usable(vectors, id_col, vector_col)).withColumn("dim", F.size("vec"))
    # blocks and strips of each length of vectors, by their number; a table as long as there are lengths
    asked = F.count_if(is_query(F.col("vec_id")))
    sizes = cut(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("int").alias("blocks"),
                                        F.greatest(F.ceil(asked / QUERIES), F.lit(1)).cast("int").alias("strips")))
    dealt = rows.join(sizes, "dim")
    hashed = F.xxhash64("vec_id", "vec")
    candidates = dealt.select("dim", "vec_id", "vec", F.pmod(hashed, F.col("blocks")).cast("int").alias("block"))
    queries = (dealt.filter(is_query(F.col("vec_id")))
               .select("dim", "blocks", "vec_id", "vec", F.pmod(hashed, F.col("strips")).cast("int").alias("strip")))
    ship_by_value(__name__)

    def matrix(group: pa.Table) -> np.ndarray:
        return group["vec"].combine_chunks().flatten().to_numpy().reshape(-1, group["dim"][0].as_py())

    def index(group: pa.Table) -> pa.Table:
        dim, vectors = group["dim"][0].as_py(), matrix(group)
        codes, length, a = codes_of(vectors, rotation(dim, bits_for(dim)))
        return pa.table({"dim": group["dim"][:1], "block": group["block"][:1],
                         "vec_ids": pa.array([group["vec_id"].to_numpy()], pa.list_(pa.int64())),
                         "vecs": pa.array([vectors.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary()),
                         "lengths": pa.array([length], pa.list_(pa.float64())), "a": pa.array([a], pa.list_(pa.float64()))})

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"dim": group["dim"][:1], "strip": group["strip"][:1], "blocks": group["blocks"][:1],
                         "query_ids": pa.array([group["vec_id"].to_numpy()], pa.list_(pa.int64())),
                         "queries": pa.array([matrix(group).tobytes()], pa.binary())})

    # a block is one row; every row has the codes, their scalars and the original vectors
    indexed = candidates.groupBy("dim", "block").applyInArrow(
        index, "dim int, block int, vec_ids array<long>, vecs binary, codes binary, lengths array<double>, a array<double>")
    packed = (queries.groupBy("dim", "strip").applyInArrow(pack, "dim int, strip int, blocks int, query_ids array<long>, queries binary")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = {n: batch.column(n)[r] for n in batch.schema.names}
                array = lambda n: x[n].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                dim = x["dim"].as_py()
                grid = lambda n: np.frombuffer(x[n].as_buffer(), np.float64).reshape(-1, dim)  # noqa: E731, B023
                codes = np.frombuffer(x["codes"].as_buffer(), np.uint8).reshape(-1, bits_for(dim) // 8)
                row, found, scores = search_block(grid("queries"), array("query_ids"), grid("vecs"), array("vec_ids"),
                                                  codes, array("lengths"), array("a"), k)
                # the query's number in its strip tells apart queries with one identifier
                yield pa.RecordBatch.from_arrays(
                    [pa.array(array("query_ids")[row]), pa.array((x["strip"].as_py() << 32) + (dim << 12) + row, pa.int64()),
                     pa.array(array("vec_ids")[found]), pa.array(scores)], ["query_id", "query_copy", "vec_id", "score"])

    pairs = packed.join(indexed.hint("shuffle_hash"), ["dim", "block"])
    hits = pairs.mapInArrow(search, FOUND)

    # k best of each query; the group limit of the window drops the others before the shuffle
    order = Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
