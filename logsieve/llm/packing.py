"""Packing documents into fixed-length training sequences.

Each document is tokenized once, where it is read; its ids (with the closing id) are cut into
pieces of the sequence length and a remainder, and from here on only the pieces' sizes and
checksums travel.  They are written as a table and counted, and the count gives the number of
groups: the pieces are dealt to random groups of about GROUP_PIECES pieces, and every group is packed by itself: first-fit decreasing, where a tournament tree over the
sequences' free capacities finds the first sequence that a piece fits.  A sequence id holds the
group in its upper and the sequence's number in its lower 32 bits.

Padding: remainders are many and short, so they fill the gaps; what is left is about one
part-filled sequence per group.

Defined results: null or empty text has the closing id alone; repeated rows (also with equal
or null identifiers) are separate documents and are dealt by their place in the input, so
that no group grows with them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm import common, lookup, word_bpe
from logsieve.llm.common import cut, map_batches, ranges, table

SEQUENCE = 4096
CLOSING_ID = 2
#: Pieces in a group, on average.
GROUP_PIECES = 4096

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long")
PACKED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_pieces(ids: bytes, length: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the consecutive pieces of a document's packed ids."""
    view, size = memoryview(ids), 4 * length
    return [(i // 4, len(part) // 4, zlib.crc32(part))
            for i in range(0, len(ids), size) for part in (view[i:i + size],)]


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length.  `tree` is a tournament over the bins' free capacity: a
    node holds the most that is free below it, so going left whenever the left side is large
    enough finds the first bin that fits."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    place: list[tuple[int, int]] = [(0, 0)] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        place[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return place


def pieces_of(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE,
              closing_id: int = CLOSING_ID, seed: int = 0) -> DataFrame:
    """`docs` has doc_id and text; `draw` is a random number that deals the pieces."""
    ship_by_value(lookup.__name__, word_bpe.__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_bpe.WordIds(tokenizer_path)
        closing = np.uint32(closing_id).tobytes()
        place = 0
        for batch in batches:
            doc_ids = batch.column(0)
            # only a chunk's texts become strings
            for a, b in ranges(batch.column(1), word_bpe.CHUNK_CHARS):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                rows = []
                for k, ids in enumerate(ids_of.encode(texts), a):
                    ids += closing
                    rows += [(k, *piece, len(ids) // 4) for piece in cut_pieces(ids, length)]
                at, start, size, crc, tokens = np.array(rows, np.int64).T
                order = mixed(crc + mixed(np.arange(place, place + len(at)) + seed).astype(np.int64))
                place += len(at)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(at)), *map(pa.array, (start, size, crc, tokens)),
                     pa.array((order >> np.uint64(1)).astype(np.int64))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"])

    return map_batches(docs, run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, closing_id: int = CLOSING_ID,
         id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    drawn = cut(pieces_of(slim, tokenizer_path, length, closing_id, seed))
    groups = max(1, round(drawn.count() / GROUP_PIECES))
    pieces = drawn.withColumn("grp", F.col("draw") % groups).drop("draw")
    ship_by_value(__name__, common.__name__)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                               ("ids_crc32", "ascending")])
        place = first_fit_decreasing(group["length"].to_pylist(), length)
        number, offset = np.array(place, np.int64).T
        sequence = (group["grp"].to_numpy() << 32) + number
        return (group.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence))
                .append_column("offset", pa.array(offset)))

    return pieces.groupBy("grp").applyInArrow(run, PACKED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
