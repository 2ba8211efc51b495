"""Phrase collocation mining with an FM-index per shard over word ids.

1. `shards` reads every text once.  The words of one language that a task has read become a shard: numbers
   of the shard's own words, 0 where a piece ends.  A shard is bounded (SHARD_WORDS), and so is the number of
   words that a task numbers at once.
2. A word is frequent when its counts, summed over all shards, reach `min_count`.  Every shard gets back which
   of its words are frequent; the others can be in no frequent phrase and are replaced by one break.
3. The rest is indexed: suffixes sorted by their first MAX words, the Burrows-Wheeler transform (the word
   before each suffix) and its last-to-first mapping.  A phrase is an interval of the sorted suffixes.
4. `extend` takes all intervals of d words one step in both directions: the transform's mapping puts one word
   before an interval (to the left), and where that falls inside the interval of another phrase of d words, that
   phrase is extended by one word to the right.  So a phrase of d + 1 words is counted exactly where both phrases
   of d words in it are frequent over all shards.  The counts of all shards are summed, the frequent ones go
   back to the shards, and rows that no frequent phrase begins are dropped from the index.
   Phrases travel as pairs of numbers (the phrase without its last word, the last word), packed by shard and by
   part, a hash of the pair: a part holds about PART_ENTRIES counts, sums them, numbers the frequent
   phrases and tells every shard which of its intervals they are.
5. Cuts, scores and the removal of phrases inside longer ones are joins of the summed counts.

Rounds are as many as words in the longest phrase.  Between rounds only packed counts travel (some eight bytes a
phrase and shard), and the indexes (two to three bytes a word), dealt by shard; both are written as tables, so
a lost executor repeats one round.

Defined results: null text has no words; null lang is `und`, also beside rows that say so; rows with equal text,
equal or null identifiers count each; a language without frequent phrases has no rows, and neither has an empty
table; no other column is read, so clashing names do not matter.  Equal scores and counts go by phrase, so
the ranks are unique.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsieve.functions.ship import ship_by_value
from logsieve.llm.common import map_batches, ranges, table
from logsieve.session import written

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Words (and breaks) of a shard, at most, if no single text has more.
SHARD_WORDS = 2_000_000
#: Different words that a task numbers at once, over all languages.
NUMBERED = 1_000_000

#: White space cannot be in here but as a space or a tab: the others end a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BREAKS = bytes.maketrans(PIECE_ENDS, b"." * len(PIECE_ENDS))

#: Counts that a part sums, about.
PART_ENTRIES = 1_000_000

#: Buckets that number their words apart.
BUCKETS = 1024
#: Rows of a batch that a task returns: those of a shard with many words go out in several.
BATCH_ROWS = 10_000

#: Level 1: a row for each word of a shard (its number, count and letters), and one for the shard itself: start -1
#: and the packed sequence.
WORDS = "shard long, lang string, start int, n long, word string, data binary"
#: Later levels: a row for each part of a shard's phrases (the packed numbers of their two halves, first rows and
#: counts), and one for the shard itself: part -1 and the packed index.
PHRASES = "shard long, lang string, part int, prefix binary, last binary, start binary, n binary"
#: Sums: a row for each frequent phrase (shard -1), and one for each shard that has some in this part.
FREQUENT = ("shard long, lang string, id long, prefix_id long, last_id long, f long, "
            "start binary, n binary, ids binary, lasts binary")


class Numbers(dict):
    """word -> number in order of appearance, from 1 on; 0 is the break."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: the upper ones are nearly all zeros, and in the others some bytes are
    much more frequent.  Up to 2**31 in size as 4 bytes, larger ones as 8; before them that size and how many there are."""
    kind = "<i4" if not len(numbers) or max(int(numbers.max()), -int(numbers.min())) < 2**31 else "<i8"
    width = int(kind[-1])
    planes = numbers.astype(kind, copy=False).view(np.uint8).reshape(-1, width).T.tobytes()
    return kind[-1].encode() + len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    width, n = int(data[:1]), int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(memoryview(data)[9:], n * width, "zstd"), np.uint8).reshape(width, -1)
    return planes.T.copy().view(f"<i{width}").reshape(-1).astype(kind, copy=False)


def pack_steps(numbers: np.ndarray) -> bytes:
    """For numbers that mostly ascend: their differences."""
    return pack(np.diff(numbers, prepend=0))


def unpack_steps(data: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


def part_of(prefix: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    x = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def word_rows(shard: int, lang: str, counts: np.ndarray, names: pa.Array, data: bytes) -> list[pa.RecordBatch]:
    """The shard's row, and its words in batches of BATCH_ROWS."""
    n = len(counts)
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("start", pa.int32()), ("n", pa.int64()),
                        ("word", pa.string()), ("data", pa.binary())])
    own = pa.table([[shard], [lang], [-1], [0], [None], [data]], schema=schema)
    words = pa.table([np.full(n, shard, np.int64), pa.array([lang] * n, pa.string()), np.arange(1, n + 1, dtype=np.int32),
                      counts.astype(np.int64, copy=False), names, pa.nulls(n, pa.binary())], schema=schema)
    return own.to_batches() + words.to_batches(max_chunksize=BATCH_ROWS)


def phrase_rows(shard: int, lang: str, parts: int, prefix, last, starts, counts, data: bytes) -> pa.Table:
    """The shard's row and one row for each part that has phrases."""
    part = part_of(prefix, last, parts)
    order = np.argsort(part, kind="stable")                        # first rows ascend within a part
    part = part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    columns = {"prefix": [data], "last": [b""], "start": [b""], "n": [b""]}
    for a, b in zip(at, np.append(at, len(part))[1:], strict=True):
        own = order[a:b]
        for name, how, x in (("prefix", pack, prefix), ("last", pack, last), ("start", pack_steps, starts), ("n", pack, counts)):
            columns[name].append(how(x[own]))
    rows = len(at) + 1
    both = pa.table({"shard": pa.array(np.full(rows, shard, np.int64)), "lang": pa.array([lang] * rows, pa.string()),
                     "part": pa.array(np.append(-1, part[at]).astype(np.int32))}
                    | {name: pa.array(x, pa.binary()) for name, x in columns.items()})
    return pa.concat_tables([both.slice(0, 1), both.slice(1)])     # sent as two batches


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Level 1: the shards' words with their counts; `docs` has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 24
        # a sequence grows in one piece: a piece for every text would keep the texts' memory from being given back
        open_: dict[str, tuple[Numbers, array]] = {}

        def close(lang: str) -> list[pa.RecordBatch]:
            nonlocal number
            numbers, sequence = open_.pop(lang)
            words = np.frombuffer(sequence, np.int32)
            counts = np.bincount(words, minlength=len(numbers))[1:]
            names = pa.array(list(numbers)[1:], pa.binary()).cast(pa.string())
            number += 1
            return word_rows(number, lang, counts, names, pack(words))

        for batch in batches:
            for a, b in ranges(batch.column(1)):
                langs = batch.column(0)[a:b].to_pylist()
                texts = batch.column(1)[a:b].cast(pa.binary()).to_pylist()
                for lang, text in zip(langs, texts, strict=True):
                    if not text:
                        continue
                    words = text.lower().translate(BREAKS).replace(b".", b" . ").split()
                    words.append(b".")
                    numbers, sequence = open_.setdefault(lang, (Numbers(), array("i")))
                    sequence.extend(map(numbers.__getitem__, words))
                    if len(sequence) >= shard_words:
                        yield from close(lang)
            while sum(len(n) for n, _ in open_.values()) > NUMBERED or sum(len(x) for _, x in open_.values()) > 2 * shard_words:
                yield from close(max(open_, key=lambda x: len(open_[x][1])))
        for lang in list(open_):
            yield from close(lang)

    return map_batches(docs, run, WORDS, __name__)


def without_rare(words: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The sequence with the kept numbers as 1, 2, ... in their order, one 0 for each stretch of others, and without kept
    words that have no kept neighbour: a cyclic sequence of runs of two or more words, each with a 0 before it."""
    new = np.zeros(int(max(words.max(initial=0), kept.max(initial=0))) + 1, np.int32)
    new[kept] = np.arange(1, len(kept) + 1)
    ids = np.zeros(len(words) + 2, np.int32)
    ids[1:-1] = new[words]
    word = ids > 0
    run = word[1:-1] & (word[:-2] | word[2:])
    run = np.concatenate([[False], run, [False]])
    starts = run[1:] & ~run[:-1]
    return ids[run | np.append(starts, False)]


def ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs, from 0 on without gaps."""
    key = first.astype(np.int64)
    key *= int(second.max(initial=0)) + 1
    key += second
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1])[:len(key)], dtype=np.int32)
    return rank


def last_to_first(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, source) of the index of a cyclic sequence whose suffixes are sorted by their first `depth` words: the first
    word of each sorted suffix, and the row of the suffix without it.  `source` inverts the mapping of the
    Burrows-Wheeler transform: row j is where the transform's symbol in row source[j] is put in front."""
    size = int(words.max(initial=0)) + 1
    rank, known = words, 1
    while known < depth:  # ranks by twice as many words, or by the rest
        step = min(known, depth - known)
        follower = np.roll(rank, -known) if step == known else np.roll(words, -known)
        rank = ranks(rank, follower)
        known += step if step == known else 1
    order = np.argsort(rank, kind="stable")
    transform = words[order - 1]                               # order - 1 is -1 for the first: the sequence is cyclic
    small = transform.astype(np.uint16) if size <= 2**16 else transform
    first = words[order]
    del order, transform, rank
    return first, np.argsort(small, kind="stable").astype(np.int32)


def extend(source: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step in both directions.  held[j] is the phrase (of d words) whose interval holds row j, -1 for none; source[j]
    the row of the suffix without its first word, -1 where it is not kept.  Returns the first row, the count, and the
    phrases of the first d and of the last d words of every phrase of d + 1 words."""
    left = np.where(source >= 0, held[source], held.dtype.type(-1))    # the phrase that has a word put before it
    row = np.flatnonzero((held >= 0) & (left >= 0))
    before, after = held[row], left[row]
    if not len(row):
        return row, row, before, after
    begins = np.ones(len(row), bool)
    begins[1:] = (row[1:] != row[:-1] + 1) | (before[1:] != before[:-1]) | (after[1:] != after[:-1])
    at = np.flatnonzero(begins)
    return row[at], np.diff(np.append(at, len(row))), before[at], after[at]


def compact(source: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that no phrase holds."""
    keep = held >= 0
    number = np.cumsum(keep, dtype=source.dtype) - 1
    number[~keep] = -1
    source = source[keep]
    return np.where(source >= 0, number[source], source.dtype.type(-1)), held[keep]


def step_of(depth: int, longest: int, parts: int):
    """The task of one shard: its row and its frequent phrases of `depth` words -> its phrases of depth + 1."""

    def run(state: pa.Table, kept: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not kept.num_rows or not state.num_rows:
            return phrase_rows(0, "", 1, none, none, none, none, b"").slice(1)
        shard, lang, data = (state[c][0].as_py() for c in ("shard", "lang", "data"))
        if depth == 1:
            start, ids = (kept[c].to_numpy().astype(np.int64) for c in ("start", "id"))
            order = np.argsort(start)
            start, ids = start[order], ids[order]
            lasts = ids
            first, source = last_to_first(without_rare(unpack(data, np.int32), start), longest)
            held = first - 1                                       # words are numbered in the order of `start`
            del first
            source[held < 0] = -1
        else:
            gather = lambda name, how: np.concatenate([how(x) for x in kept[name].to_pylist()])
            start, size, ids, lasts = gather("start", unpack_steps), gather("n", unpack), gather("ids", unpack), gather("lasts", unpack)
            source = unpack_steps(data, np.int32) - 1              # stored one higher
            held = np.full(len(source), -1, np.int32)
            ends = np.cumsum(size)
            rows = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            # phrases by their first rows, so that neighbours in the index keep the order
            held[rows] = np.repeat(np.arange(len(start)), size)
        del data
        source, held = compact(source, held)
        starts, counts, before, after = extend(source, held)
        del held
        stored = pack_steps(source + 1) if depth + 1 < longest else b""
        del source
        return phrase_rows(shard, lang, parts, ids[before], lasts[after], starts, counts, stored)

    return run


def sum_part(min_count: int):
    """The task of one part: sums the counts of all shards, numbers the frequent phrases and returns each shard's intervals."""

    def run(group: pa.Table) -> pa.Table:
        get = lambda name, how: [how(x) for x in group[name].to_pylist()]
        prefixes, lasts, starts, counts = get("prefix", unpack), get("last", unpack), get("start", unpack_steps), get("n", unpack)
        sizes = np.array([len(x) for x in counts])
        prefix, last, count = np.concatenate(prefixes), np.concatenate(lasts), np.concatenate(counts)
        order = np.lexsort((last, prefix))
        p, q = prefix[order], last[order]
        new = np.append(True, (np.diff(p) != 0) | (np.diff(q) != 0))
        at = np.flatnonzero(new)
        f = np.add.reduceat(count[order], at)
        number = np.empty(len(p), np.int64)
        number[order] = np.cumsum(new) - 1
        frequent = f >= min_count
        part = group["part"][0].as_py()
        ids = np.where(frequent, (part << 32) + np.arange(len(f)), -1)
        langs = group["lang"].to_pylist()
        row = np.repeat(np.arange(len(langs)), sizes)[order][at]     # a shard that has the phrase, for its language
        hit = np.flatnonzero(frequent)
        out = [{"shard": np.full(len(hit), -1, np.int64), "lang": [langs[i] for i in row[hit]], "id": ids[hit], "prefix_id": p[at][hit],
                "last_id": q[at][hit], "f": f[hit]}]
        ends = np.cumsum(sizes)
        shards_, packed = [], {"start": [], "n": [], "ids": [], "lasts": []}
        for i, shard in enumerate(group["shard"].to_pylist()):
            own = ids[number[ends[i] - sizes[i]:ends[i]]]
            keep = own >= 0
            if keep.any():
                shards_.append((shard, langs[i]))
                for name, how, x in (("start", pack_steps, starts[i]), ("n", pack, counts[i]), ("ids", pack, own), ("lasts", pack, lasts[i])):
                    packed[name].append(how(x[keep]))
        n, m = len(hit), len(shards_)
        long = lambda name: pa.concat_arrays([pa.array(out[0][name], pa.int64()), pa.nulls(m, pa.int64())])
        return pa.table({
            "shard": pa.concat_arrays([pa.array(out[0]["shard"]), pa.array([s for s, _ in shards_], pa.int64())]),
            "lang": pa.array(out[0]["lang"] + [x for _, x in shards_], pa.string()),
            **{c: long(c) for c in ("id", "prefix_id", "last_id", "f")},
            **{c: pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(x, pa.binary())]) for c, x in packed.items()}})

    return run


def parts_for(frequent: DataFrame) -> int:
    """A phrase of one word more occurs at most as often as the frequent ones that begin it."""
    total = frequent.agg(F.sum("f")).first()[0] or 0
    return max(1, -(-int(total) // PART_ENTRIES))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                  shard_words: int = SHARD_WORDS, lang_col: str = "lang",
                  text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, words) of all phrases of 1 to `max_words` words with f >= min_count, and (lang, n)."""
    slim = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    ship_by_value(__name__)
    level = written(shards(slim, shard_words))
    own = level.filter("start >= 0")
    sizes = written(own.groupBy("lang").agg(F.sum("n").alias("n")))
    # a word has one row per shard; one exchange sums them and numbers the frequent ones, in each bucket by how frequent
    # they are: so the numbers that occur most are alike in their upper bytes
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS))
    dealt = own.select("lang", "word", "shard", "start", "n", bucket.alias("_bucket")).repartition("_bucket")
    place = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(F.col("f").desc(), "lang", "word"))
    held = written(dealt.withColumn("f", F.sum("n").over(Window.partitionBy("_bucket", "lang", "word"))).filter(F.col("f") >= min_count)
                   .select("lang", "word", "shard", "start", "f", (place.cast("long") * BUCKETS + F.col("_bucket")).alias("id")))
    words = written(held.groupBy("id").agg(F.any_value("lang").alias("lang"), F.any_value("word").alias("word"), F.any_value("f").alias("f")))
    frequent = words.select("lang", F.col("word").alias("phrase"), "f", "id")
    state = level.filter("start = -1").select("shard", "lang", "data")
    kept = held.select(F.col("shard").alias("of"), "start", "id")
    out = frequent.select("lang", "phrase", "f").withColumn("words", F.lit(1))
    for depth in range(1, max_words):
        level = written(state.groupBy("shard").cogroup(kept.groupBy("of"))
                        .applyInArrow(step_of(depth, max_words, parts_for(frequent)), PHRASES))
        sums = written(level.filter("part >= 0").groupBy("part").applyInArrow(sum_part(min_count), FREQUENT))
        shorter = frequent.select(F.col("id").alias("prefix_id"), F.col("phrase").alias("_prefix"))
        last = words.select(F.col("id").alias("last_id"), F.col("word").alias("_last"))
        frequent = written(sums.filter("shard = -1").select("lang", "id", "prefix_id", "last_id", "f")
                           .join(shorter, "prefix_id").join(last, "last_id")
                           .select("lang", F.concat_ws(" ", "_prefix", "_last").alias("phrase"), "f", "id"))
        out = out.unionByName(frequent.select("lang", "phrase", "f").withColumn("words", F.lit(depth + 1)))
        state = level.filter("part = -1").select("shard", "lang", F.col("prefix").alias("data"))
        kept = sums.filter("shard >= 0").select(F.col("shard").alias("of"), "start", "n", "ids", "lasts")
    return out, sizes


def scored(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every phrase of two words or more, by its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = (counts.filter("words > 1").withColumnRenamed("f", "a").withColumn("w", words)
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
            .withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
            .withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("w"))
    of = lambda part, name: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    score = F.expr("(CAST(1000 * a AS DECIMAL(20, 0)) * CAST(n AS DECIMAL(17, 0)))"
                   " DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    cuts = (cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
            .join(sizes, "lang").withColumn("score", score))
    return (cuts.groupBy("lang", "phrase", "words", "a", "n")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
            .select("lang", "phrase", "words", "a", "x.l", "x.r", "n", "x.score"))


def without_parts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Without phrases that a phrase longer by one word holds each time they occur (a longer phrase still that does
    so holds one that is longer by one word)."""
    w = F.split("phrase", " ")
    parts = (counts.filter("words > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "),
        F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))).alias("phrase")))
    longest = parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return (candidates.join(longest, ["lang", "phrase"], "left")
            .filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
         shard_words: int = SHARD_WORDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of every language."""
    counts, sizes = phrase_counts(docs, min_count, max_words, shard_words, lang_col, text_col)
    rows = without_parts(scored(counts, sizes), counts)
    # the best of a language in two rounds: of each of several parts, then of those; both as large at most
    parts = max(1, int((counts.count() / max(1, top)) ** 0.5))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    best = (rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            .filter(F.col("rank") <= top))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
            .filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS p FROM pieces),
grams AS (
  SELECT lang, w[p:p + k - 1] AS ws, k FROM starts, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE p + k - 1 <= len(w)),
f AS (SELECT lang, ws, k, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT c.lang, c.ws, c.f AS a, cut, l.f AS l, r.f AS r, n,
         (1000::HUGEINT * c.f * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN sizes USING (lang)
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:cut] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[cut + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT lang, ws[i:j] AS ws, f AS longer
  FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, unnest(range(1, k)) AS i FROM c)) WHERE j - i + 1 < k),
kept AS (
  SELECT * FROM lowest
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = lowest.lang AND i.ws = lowest.ws AND 100 * longer >= 100 * a)),
ranked AS (
  SELECT *, array_to_string(ws, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
