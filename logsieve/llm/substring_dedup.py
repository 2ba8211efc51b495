"""Substring deduplication by recurring anchor phrases.

A window is WINDOW consecutive words of one document.  A word goes when a window that covers it
also starts earlier (in a smaller identifier, or earlier in the same document); windows are
judged on the input.

1. Every window has an anchor: of its PHRASE-word phrases the one of smallest hash, the leftmost
   among equals.  Equal windows have equal anchors, and neighbouring windows mostly share one, so
   there are about eight times fewer anchors than words.  Anchors that occur twice anywhere
   are recurring; only windows with a recurring anchor can recur.
2. Documents are sharded.  The hashes of recurring anchors locate their phrases in the documents
   of a shard.  These phrases, and no other shard's, are compiled into an Aho-Corasick automaton
   over words, and only the shard's documents stream through it.  It confirms the places that
   the hashes gave; the rows come from the hash joins alone.
3. Windows around located anchors are compared over all shards by a 64-bit hash: all but
   the earliest occurrence are marked, and the marks go back to their documents.

Skew: a shard sends at most one row per distinct anchor and per distinct window, its earliest;
what recurs inside a shard is marked there.  So a passage in a third of all documents costs
one row per shard.  Lists per document are as long as the document at most.

Defined results: null text counts as empty and has no words; texts shorter than a window keep all
words; a null identifier is later than every other; rows with equal identifiers are the
same document, so an occurrence at the same place of both is one occurrence and neither is
earlier; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsieve.functions.ship import ship_by_value
from logsieve.llm.common import chunks, map_batches, table

WINDOW = 20
PHRASE = 6
MAX_WORDS = 600_000
#: Different words that fit into the code points from 0xE000 on.
CHARACTERS = 0x110000 - 0xE000
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of other characters than space, tab, LF, VT, FF and CR: what bytes.split cuts at."""
    return (text or "").encode().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> number, by order of appearance; `hashes` has a 64-bit hash for each number."""

    def __init__(self):
        import xxhash
        super().__init__()
        self.digest, self.hashes = xxhash.xxh3_64_intdigest, array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(self.digest(word))
        return n


class Texts:
    """The words of several documents in one row, with hashes of their phrases and windows."""

    def __init__(self, words: list[list[bytes]], known: Words, window: int, phrase: int):
        lens = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(lens)
        self.begins = self.ends - lens
        total = int(self.ends[-1]) if len(words) else 0
        self.words = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint32, total)
        self.hashes = np.array(known.hashes, np.uint64)[self.words]
        self.doc = np.repeat(np.arange(len(words)), lens)
        # starts of windows that lie in one document
        start = np.arange(max(0, total - window + 1))
        self.starts = start[self.doc[start] == self.doc[start + window - 1]]
        self.window, self.phrase = window, phrase
        self.phrases = self.rolled(phrase)
        #: the place of each window's anchor
        self.anchor = self.leftmost_least(self.phrases, window - phrase + 1)[self.starts]

    @staticmethod
    def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
        """For each place the place of the smallest (leftmost among equals) of `width` values from
        it on, by the values' upper 32 bits: place and value share a number, and minima over
        doubled spans meet."""
        low = np.uint64((1 << 32) - 1)
        least = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[:max(0, len(least) - step)], least[step:])
            span += step
        return (least & low).astype(np.int64)

    def rolled(self, n: int) -> np.ndarray:
        """Hashes of n consecutive words, also across documents."""
        out = np.full(max(0, len(self.hashes) - n + 1), n, np.uint64)
        for j in range(n):
            out = out * BASE + self.hashes[j:j + len(out)]
        return mixed(out)


def anchors(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """h, doc_id, known: anchors of each shard; `known` ones recur in the shard itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                if len(known) > MAX_WORDS:
                    known = Words()
                t = Texts([words_of(x) for x in texts[a:b]], known, window, phrase)
                place = np.unique(t.anchor)
                if not len(place):
                    continue
                h, doc = t.phrases[place], t.doc[place]
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                first = np.append(True, h[1:] != h[:-1])
                several = np.repeat(np.diff(np.append(np.flatnonzero(first), len(h))) > 1, np.diff(np.append(np.flatnonzero(first), len(h))))
                own = several & (first | np.append(True, doc[1:] != doc[:-1]))
                ids = batch.column(0).take(pa.array(a + np.concatenate([doc[first], doc[own]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h[first], h[own]]).view(np.int64)), ids,
                     pa.array(np.arange(first.sum() + own.sum()) >= first.sum())], ["h", "doc_id", "known"])

    return map_batches(docs, run, f"h long, doc_id {kind}, known boolean")


def located(listed: DataFrame, window: int, phrase: int) -> DataFrame:
    """`listed`: doc_id, text, hs (recurring anchors, null if none).  Rows: h, doc_id, start, n:
    a window of hash h at start, or (h null) n windows from start that occur earlier."""
    kind = listed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        known = Words()
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(2)))
            texts = batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                if len(known) > MAX_WORDS:
                    known = Words()
                words = [words_of(x) for x in texts[a:b]]
                t = Texts(words, known, window, phrase)
                listed_h = batch.column(2).slice(a, b - a)
                lists = np.array_split(listed_h.flatten().to_numpy().view(np.uint64), np.cumsum(
                    pa.compute.list_value_length(listed_h).to_numpy())[:-1])

                # compile the shard's recurring phrases
                place = np.unique(t.anchor)
                cuts = np.searchsorted(place, t.ends)
                recurring = [p[np.isin(t.phrases[p], hs)] for p, hs in zip(
                    np.array_split(place, cuts[:-1]), lists, strict=True)]
                at = np.concatenate(recurring)
                if not len(at):
                    continue
                # a word of the shard is one character: its number there, past the surrogates
                distinct, number = np.unique(t.words, return_inverse=True)
                found = np.zeros(len(t.words), bool)
                if len(distinct) < CHARACTERS:
                    line = (number.astype("<u4") + 0xE000).tobytes().decode("utf-32-le")
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    for p in {line[i:i + phrase] for i in at.tolist()}:
                        automaton.add_word(p, 1)
                    automaton.make_automaton()
                    # stream the documents; what is found across two documents is no anchor
                    found[np.fromiter((end for end, _ in automaton.iter(line)), np.int64) - (phrase - 1)] = True
                else:       # one text of over a million different words: by the phrases' hashes
                    found[at] = True
                keep = found[t.anchor]
                start = t.starts[keep]
                if not len(start):
                    continue

                # earliest occurrences of each window in the shard, and the others
                h = t.rolled(window)[start]
                codes = batch.column(0).slice(a, b - a)
                rank = pa.compute.rank(codes, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                doc = t.doc[start]
                within = start - t.begins[doc]
                order = np.lexsort((within, rank[doc], h))
                h, doc, within = h[order], doc[order], within[order]
                first = np.append(True, h[1:] != h[:-1])
                head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
                later = (rank[doc] != rank[doc[head]]) | (within != within[head])
                back = np.lexsort((within[later], doc[later]))
                d, s = doc[later][back], within[later][back]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
                runs = np.flatnonzero(new)
                n = np.diff(np.append(runs, len(d)))
                hs = pa.concat_arrays([pa.array(h[first].view(np.int64)), pa.nulls(len(runs), pa.int64())])
                ids_out = codes.take(pa.array(np.concatenate([doc[first], d[runs]])))
                yield pa.RecordBatch.from_arrays(
                    [hs, ids_out, pa.array(np.concatenate([within[first], s[runs]]).astype(np.int32)),
                     pa.array(np.concatenate([np.ones(first.sum(), np.int32), n.astype(np.int32)]))],
                    ["h", "doc_id", "start", "n"])

    return map_batches(listed, run, f"h long, doc_id {kind}, start int, n int")


def without_marked(marked: DataFrame, window: int, texts: bool) -> DataFrame:
    """`marked`: doc_id, text, marks (array of start, n; null if none)."""
    kind = marked.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            marks = batch.column(2)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(marks), 0).to_numpy()
            flat = marks.flatten()
            first = np.append(0, np.cumsum(sizes))
            starts = flat.field("start").to_numpy(zero_copy_only=False)
            stops = starts + flat.field("n").to_numpy(zero_copy_only=False) + (window - 1)
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                kept = words
                if sizes[k]:
                    mine = slice(first[k], first[k + 1])
                    edge = (np.bincount(starts[mine], minlength=len(words) + 1)
                            - np.bincount(stops[mine], minlength=len(words) + 1))
                    kept = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(),
                             joined.decode() if texts else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][:4 if texts else 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:len(arrays) + 1])

    return map_batches(marked, run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
                       + (", kept string" if texts else ""))


def with_list(docs: DataFrame, rows: DataFrame, value, name: str) -> DataFrame:
    """doc_id, text and the list of `value` of the document's rows (null if none)."""
    lists = rows.groupBy("doc_id").agg(F.collect_list(value).alias(name)).withColumnRenamed("doc_id", "__id")
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("__id")), "left").select("doc_id", "text", name)


def substring_dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, texts: bool = False,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with `texts` also the kept words
    joined by spaces.  The documents are exchanged by identifier once, for both joins."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ship_by_value(__name__)
    found = anchors(slim, window, phrase)
    key = F.when(F.col("known"), F.xxhash64("doc_id", "h")).otherwise(F.col("h"))
    together = Window.partitionBy("key", "known")
    recurring = (found.withColumn("key", key).withColumn("times", F.count(F.lit(1)).over(together))
                 .filter("known OR times > 1").select("doc_id", "h"))
    windows = located(with_list(slim, recurring, F.col("h"), "hs"), window, phrase)
    run = F.col("h").isNull()
    order = Window.partitionBy("key", "run").orderBy(F.col("doc_id").asc_nulls_last(), "start")
    marks = (windows.withColumn("run", run).withColumn("key", F.when(run, F.xxhash64("doc_id", "start")).otherwise(F.col("h")))
             .withColumn("place", F.rank().over(order)).filter("run OR place > 1").select("doc_id", "start", "n"))
    return without_marked(with_list(slim, marks, F.struct("start", "n"), "marks"), window, texts)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
