"""Collocations: counts, cuts, removals and ranks against plain loops; the index against searches in the text."""
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
from data import hard_docs, no_docs, table_of

from logsieve.llm import collocations as C
from logsieve.llm.common import table

SF = "/root/testdata/sf0.001"


def by_hand(docs, min_count, longest=5, top=2000):
    """docs: (lang, text)."""
    counts, sizes = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, words[i:i + k]) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= min_count:
            cuts = [(1000 * a * sizes[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], sizes[lang], score)
    inside = {}
    for (lang, p), x in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside.get((lang, p[i:j]), 0), x[0])
    out = []
    for lang in sizes:
        rows = sorted((-x[4], -x[0], " ".join(p).encode(), x) for (at, p), x in found.items()
                      if at == lang and inside.get((at, p), 0) < x[0])
        out += [(lang, n, p.decode(), *x) for n, (_, _, p, x) in enumerate(rows[:top], 1)]
    return out


def random_texts(n, seed):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "é", "x1", "日本", "in", "fact", "in fact we do", "\xa0", "\x1c", "\x85y"]
    return [(draw.choice(["en", "de", None, "und", ""]),
             "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\r\n", ",", "!", " 日 "])
                     for _ in range(draw.randrange(60)))) for _ in range(n)]


def test_random_texts_by_hand(spark):
    docs = random_texts(150, 1) + [("en", "a b c d e f " * 20), ("en", None), (None, ""), ("de", "...,,,")]
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    for least, size in ((5, 10_000), (12, 200)):
        got = C.mine(frame, min_count=least, shard_words=size).collect()
        assert table_of(got) == table_of(by_hand(docs, least))
    assert table_of(C.mine(frame, min_count=6, top=3, max_words=3).collect()) == table_of(by_hand(docs, 6, 3, 3))


def test_many_shards_give_the_same(spark):
    docs = table(spark, SF, "documents")
    one, many = C.mine(docs, min_count=20), C.mine(docs.repartition(7), min_count=20, shard_words=500)
    assert table_of(one.collect()) == table_of(many.collect())


def test_hard_tables(spark):
    docs = hard_docs(spark)
    got = C.mine(docs, min_count=4).collect()
    assert table_of(got) == table_of(by_hand([(r.lang, r.text) for r in docs.collect()], 4))
    assert got
    assert C.mine(no_docs(spark)).count() == 0
    assert C.mine(docs, min_count=10**9).count() == 0


def test_large_products(spark):
    counts = spark.createDataFrame([("en", "a", 10**13, 1), ("en", "b", 10**13, 1), ("en", "a b", 10**13, 2)],
                                   "lang string, phrase string, f long, words int")
    sizes = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    assert [r.score for r in C.scored(counts, sizes).collect()] == [1000 * 10**13 * 10**14 // 10**26]


def test_intervals_are_those_of_the_text():
    draw = np.random.default_rng(5)
    for _ in range(20):
        words = draw.integers(0, 6, 400)
        kept = np.unique(words[words > 0])[:4]
        cyclic = C.without_rare(words, kept)
        rank = {int(w): i + 1 for i, w in enumerate(kept)}
        mapped = [rank.get(int(w), 0) for w in words]
        first, source = C.last_to_first(cyclic, 5)
        held = first - 1
        source = np.where(held >= 0, source, -1)
        phrases = [(i + 1,) for i in range(len(kept))]
        for d in range(2, 6):
            source, held = C.compact(source, held)
            start, count, before, after = C.extend(source, held)
            longer = [phrases[a] + phrases[b][-1:] for a, b in zip(before, after, strict=True)]
            want = Counter(tuple(mapped[i:i + d]) for i in range(len(mapped) - d + 1) if 0 not in mapped[i:i + d])
            assert dict(zip(longer, count.tolist(), strict=True)) == want
            held = np.full(len(source), -1)
            for k, (s, c) in enumerate(zip(start, count, strict=True)):
                held[s:s + c] = k
            phrases = longer


def test_memory_of_a_shard():
    words = np.random.default_rng(3).integers(0, 50_000, 400_000).astype(np.int32)
    kept = C.without_rare(words, np.arange(1, 50_000))
    tracemalloc.start()
    try:
        C.last_to_first(kept, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 * len(kept)


def test_rows_of_a_shard_go_out_in_batches():
    n = 2 * C.BATCH_ROWS + 5
    names = C.pa.array([f"w{i}" for i in range(n)])
    batches = C.word_rows(7, "en", np.ones(n, np.int64), names, b"sequence")
    assert [b.num_rows for b in batches] == [1, C.BATCH_ROWS, C.BATCH_ROWS, 5]
    rows = C.pa.Table.from_batches(batches).to_pylist()
    assert rows[0] == {"shard": 7, "lang": "en", "start": -1, "n": 0, "word": None, "data": b"sequence"}
    assert [(r["start"], r["n"], r["word"], r["data"]) for r in rows[1:]] == [(i + 1, 1, f"w{i}", None) for i in range(n)]


def test_packed_numbers():
    for x in ([], [0], [5, 2**30, 0, 70_000], [-1, 2**40, -2**40], list(range(300))):
        a = np.array(x, np.int64)
        assert C.unpack(C.pack(a)).tolist() == x
        assert C.unpack_steps(C.pack_steps(a)).tolist() == x


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    got = C.op13_collocations(spark, "/root/testdata/sf0.01")
    assert table_of(got.collect()) == table_of(con.sql(f"SELECT {', '.join(got.columns)} FROM ({C.SQL})").fetchall())
