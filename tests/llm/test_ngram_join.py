import random
import re

import numpy as np
from data import ROWS, hard_docs, no_docs, table_of

from logsieve.llm import ngram_join as nj
from logsieve.llm.components import connected_components


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    root = roots(len(rows), pairs)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[k] and rows[j][0] is not None]
        out.append((i, min(ids) if ids else None, links[k]))
    return out


def variants(seed=1, families=12):
    """Families of texts at similarities on both sides of the threshold, and repeated texts."""
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    for f in range(families):
        body = [word() for _ in range(rnd.randint(3, 160))] + passage * (f % 2)
        for _ in range(rnd.randint(1, 10)):
            text = list(body)
            for _ in range(rnd.randint(0, 6)):
                text[rnd.randrange(len(text))] = word()
            rows += [(len(rows) * 3 + 1, " ".join(text))] * 1
        rows.append((len(rows) * 3 + 1, rows[-1][1].upper() + "!"))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = variants(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert table_of(nj.ngram_join(docs).collect()) == table_of(brute(rows))


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 7)
    rnd = random.Random(9)
    body = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        text = list(body)
        for _ in range(rnd.randint(0, 2)):
            text[rnd.randrange(120)] = f"x{rnd.randrange(999)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table_of(nj.ngram_join(docs).collect()) == table_of(brute(rows))


def test_a_large_group_of_near_copies_is_counted_not_compared(spark, monkeypatch):
    """Tight copies, looser ones and a second family in one table, with blocks of 6: all links as by brute force; the
    tight ones are not copied to blocks of their own."""
    monkeypatch.setattr(nj, "BLOCK", 6)
    rnd = random.Random(4)
    body = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(70):
        text = list(body)
        for _ in range(rnd.choice([0, 1, 1, 2, 5, 6])):
            text[rnd.randrange(300)] = f"x{rnd.randrange(9999)}"
        rows += [(len(rows), " ".join(text))] * rnd.choice([1, 1, 2])
    rows += [(1000 + i, " ".join([f"v{j}" for j in range(80)] + [f"y{i}"])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert table_of(nj.ngram_join(docs).collect()) == table_of(brute(rows))
    made = spark.createDataFrame([(c, 100, 5, c < 5) for c in range(100)], "content long, n long, n_far long, far boolean")
    dealt = nj.in_blocks(made, "content").collect()
    assert all(r.lo == 0 for r in dealt)                                   # one block of far members meets the others
    assert sum(r.content >= 5 for r in dealt) == 95
    assert nj.in_blocks(made.filter("NOT far").withColumn("n_far", nj.F.lit(0).cast("long")), "content").count() == 0


def test_hard_rows(spark):
    assert table_of(nj.ngram_join(hard_docs(spark)).collect()) == table_of(
        (i, c if shingles(t) else i, n) for (i, c, n), (_, t) in zip(brute([r[:2] for r in ROWS]), [r[:2] for r in ROWS], strict=True))
    assert nj.ngram_join(no_docs(spark)).collect() == []
    left = nj.keep_one(hard_docs(spark))
    assert left.columns == hard_docs(spark).columns
    # both rows 2 go for row 1; 7 and 8 too; 11 for 6; texts without words stay
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([1, 3, None, 4, 5, 6, 9, None, 10, 12], key=str)
    assert nj.keep_one(no_docs(spark)).collect() == []


def test_prefix_is_the_longest_that_reaches_the_recall():
    d = nj.prefix_length()
    recall = lambda d: 1 - (1 - nj.THRESHOLD**d) ** nj.TREES
    assert recall(d) >= nj.RECALL > recall(d + 1)


def test_common_shingles():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 40))).astype(np.uint64) for _ in range(9)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    others = ~np.eye(9, dtype=bool)
    assert (nj.common_shingles(sets, 9) == want)[others].all()
    assert (nj.common_shingles(sets, 4) == want[:4, 4:]).all()


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)] + [(300 + i, 301 + i) for i in range(64)]
    pairs += [(500, 500 + i) for i in range(1, 40)]
    root = roots(600, pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert got == {n: root[n] for p in pairs for n in p}
    assert connected_components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_gate_counts_in_the_recall(spark):
    for threshold in (0.5, 0.6, 0.7, 0.8, 0.9):
        depth, agree = nj.prefix_length(threshold), nj.agreement(threshold)
        assert nj.least_recall(threshold, nj.TREES, depth, agree) >= (nj.RECALL if depth > 1 else 0.99)
        assert nj.gate_misses(threshold, agree) <= 1e-6
    # similarity 70 / 130: signatures agree in 54 % of the letters on average
    rows = [(2 * i + k, " ".join([f"c{i}x{j}" for j in range(74)] + [f"o{i}y{k}z{j}" for j in range(30)])) for i in range(40) for k in (0, 1)]
    _, classes = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.5)
    assert classes.filter("n_links = 1").count() == len(rows)


def test_branches_end_at_different_lengths():
    """Two branches below five letters: one is connected at eight letters and left alone, the other has to be
    shortened to six before its halves meet; pairs of connected rows are not asked again."""
    label = lambda *letters: int.from_bytes(bytes(letters), "big")
    rows = sorted([(0, label(1, 1, 1, 1, 1, 7, 7, 7))] * 3 + [(1, label(2, 2, 2, 2, 2, 9, x, y)) for x, y in ((1, 1), (1, 1), (4, 5), (4, 5))])
    group, labels = np.array([g for g, _ in rows]), np.array([x for _, x in rows], np.uint64)
    asked = []

    def alike(i, j):
        asked.extend(zip(i.tolist(), j.tolist(), strict=True))
        return np.ones(len(i), bool)

    root, ended = nj.climb(group, labels, alike, 8, 5)
    assert root.tolist() == [0, 0, 0, 3, 3, 3, 3] and ended.tolist() == [8, 8, 8, 6, 6, 6, 6]
    assert (3, 4) in asked and (5, 6) in asked and (3, 5) in asked and (0, 3) not in asked and len(set(asked)) == len(asked)
    # rows that share the shortest prefix only and are not alike stay apart, down to its length
    root, ended = nj.climb(np.zeros(2, int), np.array([label(1, 1, 1, 1, 1, 2, 2, 2), label(1, 1, 1, 1, 1, 3, 3, 3)], np.uint64),
                           lambda i, j: np.zeros(len(i), bool), 8, 5)
    assert root.tolist() == [0, 1] and ended.tolist() == [5, 5]


def test_recall_on_the_shared_table(spark):
    """Every link of a brute-force comparison of all pairs at sf0.001 is found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert table_of(nj.ngram_join(docs).collect()) == table_of(brute(rows))


def test_many_null_identifiers(spark):
    """Null identifiers and repeated rows: no product of rows and contents, each row counted."""
    body = [f"w{i}" for i in range(60)]
    texts = [" ".join(body[:50] + [f"x{k}"] + body[51:]) for k in range(4)] + ["lonely words stand here alone"]
    rows = [(None, texts[i % 5]) for i in range(300)] + [(7, texts[0])] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert table_of(nj.ngram_join(docs).collect()) == table_of(brute(rows))
    assert nj.keep_one(docs).count() == 40 + 60


def test_shingles_equal_for_equal_words_only():
    texts = ["Aa b c d e f", "aa B c,d e--f", "aa b c d e", "b c d e f", "a b", "a  B", "", "é日本 x_1", "É日本\nx_1", "a" * 300, "\U00010400x y"]
    sets = nj.Shingler().sets(texts)
    words = [shingles(t) for t in texts]
    for i in range(len(texts)):
        assert len(sets[i]) == len(words[i])
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(words[i] & words[j])
