"""Quality rules: measurements against loops over the text, policies and ablation against the rows."""
import random
import re
from collections import Counter

import pytest
from data import hard_docs, no_docs, table_of
from pyspark.sql import functions as F

from logsieve.llm import quality_rules as Q
from logsieve.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    found = Counter(windows)
    covered = {j for i, w in enumerate(windows) if found[w] > 1 for j in range(i, i + 3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered),
            sum("A" <= c <= "Z" for c in text), sum(c.isalpha() and c.isascii() or c > "\x7f" for c in text))


def test_measurements_by_hand(spark):
    rows = table(spark, SF, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in Q.measure(table(spark, SF, "documents")).collect()}
    assert got == {r.doc_id: by_hand(r.text or "") for r in rows}


def test_random_texts():
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choice("ab é#A<\t \n\r\x0b\x0c\x1c\x85\xa0日1") for _ in range(draw.randrange(120)))
        assert Q.measurements(text.encode()) == by_hand(text)


def test_hard_tables(spark):
    docs = hard_docs(spark)
    out = Q.apply_policy(Q.ledger(docs), Q.POLICIES["v2"])
    texts = [(r.doc_id, *by_hand(r.text or "")) for r in docs.collect()]
    assert table_of(out.select("doc_id", *Q.MEASURES).collect()) == table_of(texts)
    assert not any(r.kept for r in out.collect() if r.n_words < 50)
    assert Q.ledger(no_docs(spark)).count() == 0


def test_policies_and_ablation(spark):
    docs = table(spark, SF, "documents").unionByName(table(spark, SF, "documents").withColumn("doc_id", F.lit(None).cast("long")))
    entries = Q.ledger(docs)
    rows = entries.collect()
    bit = {r.name: 1 << k for k, r in enumerate(Q.RULES)}
    want = []
    for policy, names in Q.POLICIES.items():
        fails = [{n for n in names if r.fail_bits & bit[n]} for r in rows]
        assert sum(not f for f in fails) == Q.apply_policy(entries, names).filter("kept").count()
        for n in names:
            want.append((policy, n, len(rows), sum(n in f for f in fails), sum(f == {n} for f in fails),
                         sum(not f for f in fails), sum(f <= {n} for f in fails)))
    assert table_of(Q.ablation(entries).collect()) == table_of(want)
    empty = Q.ablation(Q.ledger(no_docs(spark)), {"one": ("symbols",)}).collect()
    assert [tuple(r) for r in empty] == [("one", "symbols", 0, 0, 0, 0, 0)]
    assert Q.ablation(entries, {}).count() == 0


def test_own_rules(spark):
    rules = (Q.Rule("short", "n_words < 3"), Q.Rule("lines", "n_lines > 1"))
    docs = spark.createDataFrame([(1, "a b"), (2, "a b c\nd"), (3, "a b c")], "doc_id int, text string")
    bits = {r.doc_id: r.fail_bits for r in Q.ledger(docs, rules).collect()}
    assert bits == {1: 1, 2: 2, 3: 0}
    with pytest.raises(ValueError):
        Q.ledger(docs, rules * 40)


def test_clean_documents_stay(spark):
    """Of the labelled documents of good quality that the fixed rules keep, nearly all stay; of the others few do."""
    sf = "/root/testdata/sf0.01"
    out = Q.op11_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    good, bad = out.filter("quality = 1"), out.filter("quality = 0")
    assert good.filter("NOT kept").count() <= 0.01 * good.count()
    assert bad.filter("kept").count() <= 0.2 * bad.count()
