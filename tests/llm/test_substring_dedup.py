import hashlib
import random
import re

from data import ROWS, hard_docs, no_docs, table_of

from logsieve.llm import substring_dedup as sd


def brute(rows, window=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda k, s: (rows[k][0] is None, rows[k][0] or 0, s)
    first = {}
    for k, ws in enumerate(words):
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s:s + window])
            first[w] = min(first.get(w, place(k, s)), place(k, s))
    out = []
    for k, ws in enumerate(words):
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s:s + window])] < place(k, s):
                gone |= set(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((rows[k][0], len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_random_texts_with_shared_passages(spark):
    rnd = random.Random(6)
    passages = [[rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(15, 90))] for _ in range(6)]
    rows = []
    for i in range(90):
        ws = [f"u{rnd.randrange(400)}" for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) - 5)
            ws += p[a:a + rnd.randint(5, 90)] + [f"u{rnd.randrange(400)}" for _ in range(rnd.randint(0, 9))]
        rows.append((1000 - 7 * i, rnd.choice([" ", "\n", " \t"]).join(ws)))
    rows.append((5, "Is onhe. " * 300))
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert table_of(sd.substring_dedup(docs).collect()) == table_of(brute(rows))


def test_hard_rows(spark):
    assert table_of(sd.substring_dedup(hard_docs(spark)).collect()) == table_of(brute([r[:2] for r in ROWS]))
    assert sd.substring_dedup(no_docs(spark)).collect() == []
    kept = {r.doc_id: r.kept for r in sd.substring_dedup(hard_docs(spark), texts=True).collect()}
    assert kept[8] == "" or kept[8].endswith("tail")
    assert kept[7] == ""


def test_documents_are_exchanged_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sd.op6_substring_dedup(spark, "/root/testdata/sf0.001")
        plan.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()
