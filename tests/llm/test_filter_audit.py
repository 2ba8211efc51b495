"""Filter audit: the removal table and every count against filters applied one after the other."""
import re
from itertools import permutations

import duckdb
import numpy as np
from data import hard_docs, no_docs, table_of
from pyspark.sql import functions as F

from logsieve.llm import filter_audit as A
from logsieve.llm.common import table

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def fails(text, doc_id, copies):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    ids = [i for i in copies[text] if i is not None]
    return ("A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
            + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
            + "E" * (doc_id is not None and any(i < doc_id for i in ids)))


def one_by_one(docs, labels):
    """docs: (doc_id, text, part); every order applied document by document."""
    copies = {}
    for i, t, _ in docs:
        copies.setdefault(t, []).append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failing = [(p, fails(t, i, copies), i in good, i in toxic) for i, t, p in docs]
    out = []
    for part in {p for p, *_ in failing}:
        own, rows, total = [x for x in failing if x[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                rows.append([part, "".join(order), step, len(left), len(gone),
                             sum(f in x[1] for x in own) - len(gone) - sum(f in x[1] for x in left),
                             sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        out += [(*r, total[r[1][r[2] - 1]]) for r in rows]
    return out


def test_removal_table_is_the_min_plus_product():
    t = A.removal_tables(4)
    for o, order in enumerate(permutations(range(4))):
        assert tuple(t["orders"][o]) == order
        for mask in range(16):
            hit = [k for k, f in enumerate(order) if mask >> f & 1]
            assert t["steps"][mask, o] == (hit[0] if hit else 4)
            assert [k for k in range(4) if t["removes"][mask, o, k]] == hit[:1]
            assert [k for k in range(4) if t["repeats"][mask, o, k]] == hit[1:]
    assert np.all(t["removes"].sum(axis=2) <= 1)


def audited(docs, labels):
    return A.audit(A.mask_counts(A.with_copies(A.masked(docs)), labels))


def test_hard_tables_one_by_one(spark):
    docs = hard_docs(spark)
    copies = docs.filter("doc_id = 6").withColumn("doc_id", F.lit(60)).withColumn("source", F.lit("t"))
    docs = docs.unionByName(copies).unionByName(copies.withColumn("doc_id", F.lit(None).cast("long")))
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (60, 1, 1), (2, 0, 1), (None, 1, 1), (99, 1, 1), (11, None, None)]
    got = audited(docs, spark.createDataFrame(labels, LABELS)).collect()
    want = one_by_one([(r.doc_id, r.text or "", r.source or "") for r in docs.collect()], labels)
    assert len(got) == 3 * 600
    assert table_of(got) == table_of(want)


def test_no_documents_and_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert audited(no_docs(spark), none).count() == 0
    out = audited(hard_docs(spark), none)
    assert out.count() == 2 * 600
    assert out.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ["documents", "labels"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = A.op12_filter_audit(spark, SF)
    assert table_of(got.collect()) == table_of(con.sql(f"SELECT {', '.join(got.columns)} FROM ({A.SQL})").fetchall())


def test_no_text_and_no_python_beyond_the_first_scan(spark):
    rows = A.masked(table(spark, SF, "documents"))
    assert "text" not in rows.columns
    assert "Python" not in A.with_copies(rows)._jdf.queryExecution().executedPlan().toString()
