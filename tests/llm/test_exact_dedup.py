import hashlib
import re

from data import ROWS, hard_docs, no_docs, table_of

from logsieve.llm import exact_dedup as ed


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


def check(docs, rows):
    got = ed.exact_dedup(docs).collect()
    assert table_of((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == table_of(brute(rows))
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_hard_rows(spark):
    check(hard_docs(spark), [r[:2] for r in ROWS])
    left = ed.drop_copies(hard_docs(spark))
    assert left.columns == hard_docs(spark).columns
    assert left.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS})
    assert ed.exact_dedup(no_docs(spark)).collect() == [] and ed.drop_copies(no_docs(spark)).collect() == []


def test_hot_contents_are_split_and_merged(spark):
    rows = [(i, "hot  text" if i % 3 else f"text {i // 5}") for i in range(3000)] + [(7, "hot text")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(docs, rows)
    marked = ed.mark_copies(docs)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
