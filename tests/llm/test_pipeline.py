"""Stages of the corpus pipeline on their own inputs, and run() against its stages' rules."""
import importlib.util
import os
import re
import zlib
from array import array

import pytest
from data import hard_docs, no_docs

SF = "/root/testdata/sf0.01"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def pipeline():
    spec = importlib.util.spec_from_file_location("corpus_pipeline", f"{ROOT}/corpus_pipeline.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def test_run_against_brute_force(spark, pipeline, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from logsieve.llm import secret_scan, toxicity
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    rows = sorted((r.i, r.t or "") for r in scored.filter(f"severity < {toxicity.REJECT}")
                  .selectExpr("__row.doc_id AS i", "__row.text AS t").collect())
    seen, exact = set(), []
    for i, t in rows:
        if normal(t) not in seen:
            seen.add(normal(t))
            exact.append((i, t))
    sets, parent = [shingles(t) for _, t in exact], list(range(len(exact)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(exact)):
        for b in range(a):
            if sets[a] and 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) + 1e-9 \
                    and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = [exact[k] for k in range(len(exact)) if find(k) == k]
    near = spark.createDataFrame(kept, "doc_id long, text string")
    models = secret_scan.train(near)
    ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in kept:
        out, done = "", 0
        for a, b, _ in secret_scan.all_spans(t, models, secret_scan.MARGIN)[1]:
            if a >= done:
                out += t[done:a] + secret_scan.REPLACEMENT
            done = max(done, b)
        x = [*ids.encode(out + t[done:], add_special_tokens=False).ids, 2]
        want |= {(i, s, min(4096, len(x) - s), zlib.crc32(array("I", x[s:s + 4096]).tobytes()), len(x)) for s in range(0, len(x), 4096)}
    got = pipeline.run(spark, SF).collect()
    assert len(got) == len(want)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == want


def test_stages_take_hard_and_empty_tables(spark, pipeline, tmp_path):
    for make in (hard_docs, no_docs):
        docs = make(spark)
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{make.__name__}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{make.__name__}{k}")
        assert (docs.count() == 0) == (make is no_docs)
