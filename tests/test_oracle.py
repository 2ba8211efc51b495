"""Registered queries against their DuckDB twins at sf0.001 (the driver's check
runs all of them at sf0.01; LOGSIEVE_ALL_ORACLE=1 runs all here too)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from paths import SF001

SUBSET = ["event_logs", "parse_positional", "parse_labelled", "detect", "top_tokens", "explanations",
          "vocabulary", "encoded", "masked_examples", "split_rows", "chunks_drop", "eval_by_chunk",
          "gen_test", "weighted_metrics", "report_rows", "tokens", "subword_tokens", "threshold", "chunks_keep",
          "heatmap_long", "parsed_null_tokens", "detect_stored", "word_meanings", "shuffled_logs", "predictions"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("LOGSIEVE_ALL_ORACLE") else SUBSET


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["events", "documents", "embeddings", "conversations", "labels"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    a = sorted((tuple(norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    di = [rel.columns.index(c) for c in order]
    b = sorted((tuple(norm(r[i]) for i in di) for r in rel.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["log_id", "timestamp", "message"]
