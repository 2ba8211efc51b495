"""Number fixtures and independent checks (NumPy percentile, direct-loop metrics)."""

import numpy as np
from pyspark.sql import functions as F

from logsieve.operators import flags as fl
from logsieve.operators.metrics import classification_metrics
from logsieve.operators.prep import chunk, with_global_index


def test_threshold_fixture(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (3.0,), (7.25,)], "anomaly_score double")
    for m in ("exact", "select"):
        thr = fl.score_threshold(df, p=70, method=m).first()["threshold"]
        assert abs(thr - 3.425) < 1e-12
    flagged = fl.flag_scores(df, fl.score_threshold(df, p=70)).filter("is_anomaly").count()
    assert flagged == 1


def test_selected_threshold_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.gamma(2.0, 0.1, 50_000), 6)
    df = spark.createDataFrame([(float(v),) for v in vals], "anomaly_score double").repartition(6)
    for p in (1, 50, 70, 99):
        want = float(np.percentile(vals, p))
        got = fl.score_threshold(df, p=p, method="select").first()["threshold"]
        assert abs(got - want) < 1e-9, (p, got, want)


def test_confidence_constant_scores(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "anomaly_score double")
    assert [r["confidence_score"] for r in fl.confidence(df).collect()] == [0.0, 0.0, 0.0]
    assert fl.flag_scores(df, fl.score_threshold(df)).filter("is_anomaly").count() == 0


def test_chunk_sizes(spark):
    df = spark.range(23).withColumnRenamed("id", "log_id")
    keep = {r["chunk"]: r["count"] for r in chunk(df, 10, ["log_id"], "last").groupBy("chunk").count().collect()}
    assert keep == {**{i: 2 for i in range(1, 10)}, 10: 5}
    drop = {r["chunk"]: r["count"] for r in chunk(df, 5, ["log_id"], "drop").groupBy("chunk").count().collect()}
    assert drop == {i: 4 for i in range(1, 6)}


def test_global_index_is_a_permutation(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id")).repartition(7)
    idx = with_global_index(df, ["k", "id"], "idx", rows_per_partition=600).orderBy("idx").collect()
    assert [r["idx"] for r in idx] == list(range(5000))
    keys = [(r["k"], r["id"]) for r in idx]
    assert keys == sorted(keys)


def test_weighted_metrics_fixture(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (-100, 1)], "label int, prediction int")
    r = classification_metrics(df).first()
    assert abs(r["accuracy"] - 2 / 3) < 1e-12
    assert abs(r["precision"] - 5 / 6) < 1e-12
    assert abs(r["recall"] - 2 / 3) < 1e-12
    assert abs(r["f1"] - 2 / 3) < 1e-12


def test_weighted_metrics_against_loop(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 6, 3000)
    p = np.where(rng.random(3000) < 0.6, y, rng.integers(0, 8, 3000))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "label int, prediction int")
    r = classification_metrics(df).first()
    classes = sorted(set(y))
    n = len(y)
    prec = rec = f1 = 0.0
    for c in classes:
        tp = int(((y == c) & (p == c)).sum())
        s = int((y == c).sum())
        pc = int((p == c).sum())
        pr = tp / pc if pc else 0.0
        rc = tp / s
        prec += s * pr / n
        rec += s * rc / n
        f1 += s * ((2 * pr * rc / (pr + rc)) if pr + rc else 0.0) / n
    assert abs(r["accuracy"] - (y == p).mean()) < 1e-12
    assert abs(r["precision"] - prec) < 1e-12
    assert abs(r["recall"] - rec) < 1e-12
    assert abs(r["f1"] - f1) < 1e-12


def test_cross_entropy_and_argmax(spark):
    from logsieve.functions.numeric import argmax, cross_entropy
    rows = [([0.1, 2.0, -1.0, 2.0], 1), ([5.0, 1.0, 0.0, -3.0], 3)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    got = df.select(cross_entropy(F.col("x"), F.col("y")).alias("ce"), argmax(F.col("x")).alias("am")).collect()
    for (x, y), r in zip(rows, got):
        x = np.array(x)
        want = np.log(np.exp(x - x.max()).sum()) + x.max() - x[y]
        assert abs(r["ce"] - want) < 1e-12
        assert r["am"] == int(np.argmax(x))


def test_exact_split_matches_global_numbering(spark):
    from logsieve.functions.hashing import h01
    from logsieve.operators.prep import train_test_split
    df = spark.range(5000).withColumnRenamed("id", "log_id").repartition(5)
    got = {r["log_id"] for r in train_test_split(df, "log_id", 0.2, seed=4).filter("is_test").collect()}
    hs = sorted((r["h"], r["log_id"]) for r in df.select(h01(4, "split", F.col("log_id")).alias("h"), "log_id").collect())
    assert got == {k for _, k in hs[:1000]}
    none = spark.createDataFrame([], "log_id bigint")
    assert train_test_split(none, "log_id", 0.2, seed=4).collect() == []
    tiny = spark.createDataFrame([(3,)], "log_id bigint")
    assert [r["is_test"] for r in train_test_split(tiny, "log_id", 0.2, seed=4).collect()] == [True]


def test_radix_select_of_hard_values(spark):
    """Ties, both signs, zeros, huge and tiny values, infinities; no such rank; no rows."""
    from logsieve.operators.rank import value_at_rank
    rng = np.random.default_rng(1)
    doubles = [0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), -float("inf"), *([2.5] * 500), *rng.normal(size=300).tolist(),
               *(1.0 + np.arange(200) * 2.0**-52).tolist()]
    longs = [0, -1, 2**63 - 1, -2**63, *([7] * 300), *rng.integers(-2**62, 2**62, 300).tolist(), *range(-50, 50)]
    for values, kind in ((doubles, "double"), (longs, "bigint")):
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], f"v {kind}").repartition(3)
        order = sorted(values)
        for k in (0, 1, 250, 400, len(values) // 2, len(values) - 1):
            rank = spark.createDataFrame([(k,)], "rank bigint")
            assert value_at_rank(df, "v", rank).first()["value"] == order[k], (kind, k)
        beyond = spark.createDataFrame([(len(values),)], "rank bigint")
        assert value_at_rank(df, "v", beyond).first()["value"] is None
        assert value_at_rank(df.limit(0), "v", beyond).first()["value"] is None


def test_radix_select_starts_no_job(spark):
    from logsieve.operators.rank import value_at_rank
    df = spark.range(100).withColumn("v", F.col("id") * 1.5)
    group = "lazy-select"
    spark.sparkContext.setJobGroup(group, "")
    value_at_rank(df, "v", spark.range(1).select(F.lit(3).alias("rank")))
    fl.score_threshold(df, "v")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 0


def test_weighted_rows_count_as_many(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (1, 1, 4)], "label int, prediction int, m int")
    each = df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "m")))
    assert classification_metrics(df, weight="m").first() == classification_metrics(each).first()
