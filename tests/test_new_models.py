"""Rank sketches, the growing model store, one-plan streaming, reduced charts and the low-rank scorer."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import lowrank as L
from logsieve.operators import model as M
from logsieve.operators import report as rp
from logsieve.operators import sketch as sk
from logsieve.operators.tokens import MAX_WORD_CHARS, build_vocab, split_words_greedily, tokenize
from logsieve.session import written
from logsieve.sources.logs import logs_from_events
from logsieve.sources.store import KEYS, ModelStore

from paths import SF001


def messages(spark, n, words, start=0):
    rows = [(i, " ".join(f"{w}{i % k}" for w, k in words)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "log_id bigint, message string")


def counts_of(df):
    return M.positions(tokenize(df), "log_id", "tokens")


# ------------------------------------------------------------ sketches
def test_sketches_merge_to_the_whole(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 1000 != 0, F.pow(F.rand(3), 3)).alias("anomaly_score"))
    df = written(df)
    days = sk.rank_sketches(df, ["day"])
    assert {r["day"]: r["n"] for r in days.collect()} == {r["day"]: r["count"] for r in df.filter("anomaly_score IS NOT NULL").groupBy("day").count().collect()}
    for p in (1, 50, 70, 99.5):
        whole = sk.sketch_thresholds(sk.merged(days), p).first()
        exact = np.percentile([r[0] for r in df.filter("anomaly_score IS NOT NULL").select("anomaly_score").collect()], p)
        got = sk.rank_errors(df, sk.sketch_thresholds(days, p), ["day"], p)
        assert got.count() == 7 and got.agg(F.max("error")).first()[0] <= sk.RANK_ERROR
        assert abs(df.filter(F.col("anomaly_score") <= whole["threshold"]).count() / whole["n"] - p / 100) <= sk.RANK_ERROR
        assert whole["threshold"] == pytest.approx(exact, abs=0.05)
    none = sk.rank_sketches(df.filter("day > 9"), [])
    assert sk.merged(none).count() == 0
    same = spark.range(100).select(F.lit(0.5).alias("anomaly_score"), F.lit("a").alias("day"))
    ties = sk.sketch_thresholds(sk.rank_sketches(same, ["day"]), 70)
    assert sk.rank_errors(same, ties, ["day"], 70).first()["error"] == 0


# ------------------------------------------------------------ model store
def test_store_merges_to_a_full_fit_and_is_not_exchanged(spark, tmpdir_path):
    one, two = messages(spark, 400, [("a", 9), ("b", 4), ("c", 30)]), messages(spark, 300, [("a", 11), ("b", 3), ("x", 50)], 400)
    three = messages(spark, 100, [("new", 5), ("b", 4)], 700)
    store = ModelStore(spark, "store_test_" + os.path.basename(tmpdir_path).replace("-", "_"), os.path.join(tmpdir_path, "store"))
    store.save(M.fit(counts_of(one), weights=(0.1, 0.2, 0.3, 0.4)), buckets=4)
    store.merge(M.fit(counts_of(two)).counts)
    store.merge(M.fit(counts_of(three)).counts)
    store.merge(M.fit(counts_of(three)).counts.filter("n < 0"))          # nothing new
    whole = M.fit(counts_of(one.unionByName(two).unionByName(three)), weights=(0.1, 0.2, 0.3, 0.4))
    again = ModelStore(spark, store.name, store.path)
    got = again.model()
    assert got.weights == whole.weights
    assert sorted(got.counts.select("l", "t", "r", "n").collect()) == sorted(whole.counts.select("l", "t", "r", "n").collect())
    for name in M.MARGINALS:
        cols = [*KEYS[name], name, "rows"]
        assert sorted(got.marginal(name).select(*cols).collect()) == sorted(whole.marginal(name).select(*cols).collect())
    assert got.totals().first() == whole.totals().first()
    contexts = written(counts_of(messages(spark, 200, [("a", 13), ("b", 5)], 5)).groupBy("l", "t", "r").agg(F.count("*").alias("m")))
    cols = ["l", "t", "r", "m", "loss"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lookups = M.looked_up(got, contexts, sketched=False)
        plan = lookups._jdf.queryExecution().executedPlan().toString()
        # every join has one exchange, of the contexts; the seven tables of the model are read in their buckets
        assert plan.count("Exchange hashpartitioning") == 7
        assert plan.count("Bucketed: true") >= 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(M.loss_table(got, contexts).select(*cols).collect()) == sorted(M.loss_table(whole, contexts).select(*cols).collect())


def test_store_registers_in_a_new_session(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "store")
    name = "store_other_" + os.path.basename(tmpdir_path).replace("-", "_")
    model = M.fit(counts_of(messages(spark, 50, [("a", 3), ("b", 4)])))
    ModelStore(spark, name, path).save(model, buckets=2)
    for table in KEYS:
        spark.sql(f"DROP TABLE {name}_{table}_v0")                      # as in a catalogue that never had it
    back = ModelStore(spark, name, path).model()
    assert sorted(back.counts.select("l", "t", "r", "n").collect()) == sorted(model.counts.collect())


# ------------------------------------------------------------ streaming
def test_stream_in_one_plan_with_a_moving_threshold(spark, tmpdir_path):
    from logsieve.plans.detect import detect
    from logsieve.streaming.scoring import current_threshold, run_scores, score_stream
    lines = logs_from_events(spark.read.parquet(f"{SF001}/events.parquet"))
    from logsieve.operators.parse import drop_blank, parse_positional
    model = M.fit(counts_of(drop_blank(parse_positional(lines)).filter("log_id % 2 = 0"))).summed()
    src = os.path.join(tmpdir_path, "in")
    lines.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink, state = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "state")
    scored = score_stream(stream, model)
    assert scored.isStreaming
    q = run_scores(scored, sink, state)
    q.awaitTermination()
    got = spark.read.parquet(f"{sink}/scores")
    batches = got.select("batch_id").distinct().count()
    assert batches == 3 and spark.read.parquet(f"{sink}/sketches").count() == 3
    want = {r["log_id"]: r["anomaly_score"] for r in detect(lines, model).collect()}
    assert {r["log_id"]: r["anomaly_score"] for r in got.collect()} == want and got.count() == len(want)
    at = current_threshold(spark, sink, 70).first()
    below = np.mean([s <= at["threshold"] for s in want.values()])
    strictly = np.mean([s < at["threshold"] for s in want.values()])
    assert at["n"] == len(want) and strictly - sk.RANK_ERROR <= 0.7 <= below + sk.RANK_ERROR
    again = run_scores(score_stream(spark.readStream.schema(lines.schema).parquet(src), model), sink, state)
    again.awaitTermination()                                             # nothing new arrives
    assert spark.read.parquet(f"{sink}/scores").count() == len(want)


# ------------------------------------------------------------ charts
def test_reduced_series_by_hand(spark):
    rows = [(i, ["MLM", "Both"][i % 2], f"2024-01-01 00:{i % 60:02d}:{i % 7:02d}" if i % 11 else None, float((i * 37) % 101)) for i in range(500)]
    df = spark.createDataFrame(rows, "log_id long, anomaly_type string, at string, anomaly_score double").withColumn("ts", F.to_timestamp("at"))
    got = {(r["anomaly_type"], r["bucket"]): r for r in rp.series_reduced(df, 10).collect()}
    data = [(r["log_id"], r["anomaly_type"], None if r["ts"] is None else int(r["ts"].timestamp()), r["anomaly_score"]) for r in df.collect()]
    lo, hi = min(s for _, _, s, _ in data if s is not None), max(s for _, _, s, _ in data if s is not None)
    groups = {}
    for i, kind, s, v in data:
        groups.setdefault((kind, -1 if s is None else (s - lo) * 10 // (hi - lo + 1)), []).append((s or 0, i, v))
    assert set(got) == set(groups) and len(got) <= 2 * 11
    for key, points in groups.items():
        points.sort()
        values = [v for _, _, v in points]
        r = got[key]
        assert (r["n"], r["first_score"], r["last_score"], r["least"], r["greatest"]) == (len(points), values[0], values[-1], min(values), max(values))
    assert rp.series_reduced(df.filter("log_id < 0")).count() == 0


# ------------------------------------------------------------ word pieces
def test_long_words_and_heads(spark):
    long = "x" * 200_000
    pieces = ["ab", "a", "b", "##b", "##c", "##bc", "##cab", "x", "##x", "y" * 100, "##" + "z" * 99, "日", "##日本"]
    words = ["abc", "abcab", "b", "c", "日本", "日日本", long, "x" * 100, "x" * 101, "y" * 100, "a" + "z" * 99, "#"]
    table = spark.createDataFrame([(p,) for p in pieces], "piece string")
    got = {r["word"]: r["wp"] for r in split_words_greedily(spark.createDataFrame([(w,) for w in words], "word string"), table).collect()}

    def by_hand(w):
        out, at = [], 0
        while at < len(w) and len(w) <= MAX_WORD_CHARS:
            hit = next((w[at:e] for e in range(len(w), at, -1) if ("##" if at else "") + w[at:e] in pieces), None)
            if hit is None:
                return ["[UNK]"]
            out.append(("##" if at else "") + hit)
            at += len(hit)
        return out or ["[UNK]"]

    assert got == {w: by_hand(w) for w in words}


# ------------------------------------------------------------ low-rank scorer
def test_low_rank_estimates_equal_a_dense_decomposition(spark):
    df = messages(spark, 300, [("a", 2), ("b", 3), ("c", 4)])
    counts = M.fit(counts_of(df)).counts
    model = L.fit_low_rank(counts, rank=4, rounds=15, max_size=24)
    ids = {r["token"]: r["token_id"] for r in model.vocab.collect()}
    assert len(ids) <= 24
    dense = np.zeros((48, 24))
    for r in counts.collect():
        dense[ids[r["l"]], ids[r["t"]]] += r["n"]
        dense[24 + ids[r["r"]], ids[r["t"]]] += r["n"]
    s_c, s_t = dense.sum(1), dense.sum(0)
    a = np.divide(dense, np.sqrt(np.outer(s_c, s_t)), out=np.zeros_like(dense), where=np.outer(s_c, s_t) > 0)
    u, s, vt = np.linalg.svd(a)
    best = (u[:, :4] * s[:4]) @ vt[:4]
    assert np.linalg.norm(model.context @ model.token.T - a) <= np.linalg.norm(best - a) * 1.01 + 1e-9
    assert np.allclose(model.token_sum, s_t) and np.allclose(model.context_sum, s_c)
    whole = L.fit_low_rank(counts, rank=14, rounds=2, max_size=24)
    assert np.allclose(whole.context @ whole.token.T, a, atol=1e-6)
    # with the full rank the estimates are the empirical conditionals
    x = np.array([[2, ids["a1"], ids["b1"], ids["c1"], 3] + [0] * 3], float)
    got = L.token_loss_fn(whole)()(x)[0]
    smooth = (s_t + 1) / (s_t.sum() + 24)
    path = [0, 2, ids["a1"], ids["b1"], ids["c1"], 3, 0]
    want = [-np.log(0.45 * dense[p, t] / s_c[p] + 0.45 * dense[24 + q, t] / s_c[24 + q] + 0.1 * smooth[t])
            for p, t, q in zip(path, path[1:], path[2:], strict=False)]
    assert np.allclose(got[:5], want, atol=1e-5) and not got[5:].any()


def test_low_rank_detection(spark):
    from logsieve.plans.detect import detect
    lines = spark.createDataFrame([(i, f"2024-01-01 00:00:{i % 60:02d} disk {'ok' if i % 50 else 'broken now'} node{i % 5} [ERR]") for i in range(400)],
                                  "log_id bigint, line string")
    from logsieve.operators.parse import parse_positional
    counts = M.fit(counts_of(parse_positional(lines))).counts
    model = L.fit_low_rank(counts, max_size=40)
    got = detect(lines, losses=L.low_rank_losses(model), percentile=95).collect()
    flagged = {r["log_id"] for r in got if r["is_anomaly"]}
    assert len(got) == 400 and flagged == {i for i in range(400) if i % 50 == 0}
    assert detect(lines.filter("log_id < 0"), losses=L.low_rank_losses(model)).count() == 0


def test_held_out_loss_of_the_low_rank_model(spark):
    """Lower than that of single words alone."""
    df = messages(spark, 600, [("a", 9), ("b", 9), ("c", 3)])
    train, held = df.filter("log_id % 5 > 0"), df.filter("log_id % 5 = 0")
    model = L.fit_low_rank(M.fit(counts_of(train)).counts, max_size=64)
    pos = counts_of(held).withColumnRenamed("log_id", "_mid")
    loss = L.low_rank_losses(model)(pos).agg(F.avg("loss")).first()[0]
    ids = {r["token"]: r["token_id"] for r in model.vocab.collect()}
    p = (model.token_sum + 1) / (model.token_sum.sum() + 64)
    alone = np.mean([-np.log(p[ids[r["t"]]]) for r in pos.collect()])
    assert loss < 0.7 * alone


def test_vocabulary_with_times(spark):
    df = spark.createDataFrame([(["a", "b"], 3), (["b"], 2), (None, 9)], "tokens array<string>, n long")
    got = {r["token"]: (r["token_id"], r["count"]) for r in build_vocab(df, times="n").collect() if r["token_id"] > 4}
    assert got == {"b": (5, 5), "a": (6, 3)}


# ------------------------------------------------------------ lifetimes
def test_scratch_tables_go_with_their_block(spark, tmpdir_path):
    from logsieve.plans.detect import detect
    from logsieve.session import scratch
    lines = logs_from_events(spark.read.parquet(f"{SF001}/events.parquet"))
    with scratch(spark) as folder:
        detect(lines).write.parquet(os.path.join(tmpdir_path, "out"))
        with scratch(spark) as inner:
            assert written(spark.range(3)).count() == 3 and inner != folder
        local = folder.removeprefix("file:")
        assert len([f for f in os.listdir(local) if os.path.isdir(os.path.join(local, f))]) >= 4
    assert not os.path.exists(local)
    assert spark.read.parquet(os.path.join(tmpdir_path, "out")).count() == lines.count()
    kept = written(spark.range(3))                                        # outside of a block: as before
    assert kept.count() == 3
