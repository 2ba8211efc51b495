"""Generator, sinks and streaming."""

import os

import numpy as np
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from logsieve.operators.metrics import classification_metrics
from logsieve.operators.parse import parse_labelled
from logsieve.plans.detect import detect
from logsieve.sources import io
from logsieve.sources.generate import DOMAINS, generate_logs
from logsieve.sources.logs import logs_from_events, read_log_lines

from paths import SF001


def test_generator_modes(spark):
    ids = spark.range(400)
    raw = generate_logs(ids, "raw", seed=5).collect()
    assert len(raw) == 400 and all("{" not in r["line"] for r in raw)
    assert all(re.match(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d log_channel\(", r["line"]) for r in raw)
    lab = {r["log_id"]: r["line"] for r in generate_logs(ids, "finetuned", seed=5).collect()}
    assert all(lab[i].endswith("##ANOMALY") == (i % 20 == 0) for i in lab)
    test = generate_logs(ids, "test", seed=5).collect()
    assert sorted(r["position"] for r in test) == list(range(400))
    with pytest.raises(ValueError):
        generate_logs(ids, "bogus")


def test_generator_domains(spark):
    lines = [r["line"] for r in generate_logs(spark.range(3000), "raw", seed=9).collect()]
    osd = [int(m) for line in lines for m in re.findall(r"osd (\d+) is healthy", line)]
    assert osd and min(osd) >= 0 and max(osd) <= 10
    mons = [m for line in lines for m in re.findall(r"mons: (\S+)", line)]
    assert mons and all(len(set(m.split(","))) == 3 for m in mons)
    assert {d[0] for d in DOMAINS} >= {"mon_list", "time_period", "object_name"}


def test_detection_quality_on_generated_logs(spark):
    lines = generate_logs(spark.range(4000), "finetuned", seed=11)
    lab = parse_labelled(lines).select("log_id", "label")
    res = detect(lines.select("log_id", F.split_part("line", F.lit(" ##"), F.lit(1)).alias("line")))
    joined = res.join(lab, "log_id").withColumn("prediction", F.col("combined_anomaly").cast("int"))
    m = classification_metrics(joined, "label", "prediction").first()
    assert m["accuracy"] > 0.9
    rec = joined.filter("label = 1").agg(F.avg("prediction")).first()[0]
    assert rec == 1.0


def test_both_type_is_reached(spark):
    from logsieve.operators.flags import anomaly_type
    lines = generate_logs(spark.range(3000), "test", seed=3).select("log_id", "line")
    res = anomaly_type(detect(lines))
    types = {r["anomaly_type"] for r in res.select("anomaly_type").distinct().collect()}
    assert "Both" in types and "Rule-Based" in types


def test_text_source_and_csv_round_trip(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "logs")
    os.makedirs(d)
    with open(os.path.join(d, "a.log"), "w") as f:
        f.write("2024-01-01 00:00:01 x [ERR]\r\n\r\n  \nNA\n2024-01-01 00:00:02 y, \"q\"")
    lines = read_log_lines(spark, d)
    assert lines.count() == 3
    from logsieve.operators.parse import parse_strict
    parsed = parse_strict(lines)
    out = os.path.join(tmpdir_path, "csv")
    io.write_csv(parsed.select("timestamp", "message"), out)
    back = io.read_parsed_csv(spark, out).collect()
    msgs = sorted((r["message"] or "<null>") for r in back)
    assert msgs == ["<null>", "x [ERR]", 'y, "q"']


def test_metrics_append_is_idempotent(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "metrics")
    df = spark.createDataFrame([(1, 0.5), (2, 0.4)], "chunk int, eval_loss double")
    io.append_metrics(df, path)
    io.append_metrics(df.filter("chunk = 2"), path)
    io.append_metrics(spark.createDataFrame([(3, 0.3)], "chunk int, eval_loss double"), path)
    got = sorted((r["chunk"], r["eval_loss"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 0.5), (2, 0.4), (3, 0.3)]


def test_model_save_load_and_report(spark, tmpdir_path):
    from logsieve.operators.model import fit, positions
    from logsieve.operators.tokens import tokenize
    df = spark.createDataFrame([(i, f"a b {i % 3}") for i in range(30)], "log_id bigint, message string")
    from logsieve.operators.model import loss_table
    from logsieve.operators.tokens import build_vocab
    m = fit(positions(tokenize(df)), weights=(0.1, 0.2, 0.3, 0.4), alpha=0.7)
    vocab = build_vocab(tokenize(df), "tokens")
    io.save_model(m, os.path.join(tmpdir_path, "model"), vocab)
    back = io.load_model(spark, os.path.join(tmpdir_path, "model"))
    assert sorted(back.counts.collect()) == sorted(m.counts.collect())
    assert (back.weights, back.alpha) == ((0.1, 0.2, 0.3, 0.4), 0.7)
    assert sorted(loss_table(back).collect()) == sorted(loss_table(m).collect())
    assert sorted(io.load_vocab(spark, os.path.join(tmpdir_path, "model")).collect()) == sorted(vocab.collect())
    chunked = fit(positions(tokenize(df.withColumn("chunk", (F.col("log_id") % 2 + 1).cast("int"))), "log_id", "tokens", keep=("chunk",)),
                  by=("chunk",))
    io.save_model(chunked, os.path.join(tmpdir_path, "chunked"))
    one = io.load_model(spark, os.path.join(tmpdir_path, "chunked"), chunk=2)
    assert one.by == () and sorted(one.counts.collect()) == sorted(chunked.counts.filter("chunk = 2").drop("chunk").collect())
    assert io.load_model(spark, os.path.join(tmpdir_path, "chunked")).by == ("chunk",)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    res = detect(logs_from_events(ev))
    rp = os.path.join(tmpdir_path, "report")
    io.write_report_rows(res, rp, rows_per_file=400)
    files = sorted(f for f in os.listdir(rp) if f.startswith("part-"))
    html = "".join(open(os.path.join(rp, f)).read() for f in files).splitlines()
    assert len(html) == res.count() and all(h.startswith("<div class='") for h in html)


def test_streaming(spark, tmpdir_path):
    from logsieve.streaming import StoredDetector, detect_stream, flag_stream
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    lines = logs_from_events(ev)
    src = os.path.join(tmpdir_path, "in")
    lines.write.parquet(src)
    stream = spark.readStream.schema(lines.schema).parquet(src)
    q = (flag_stream(stream).writeStream.format("memory").queryName("flags_out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM flags_out").first()[0] == lines.count()
    det = StoredDetector.fit(lines)
    sink = os.path.join(tmpdir_path, "sink")
    q2 = detect_stream(spark.readStream.schema(lines.schema).parquet(src), det, sink,
                       os.path.join(tmpdir_path, "ckpt"))
    q2.awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == lines.count()
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    for i in range(3):
        det.score_batch(lines.filter(f"log_id % 3 = {i}")).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    batch = {r["log_id"]: r["anomaly_score"] for r in detect(lines).collect()}
    streamed = {r["log_id"]: r["anomaly_score"] for r in out.collect()}
    assert streamed == batch


def test_read_metrics_and_tables(spark, tmpdir_path):
    from logsieve.operators.metrics import join_metrics, metric_series, overall_metrics
    d = tmpdir_path
    with open(os.path.join(d, "eval_metrics.csv"), "w") as f:
        f.write("eval_loss,eval_accuracy,eval_precision,eval_recall,eval_f1,eval_runtime,"
                "eval_samples_per_second,eval_steps_per_second,epoch,chunk\n")
        f.write("0.5,0.8,0.9,0.8,0.85,10.0,2.0,0.5,5.0,1\n0.4,0.9,0.95,0.9,0.9,11.0,2.1,0.6,5.0,2\n")
    with open(os.path.join(d, "train_loss.csv"), "w") as f:
        f.write("chunk,avg_train_loss\n1,0.6\n2,0.45\n")
    with open(os.path.join(d, "learning_rate_log.csv"), "w") as f:
        f.write("chunk,avg_learning_rate\n1,1.5e-05\n2,1.5e-05\n")
    m = io.read_metrics(spark, d)
    assert m["eval"].schema["chunk"].dataType.simpleString() == "int"
    ov = {r["Metric"]: r["Value"] for r in overall_metrics(m["eval"]).collect()}
    assert ov == {"Accuracy": 0.85, "Precision": 0.93, "Recall": 0.85, "F1-Score": 0.88}
    j = {r["chunk"]: r["avg_train_loss"] for r in join_metrics(m["eval"], m["train_loss"]).collect()}
    assert j == {1: 0.6, 2: 0.45}
    assert metric_series(m["eval"], m["train_loss"], m["learning_rate"]).count() == 14


def test_ids_follow_file_order(spark, tmpdir_path):
    """Three files, the middle one largest: Spark packs by size, ids go by path."""
    d = os.path.join(tmpdir_path, "files")
    os.makedirs(d)
    want = []
    for name, n in (("a.log", 3), ("b.log", 4000), ("c.log", 5)):
        rows = [f"{name} line {i}" for i in range(n)]
        want += rows
        with open(os.path.join(d, name), "w") as f:
            f.write("\n \n".join(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = sorted((r["log_id"], r["line"]) for r in read_log_lines(spark, d).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(enumerate(want))


def test_sinks_and_options(spark, tmpdir_path):
    from logsieve.operators.metrics import classification_metrics
    from logsieve.operators.model import positions, score, token_losses
    from logsieve.operators.prep import train_test_split
    from logsieve.operators.scorers import make_token_log1p, score_with
    from logsieve.operators.tokens import build_vocab, encode, tokenize
    from logsieve.plans import finetune as ft
    df = spark.createDataFrame([(i, f"a b{i % 3} c", i % 2) for i in range(60)], "log_id bigint, message string, label int")
    toks = tokenize(df)
    enc = encode(toks, build_vocab(toks, "tokens"), "log_id", "tokens", max_length=8)
    path = os.path.join(tmpdir_path, "encoded")
    io.write_encoded(enc, path)
    assert sorted(io.read_encoded(spark, path).collect()) == sorted(enc.collect())
    per = score_with(enc, make_token_log1p, per_token=True, max_length=8).first()
    assert len(per["score"]) == 8 and abs(per["score"][0] - np.log1p(2)) < 1e-9
    res = detect(logs_from_events(spark.read.parquet(f"{SF001}/events.parquet")), keep_top_tokens=True)
    for fmt in ("parquet", "csv"):
        out = os.path.join(tmpdir_path, fmt)
        io.write_results(res, out, fmt)
        assert spark.read.format(fmt).load(out).count() >= res.count()
    part = train_test_split(df, "log_id", 0.3, exact=False).filter("is_test").count()
    assert 5 < part < 35
    mean = score(token_losses(positions(toks, "log_id", "tokens")), denominator="tokens").agg(F.min("anomaly_score")).first()[0]
    assert mean > 0
    train, test = ft.prepare(df, 2, seed=1)
    normal = ft.fit_finetune(None, train, 2, label_filter="label = 0")
    assert normal.counts.agg(F.sum("n")).first()[0] < ft.fit_finetune(None, train, 2).counts.agg(F.sum("n")).first()[0]
    own = ft.evaluate_chunks(normal, ft.masked_eval_positions(test, seed=1, p=0.9), 2,
                             metrics=lambda d: classification_metrics(d, by=["chunk"], ignore_label=None, weight="m").select("chunk", "f1"))
    assert set(own.columns) == {"chunk", "eval_loss", "eval_f1"} and own.count() == 2
