"""Lookups that leave rows of frequent keys where they are, and scores from packed places."""

from collections import Counter

from pyspark.sql import functions as F

from logsieve.functions.text import tokenize_expr
from logsieve.operators import model as M
from logsieve.operators.joins import apart_join
from logsieve.operators.tokens import encode_subword, split_words_greedily, tokenize
from logsieve.session import written

ROWS = [(i, ["a b c", "a b c d", f"a user {i % 7} x", "", "a a a a"][i % 5]) for i in range(60)]


def found(df):
    return Counter(map(tuple, df.collect()))


def sequences(spark):
    return tokenize(spark.createDataFrame(ROWS, "log_id long, message string"))


def test_frequent_contexts_are_not_shuffled(spark):
    pos = M.positions(sequences(spark))
    losses = M.token_losses(pos, max_hot=20)
    assert "LeftAnti" in losses._jdf.queryExecution().optimizedPlan().toString()
    want = pos.join(M.loss_table(M.fit(pos)).drop("m"), ["l", "t", "r"])
    assert found(losses) == found(want.select(*losses.columns))


def test_apart_join_repeated_and_null_keys(spark):
    big = spark.createDataFrame([(i, None if i % 11 == 0 else "k" if i % 3 else f"k{i % 5}") for i in range(50)] * 2, "i int, k string")
    keyed = written(big.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("m")).withColumn("v", F.concat("k", F.lit("!"))))
    for max_hot in (1, 3, 1000):
        assert found(apart_join(big, keyed, ["k"], "m", max_hot)) == found(big.filter("k IS NOT NULL").withColumn("v", F.concat("k", F.lit("!"))))


def test_packed_scores_are_the_scores(spark):
    toks = sequences(spark)
    losses = written(M.token_losses(M.positions(toks)))
    losses = losses.unionByName(spark.createDataFrame([(-1, 1, None, "[CLS]", None, -0.000001), (-1, 2, None, "[SEP]", None, 1.25)], losses.schema))
    for kind in ("max_length", "tokens"):
        want = M.score(losses, denominator=kind).filter("log_id >= 0").select("log_id", "anomaly_score", F.concat_ws(" ", "top_tokens"))
        packed = M.score_rounded(losses, denominator=kind)
        got = toks.join(packed, "log_id").select("log_id", "anomaly_score",
                                                 F.concat_ws(" ", M.tokens_at(tokenize_expr(F.col("message")), F.col("_top"))))
        assert found(got) == found(want)
        assert found(packed.filter("log_id < 0").select("anomaly_score")) == found(M.score(losses, denominator=kind).filter("log_id < 0").select("anomaly_score"))


def test_messages_are_dealt_once_before_they_are_scored(spark):
    """The messages' tokens come from one exchange by number, also read by the join with the scores; equal and null
    messages and those without words are scored as before."""
    from logsieve.plans.detect import score_messages
    rows = [(i, m) for i, m in ROWS] + [(i + 60, m) for i, m in ROWS] + [(200, None), (201, " ")]
    logs = spark.createDataFrame(rows, "log_id long, message string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = score_messages(logs)
        plan = scored._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt = [line for line in plan if "REPARTITION_BY_NUM" in line]
        assert sum("ReusedExchange" not in line for line in dealt) == 1 and len(dealt) == 3
        assert "hashpartitioning(_mid" in dealt[0]
        got = found(scored.select("message", "anomaly_score", F.concat_ws(" ", "top_tokens")))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    toks = tokenize(logs.filter("message IS NOT NULL"))
    each = M.score(M.token_losses(M.positions(toks)))
    want = toks.join(each, "log_id").select("message", "anomaly_score", F.concat_ws(" ", "top_tokens")).distinct()
    assert got == found(want)


def test_other_contexts_are_summed_beside_the_models(spark):
    """A model without summed tables gives the same estimates, also for contexts and tokens that it never saw."""
    pos = M.positions(sequences(spark))
    model = M.fit(pos.filter("log_id % 3 > 0"))
    held = written(pos.filter("log_id % 3 = 0").groupBy("l", "t", "r").agg(F.count(F.lit(1)).alias("m"))
                   .unionByName(spark.createDataFrame([("new", "newer", "newest", 2)], "l string, t string, r string, m long")))
    assert "Window" in M.looked_up(model, held)._jdf.queryExecution().optimizedPlan().toString()
    assert found(M.components(model, held)) == found(M.components(model.summed(), held))


def test_stream_losses_by_own_and_unseen_contexts(spark):
    """Frequent contexts of the model are not shuffled, and only contexts that it never saw look up marginals; all
    losses are those of the batch plan."""
    import re

    from logsieve.streaming.scoring import score_stream
    pos = M.positions(sequences(spark))
    model = M.fit(pos.filter("log_id % 3 > 0")).summed()
    new = spark.createDataFrame([(-1, "a new b"), (-2, "never seen"), (-3, "a b c")], "log_id long, message string")
    pos = pos.unionByName(M.positions(tokenize(new)))
    want = found(M.token_losses(pos, model).select("log_id", "l", "t", "r", "loss"))
    for max_hot in (3, 50_000):
        got = M.loss_of(model, pos.select("log_id", "l", "t", "r"), max_hot=max_hot)
        assert found(got.select("log_id", "l", "t", "r", "loss")) == want
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i % 10} {m}") for i, m in ROWS if m], "log_id long, line string")
    scored = score_stream(lines, model)
    want = M.score(M.token_losses(M.positions(sequences(spark).filter("message != ''")), model)).select("log_id", "anomaly_score")
    assert found(scored.select("log_id", "anomaly_score")) == found(want)
    texts = lines.select("log_id", F.substring("line", 1, 19), F.substring("line", 21, 99))
    assert found(scored.select("log_id", "timestamp", "message")) == found(texts)
    # the text of a line goes through no join but as the head of its first position
    joins = re.findall(r"Join .*", scored._jdf.queryExecution().optimizedPlan().toString())
    assert joins and not any("message" in j for j in joins)


def greedy(word, pieces):
    out, at = [], 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if "##" * (at > 0) + word[at:at + k] in pieces), None)
        if size is None:
            return ["[UNK]"]
        out.append("##" * (at > 0) + word[at:at + size])
        at += size
    return out


def test_short_pieces_need_no_lookup_and_frequent_words_stay(spark):
    pieces = ["a", "##a", "ab", "##ab", "abc", "##b", "##bcd", "b", "##", "###", "###a", "é", "##\U0001f600", "\U0001f600a", "abc"]
    words = ["a", "b", "ab", "abc", "abcd", "abab", "aabcd", "c", "ac", "##", "##a", "a##", "éa", "é\U0001f600", "\U0001f600ab", "bcd"]
    table = spark.createDataFrame([(p,) for p in pieces], "piece string")
    split = split_words_greedily(spark.createDataFrame([(w,) for w in words], "word string"), table)
    assert {r.word: r.wp for r in split.collect()} == {w: greedy(w, set(pieces)) for w in words}
    rows = [(i, [words[(i * k) % len(words)] for k in range(i % 9)] or None) for i in range(40)]
    out = encode_subword(spark.createDataFrame(rows, "log_id long, tokens array<string>"), table)
    assert "LeftAnti" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.log_id: r.pieces for r in out.collect()} == {i: [p for w in ws or [] for p in greedy(w, set(pieces))] for i, ws in rows}
