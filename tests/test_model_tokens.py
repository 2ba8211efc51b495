"""Tokens, encoding, masking, the count model and its properties."""

import math

import pytest
from pyspark.sql import functions as F

from logsieve.operators import model as M
from logsieve.operators.joins import frequency_split_join
from logsieve.operators.tokens import build_vocab, decode, encode, mask_tokens, split_words_greedily, tokenize
from logsieve.plans.detect import detect, score_logs
from logsieve.sources.logs import logs_from_events

from paths import SF001


def texts(spark):
    rows = [(1, "Hello, World! a [ERR] b"), (2, ""), (3, "x " * 80), (4, "Déjà vu: ÉTÉ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_tokenize(spark):
    got = {r["doc_id"]: r["tokens"] for r in tokenize(texts(spark), "text").collect()}
    assert got[1] == ["hello", ",", "world", "!", "a", "[", "err", "]", "b"]
    assert got[2] == []
    assert got[4] == ["deja", "vu", ":", "ete"]
    hard = "“quoted”—dash 日本語 café a\u00a0b x\u200by\u0301 $5+3 Ångström ИЙ"
    got = tokenize(spark.createDataFrame([(hard,)], "text string"), "text").first()["tokens"]
    assert got == ["“", "quoted", "”", "—", "dash", "日", "本", "語", "cafe", "a", "b", "xy", "$", "5", "+", "3", "angstrom", "ии"]


def test_encode_decode_mask(spark):
    toks = tokenize(texts(spark), "text")
    vocab = build_vocab(toks, "tokens", max_size=12)
    enc = encode(toks, vocab, "doc_id", "tokens")
    rows = {r["doc_id"]: r for r in enc.collect()}
    n_tok = {r["doc_id"]: len(r["tokens"]) for r in toks.collect()}
    for k, r in rows.items():
        assert len(r["input_ids"]) == 64 and len(r["attention_mask"]) == 64
        assert sum(r["attention_mask"]) == min(n_tok[k], 62) + 2
        assert r["input_ids"][0] == 2
    assert rows[2]["input_ids"][:3] == [2, 3, 0]
    dec = {r["doc_id"]: r["decoded"] for r in decode(enc, vocab, "doc_id").collect()}
    known = {r["token"] for r in vocab.collect()}
    for k, toks_k in {r["doc_id"]: r["tokens"] for r in toks.collect()}.items():
        body = dec[k][1:1 + min(len(toks_k), 62)]
        assert body == [t if t in known else "[UNK]" for t in toks_k[:62]]
    m = mask_tokens(enc, 12, "doc_id", seed=1, p=0.5).collect()
    for r in m:
        orig = rows[r["doc_id"]]["input_ids"]
        for x, y, lab in zip(orig, r["input_ids"], r["labels"]):
            if lab == -100:
                assert x == y
            else:
                assert lab == x and x >= 5


def greedy(word, pieces):
    out, start = [], 0
    while start < len(word):
        mark = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if mark + word[start:e] in pieces), None)
        if end is None:
            return ["[UNK]"]
        out.append(mark + word[start:end])
        start = end
    return out


def test_word_pieces(spark):
    import random
    rnd = random.Random(8)
    some = lambda n: {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(n)}
    pieces = {"un", "##aff", "##able", "a", "##b"} | some(6) | {"##" + p for p in some(9)}
    words = ["unaffable", "ab", "zz", "##", "#", *{"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(80)}]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    table = spark.createDataFrame([(p,) for p in pieces], "piece string")
    got = {r["word"]: r["wp"] for r in split_words_greedily(df, table).collect()}
    assert got == {w: greedy(w, pieces) for w in words}
    short = {r["word"]: r["wp"] for r in split_words_greedily(df, table, max_chars=3).collect()}
    assert short["unaffable"] == ["[UNK]"] and short["ab"] == got["ab"]


def test_frequency_split_join_equals_plain_join(spark):
    big = spark.range(20000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)).alias("k"), "id")
    keyed = big.groupBy("k").agg(F.count("*").alias("m")).withColumn("v", F.col("k") * 10)
    a = frequency_split_join(big, keyed, ["k"], "m", max_hot=5).select("id", "v")
    b = big.join(keyed.drop("m"), "k").select("id", "v")
    assert sorted(a.collect()) == sorted(b.collect())


def test_scores_do_not_depend_on_partitioning(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    lines = logs_from_events(ev)
    from logsieve.operators.parse import drop_blank, parse_positional
    logs = drop_blank(parse_positional(lines))
    a = {r["log_id"]: r["anomaly_score"] for r in score_logs(logs).collect()}
    b = {r["log_id"]: r["anomaly_score"] for r in score_logs(logs.repartition(13).orderBy(F.rand(3))).collect()}
    assert a == b


def test_fit_chunks_last_equals_full_fit(spark):
    rows = [(i, f"a b c{i % 4} d", i % 3 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "log_id bigint, message string, chunk int")
    pos = M.positions(tokenize(df), "log_id", "tokens", keep=("chunk",))
    base_rows = spark.createDataFrame([(100 + i, f"a x{i}") for i in range(10)], "log_id bigint, message string")
    base = M.fit(M.positions(tokenize(base_rows)))
    cum = M.fit_chunks(base, pos, 3).counts.filter("chunk = 3").drop("chunk")
    full = M.fit(M.positions(tokenize(df.drop("chunk").unionByName(base_rows)))).counts
    assert sorted(cum.collect()) == sorted(full.collect())


def test_detect_properties(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    res = detect(logs_from_events(ev, "messy"), threshold_method="exact").collect()
    assert res
    for r in res:
        assert r["combined_anomaly"] == (r["is_anomaly"] or r["rule_based_flag"])
        if r["is_whitelisted"]:
            assert not r["is_anomaly"] and not r["rule_based_flag"]
        assert 0.0 <= r["confidence_score"] <= 1.0
    texts_seen = {r["explanation"].split(" ")[0] for r in res}
    assert texts_seen == {"No", "This", "Although"}


def test_top_tokens_fixture(spark):
    losses = spark.createDataFrame([(1, 1, "[CLS]", 9.0), (1, 2, "a", 5.0), (1, 3, "b", 7.0), (1, 4, "[SEP]", 1.0)],
                                   "log_id bigint, pos int, t string, loss double")
    r = M.score(losses).first()
    assert r["top_tokens"] == ["b", "a"]
    assert abs(r["anomaly_score"] - round(22.0 / 64, 6)) < 1e-12


def test_options(spark):
    from logsieve.operators.parse import parse_labelled
    from logsieve.plans.finetune import fit_base
    toks = tokenize(texts(spark), "text", accents=True)
    got = {r["doc_id"]: r["tokens"] for r in toks.collect()}
    assert got[4] == ["déjà", "vu", ":", "été"]
    lab = spark.createDataFrame([(1, "2024-01-01 00:00:01 ok ##NORMAL")], "log_id bigint, line string")
    assert parse_labelled(lab, strip_timestamp=True).first()["message"] == "ok"
    logs = spark.createDataFrame([(i, f"w{i}") for i in range(23)], "log_id bigint, message string")
    last = {r["t"] for r in fit_base(logs, 10, "last_chunk", test_size=0).counts.collect()}
    assert last == {"[CLS]", "[SEP]", "w18", "w19", "w20", "w21", "w22"}
    split = {r["t"] for r in fit_base(logs, 10, "last_chunk").counts.collect()}
    assert split < last and len(split) == 2 + 4


def test_hot_line_third_of_rows(spark):
    """One line holds a third of all rows: the hot contexts are broadcast, the rest
    shuffled, and the scores equal those of a plain join."""
    from logsieve.operators.joins import frequency_split_join as fsj
    rows = [(i, "2024-01-01 00:00:00 log [INF] : same line" if i % 3 == 0
             else f"2024-01-01 00:00:00 log [ERR] : other {i % 17} {i % 5}") for i in range(3000)]
    lines = spark.createDataFrame(rows, "log_id bigint, line string")
    from logsieve.operators.parse import drop_blank, parse_positional
    logs = drop_blank(parse_positional(lines))
    pos = M.positions(tokenize(logs))
    table = M.loss_table(M.fit(pos)).select("l", "t", "r", "m", "loss")
    split = M.score(fsj(pos, table, ["l", "t", "r"], "m", max_hot=20))
    plain = M.score(pos.join(table.drop("m"), ["l", "t", "r"]))
    a = {r["log_id"]: (r["anomaly_score"], tuple(r["top_tokens"])) for r in split.collect()}
    b = {r["log_id"]: (r["anomaly_score"], tuple(r["top_tokens"])) for r in plain.collect()}
    assert a == b and len(a) == 3000


def test_empty_input(spark):
    from logsieve.operators import flags as fl
    lines = spark.createDataFrame([], "log_id bigint, line string")
    assert detect(lines).count() == 0
    empty = spark.createDataFrame([], "anomaly_score double")
    assert fl.score_threshold(empty).first()["threshold"] is None


def test_hot_token_in_nine_of_ten_contexts(spark):
    """One token in 90 % of the contexts: equal losses, and no task holds much more than the others."""
    rows = [(i, f"a{i} hot b{i}" if i % 10 else f"x{i} cold{i} y{i}") for i in range(2000)]
    pos = M.positions(tokenize(spark.createDataFrame(rows, "log_id bigint, message string")), "log_id", "tokens")
    model = M.fit(pos)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tight, loose = (M.loss_table(model, max_hot=h).select("l", "t", "r", "loss") for h in (50, 100_000))
        assert sorted(tight.collect()) == sorted(loose.collect())
        wide = M.own_marginals(model.counts, least_rows=20)
        assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        sizes = [r["n"] for r in wide.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("n_t")).collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes)       # the last of the three exchanges is by t
        keyed = model.marginal("n_t")
        sizes = [r["n"] for r in frequency_split_join(model.counts, keyed, ["t"], "rows", "left", 50)
                 .groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_own_marginals_equal_plain_sums(spark):
    """Heavy single keys, heavy pairs and light keys, with and without models side by side."""
    rows = [(i % 2, f"l{i % 3 if i % 4 else i}", f"t{i % 5 if i % 3 else i}", f"r{i % 2 if i % 5 else i}", 1 + i % 7) for i in range(3000)]
    counts = (spark.createDataFrame(rows, "chunk int, l string, t string, r string, n long")
              .groupBy("chunk", "l", "t", "r").agg(F.sum("n").alias("n")))
    for by in ((), ("chunk",)):
        own = counts if by else counts.drop("chunk").groupBy("l", "t", "r").agg(F.sum("n").alias("n"))
        own = M.written(own)
        want = own
        for name, keys in M.MARGINALS.items():
            want = want.join(own.groupBy(*by, *keys).agg(F.sum("n").alias(name)), [*by, *keys])
        cols = [*by, "l", "t", "r", "n", *M.MARGINALS]
        for least in (30, 10**6):
            got = M.own_marginals(own, by, least).select(*cols)
            assert sorted(got.collect()) == sorted(want.select(*cols).collect())


def test_own_marginals_take_three_exchanges(spark):
    """With no heavy key, with single heavy keys and with heavy pairs: the windows need no exchange of their own."""
    rows = [("a", f"t{i % 7}", f"r{i % 5}") for i in range(400)] + [(f"l{i}", f"t{i}", "z") for i in range(100)]
    counts = M.written(spark.createDataFrame(rows, "l string, t string, r string")
                       .groupBy("l", "t", "r").agg(F.count(F.lit(1)).alias("n")))
    want = counts
    for name, keys in M.MARGINALS.items():
        want = want.join(counts.groupBy(*keys).agg(F.sum("n").alias(name)), keys)
    cols = ["l", "t", "r", "n", *M.MARGINALS]
    want = sorted(want.select(*cols).collect())
    for least in (250_000, 20, 3):
        wide = M.own_marginals(counts, least_rows=least)
        assert wide._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert sorted(wide.select(*cols).collect()) == want


def test_unseen_token_in_half_of_the_contexts(spark):
    """A token that the model never saw stands in half of the scored contexts: the sketch of the scored side
    names it, the losses stay the same and its rows are dealt evenly."""
    seen = spark.createDataFrame([(i, f"a{i % 50} b{i % 7}") for i in range(300)], "log_id bigint, message string")
    new = spark.createDataFrame([(i, f"a{i % 50} never c{i}" if i % 2 else f"b{i % 7} d{i}") for i in range(3000)], "log_id bigint, message string")
    model = M.fit(M.positions(tokenize(seen), "log_id", "tokens"))
    contexts = M.written(M.positions(tokenize(new), "log_id", "tokens").groupBy("l", "t", "r").agg(F.count("*").alias("m")))
    heavy = M.heavy_keys(contexts, {"t": ["t"], "r": ["r"]}, least_rows=200)
    assert not M.heavy_keys(contexts, {"t": ["t"]})
    assert {r["_heavy"] for r in contexts.filter("t = 'never'").select(M.key_hash(["t"]).alias("_heavy")).distinct().collect()} \
        <= {r["_heavy"] for r in heavy["t"].collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cols = ["l", "t", "r", "m", "loss"]
        a, b = (M.loss_table(model, contexts, sketched=x).select(*cols) for x in (True, False))
        assert sorted(a.collect()) == sorted(b.collect())
        share = {}
        for name, found in (("plain", None), ("sketched", heavy["t"])):
            joined = frequency_split_join(contexts, model.marginal("n_t"), ["t"], "rows", "left", 50, found)
            sizes = [r["n"] for r in joined.withColumn("p", F.spark_partition_id()).groupBy("p")
                     .agg(F.count("*").alias("n"), F.max("n_t")).collect()]
            share[name] = max(sizes) / sum(sizes)
        assert share["sketched"] < 0.4 < share["plain"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_weights_by_expectation_maximisation(spark):
    """Each round equals a plain loop, and the held-out loss never rises."""
    seen = spark.createDataFrame([(i, f"a{i % 9} b{i % 4} c{i % 3}") for i in range(200)], "log_id bigint, message string")
    other = spark.createDataFrame([(i, f"a{i % 11} b{i % 5} c{i % 2} x{i % 3}") for i in range(120)], "log_id bigint, message string")
    model = M.fit(M.positions(tokenize(seen), "log_id", "tokens"))
    held = M.written(M.positions(tokenize(other), "log_id", "tokens").groupBy("l", "t", "r").agg(F.count("*").alias("m")))
    got = [tuple(r) for r in M.fit_weights(model, held, rounds=5).orderBy("round").collect()]
    parts = [(r["m"], [r[f"p{k}"] for k in range(1, 5)]) for r in M.components(model, held).collect()]
    w, total = list(M.DEFAULT_WEIGHTS), sum(m for m, _ in parts)
    for i in range(6):
        mixed = [sum(a * b for a, b in zip(w, p)) for _, p in parts]
        loss = sum(m * -math.log(x) for (m, _), x in zip(parts, mixed)) / total
        assert got[i][0] == i and got[i][1:] == pytest.approx((*w, loss), abs=1e-7)
        w = [sum(m * w[k] * p[k] / x for (m, p), x in zip(parts, mixed)) / total for k in range(4)]
    assert all(a[-1] >= b[-1] for a, b in zip(got, got[1:])) and got[0][-1] > got[-1][-1]
    fitted = M.with_weights(model, M.fit_weights(model, held, rounds=2))
    assert sum(fitted.weights) == pytest.approx(1, abs=1e-5) and fitted.weights != M.DEFAULT_WEIGHTS
    none = M.fit_weights(model, held.filter("m < 0"), rounds=1).orderBy("round").collect()
    assert [tuple(r)[1:] for r in none] == [(*M.DEFAULT_WEIGHTS, None)] * 2


def test_own_losses_feed_detection(spark):
    """Losses of the user's own network (here: the length of the token) drive score, tokens and flags."""
    lines = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i} {'long' * i} b [ERR]") for i in range(1, 8)],
                                  "log_id bigint, line string")
    got = {r["log_id"]: r for r in detect(lines, losses=lambda pos: pos.withColumn("loss", F.length("t").cast("double")),
                                          keep_top_tokens=True).collect()}
    assert all(got[i]["top_tokens"][0] == "long" * i for i in range(2, 8))
    assert got[7]["is_anomaly"] and not got[1]["is_anomaly"]
    assert got[3]["anomaly_score"] == round((5 + 12 + 1 + 1 + 3 + 1 + 5) / 64, 6)


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    detect(logs_from_events(spark.read.parquet(f"{SF001}/events.parquet"))).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_plan_shape(spark):
    """Hot contexts are joined by broadcast; the scan reads only the columns it needs."""
    from logsieve.operators.parse import drop_blank, parse_positional
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    logs = drop_blank(parse_positional(logs_from_events(ev)))
    pos = M.positions(tokenize(logs), "log_id", "tokens")
    plan = M.token_losses(pos)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    scan = logs._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in scan
