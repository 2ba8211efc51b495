"""Registered queries: one DataFrame job per operator of the inventory, each with a
DuckDB SQL twin (plans.sql) where SQL can express it.  Every query reads the shared
tables under `sf_dir` in full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.functions.numeric import argmax, cross_entropy
from logsieve.operators import flags as fl
from logsieve.operators import metrics as mt
from logsieve.operators import report as rp
from logsieve.operators.explain import explain_tokens, token_meaning
from logsieve.operators.parse import (coerce_timestamp, drop_blank, null_tokens, parse_labelled,
                                      parse_positional, parse_strict)
from logsieve.operators.tokens import build_vocab, tokenize
from logsieve.plans import sql as S
from logsieve.plans.detect import detect, distinct_messages, scored_logs
from logsieve.session import written
from logsieve.sources.logs import clean_lines, logs_from_events, training_log_from_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lines(spark, sf_dir, view="plain") -> DataFrame:
    return logs_from_events(table(spark, sf_dir, "events"), view)


def as_text(c) -> F.Column:
    """Arrays are reported as space-joined text so both engines compare them alike."""
    return F.array_join(c, " ")


# ---------------------------------------------------------------- sources and parsing
@register("event_logs", S.lines_sql("plain"))
def q_event_logs(spark, sf_dir):
    return lines(spark, sf_dir, "plain")


@register("log_lines", S.clean_sql(S.lines_sql("messy")))
def q_log_lines(spark, sf_dir):
    return clean_lines(lines(spark, sf_dir, "messy"))


@register("parse_strict", S.strict_sql(S.clean_sql(S.lines_sql("messy"))))
def q_parse_strict(spark, sf_dir):
    return parse_strict(clean_lines(lines(spark, sf_dir, "messy")))


@register("parse_positional", S.positional_sql(S.clean_sql(S.lines_sql("messy"))))
def q_parse_positional(spark, sf_dir):
    return parse_positional(clean_lines(lines(spark, sf_dir, "messy")))


@register("parse_labelled",
          "SELECT log_id, split_part(line, '##', 1) AS message, "
          "CAST(CASE WHEN contains(line, '##ANOMALY') THEN 1 ELSE 0 END AS INTEGER) AS label "
          f"FROM ({S.clean_sql(S.lines_sql('labelled'))}) "
          "WHERE contains(line, '##ANOMALY') OR contains(line, '##NORMAL')")
def q_parse_labelled(spark, sf_dir):
    return parse_labelled(clean_lines(lines(spark, sf_dir, "labelled")))


@register("nonblank_logs", S.nonblank_sql(S.positional_sql(S.clean_sql(S.lines_sql("messy")))))
def q_nonblank(spark, sf_dir):
    return drop_blank(parse_positional(clean_lines(lines(spark, sf_dir, "messy"))))


@register("coerce_ts",
          "SELECT log_id, timestamp, CAST(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts "
          f"FROM ({S.nonblank_sql(S.positional_sql(S.clean_sql(S.lines_sql('messy'))))})")
def q_coerce_ts(spark, sf_dir):
    d = drop_blank(parse_positional(clean_lines(lines(spark, sf_dir, "messy"))))
    return d.select("log_id", "timestamp", coerce_timestamp(F.col("timestamp")).alias("ts"))


_NA = ", ".join(S.q(v) for v in (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null"))


@register("parsed_null_tokens",
          f"SELECT log_id, CASE WHEN timestamp IN ({_NA}) THEN NULL ELSE timestamp END AS timestamp, "
          f"CASE WHEN message IN ({_NA}) THEN NULL ELSE message END AS message "
          f"FROM ({S.positional_sql(S.clean_sql(S.lines_sql('messy')))})")
def q_parsed_null_tokens(spark, sf_dir):
    d = parse_positional(clean_lines(lines(spark, sf_dir, "messy")))
    return d.select("log_id", null_tokens(F.col("timestamp")).alias("timestamp"),
                    null_tokens(F.col("message")).alias("message"))


@register("rule_flags",
          f"SELECT log_id, {S.contains_any_sql('message', fl.ANOMALY_KEYWORDS)} AS rule_based_flag, "
          f"{S.contains_any_sql('message', fl.ALLOW_KEYWORDS)} AS is_whitelisted "
          f"FROM ({S.nonblank_sql(S.positional_sql(S.clean_sql(S.lines_sql('messy'))))})")
def q_rule_flags(spark, sf_dir):
    d = drop_blank(parse_positional(clean_lines(lines(spark, sf_dir, "messy"))))
    return fl.rule_flags(d).select("log_id", "rule_based_flag", "is_whitelisted")


# ---------------------------------------------------------------- detection chain
def _detect(spark, sf_dir, view="plain", **kw):
    return detect(lines(spark, sf_dir, view), keep_top_tokens=True, **kw)


_DET_PLAIN = S.detect_sql("plain")
_DET_MESSY = S.detect_sql("messy")


@register("detect", f"SELECT log_id, timestamp, message, anomaly_score, is_anomaly, rule_based_flag, "
                    f"is_whitelisted, combined_anomaly, confidence_score, explanation FROM ({_DET_PLAIN})")
def q_detect(spark, sf_dir):
    return _detect(spark, sf_dir).drop("top_tokens")


def _scored(spark, sf_dir):
    """Parsed logs with their anomaly scores (no flags or explanations)."""
    return scored_logs(lines(spark, sf_dir, "plain"))


@register("log_scores", f"SELECT log_id, anomaly_score FROM ({_DET_PLAIN})")
def q_log_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("log_id", "anomaly_score")


@register("scored_logs", f"SELECT log_id, timestamp, message, anomaly_score FROM ({_DET_PLAIN})")
def q_scored_logs(spark, sf_dir):
    return _scored(spark, sf_dir).select("log_id", "timestamp", "message", "anomaly_score")


@register("threshold",
          f"SELECT round(quantile_cont(anomaly_score, 0.7), 6) AS threshold, count(*) AS n_scores "
          f"FROM ({_DET_PLAIN})")
def q_threshold(spark, sf_dir):
    d = _scored(spark, sf_dir)
    thr = fl.score_threshold(d, "anomaly_score", 70)
    return thr.crossJoin(d.agg(F.count(F.lit(1)).alias("n_scores"))).select(
        F.round("threshold", 6).alias("threshold"), "n_scores")


@register("score_flags",
          f"SELECT log_id, anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, 0.7) "
          f"FROM ({_DET_PLAIN})) AS above_threshold FROM ({_DET_PLAIN})")
def q_score_flags(spark, sf_dir):
    d = _scored(spark, sf_dir).select("log_id", "anomaly_score")
    thr = fl.score_threshold(d, "anomaly_score", 70)
    return fl.flag_scores(d, thr).withColumnRenamed("is_anomaly", "above_threshold")


@register("confidence", f"SELECT log_id, confidence_score FROM ({_DET_PLAIN})")
def q_confidence(spark, sf_dir):
    return fl.confidence(_scored(spark, sf_dir)).select("log_id", "confidence_score")


@register("combined_flags",
          f"SELECT log_id, is_anomaly, rule_based_flag, is_whitelisted, combined_anomaly FROM ({_DET_MESSY})")
def q_combined_flags(spark, sf_dir):
    return _detect(spark, sf_dir, "messy").select("log_id", "is_anomaly", "rule_based_flag",
                                                  "is_whitelisted", "combined_anomaly")


@register("top_tokens", f"SELECT log_id, array_to_string(top_list, ' ') AS top_tokens FROM ({_DET_PLAIN})")
def q_top_tokens(spark, sf_dir):
    return _detect(spark, sf_dir).select("log_id", as_text(F.col("top_tokens")).alias("top_tokens"))


@register("explanations", f"SELECT log_id, explanation FROM ({_DET_MESSY})")
def q_explanations(spark, sf_dir):
    return _detect(spark, sf_dir, "messy").select("log_id", "explanation")


@register("token_meanings",
          f"SELECT DISTINCT t AS token, {S.meaning_sql('t', ignore_case=True)} AS meaning, "
          f"'''' || t || ''' (' || {S.meaning_sql('t', ignore_case=True)} || ')' AS phrase "
          f"FROM (SELECT unnest(top_list) AS t FROM ({_DET_MESSY}))")
def q_token_meanings(spark, sf_dir):
    d = _detect(spark, sf_dir, "messy").select(F.explode("top_tokens").alias("token")).distinct()
    return d.select("token", token_meaning(F.col("token"), ignore_case=True).alias("meaning"),
                    explain_tokens(F.array(F.col("token")), ignore_case=True).alias("phrase"))


_SUMMARY_SQL = (f"SELECT count(*) AS total_logs, CAST(count_if(is_anomaly) AS BIGINT) AS mlm_anomalies, "
                f"CAST(count_if(rule_based_flag) AS BIGINT) AS rule_anomalies, "
                f"CAST(count_if(combined_anomaly) AS BIGINT) AS combined_anomalies "
                f"FROM ({_DET_MESSY})")


@register("summary",
          f"SELECT *, round(mlm_anomalies * 100.0 / total_logs, 6) AS mlm_percent, "
          f"round(rule_anomalies * 100.0 / total_logs, 6) AS rule_percent, "
          f"round(combined_anomalies * 100.0 / total_logs, 6) AS combined_percent FROM ({_SUMMARY_SQL})")
def q_summary(spark, sf_dir):
    return fl.summarize(_detect(spark, sf_dir, "messy"))


@register("anomaly_counts",
          f"SELECT 'MLM' AS type, mlm_anomalies AS count FROM ({_SUMMARY_SQL}) UNION ALL "
          f"SELECT 'Rule-Based', rule_anomalies FROM ({_SUMMARY_SQL}) UNION ALL "
          f"SELECT 'Combined', combined_anomalies FROM ({_SUMMARY_SQL})")
def q_anomaly_counts(spark, sf_dir):
    return rp.anomaly_counts(fl.summarize(_detect(spark, sf_dir, "messy")))


_TYPE_SQL = ("CASE WHEN is_anomaly AND NOT rule_based_flag THEN 'MLM' WHEN rule_based_flag AND NOT is_anomaly "
             "THEN 'Rule-Based' WHEN is_anomaly AND rule_based_flag THEN 'Both' ELSE 'Normal' END")


@register("anomaly_series",
          f"SELECT log_id, anomaly_type, CASE anomaly_type WHEN 'MLM' THEN 'red' WHEN 'Rule-Based' THEN 'orange' "
          f"WHEN 'Both' THEN 'purple' END AS colour, "
          f"CAST(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS ts, anomaly_score, "
          f"anomaly_type || '<br>' || message AS hover "
          f"FROM (SELECT *, {_TYPE_SQL} AS anomaly_type FROM ({_DET_MESSY}) WHERE combined_anomaly)")
def q_anomaly_series(spark, sf_dir):
    return rp.anomaly_series(_detect(spark, sf_dir, "messy")).select(
        "log_id", "anomaly_type", "colour", "ts", "anomaly_score", "hover")


def _esc_sql(x):
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        x = f"replace({x}, {S.q(a)}, {S.q(b)})"
    return x


def _fixed_sql(x, d):
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(24,6)), {d}) AS DECIMAL(24,{d})) AS VARCHAR)"


@register("report_rows",
          "SELECT log_id, '<div class=''' || CASE WHEN combined_anomaly THEN 'anomaly-log' ELSE 'normal-log' END "
          "|| '''><p><strong>Timestamp:</strong> ' || " + _esc_sql("timestamp") +
          " || '<br/><strong>Log:</strong> ' || " + _esc_sql("message") +
          " || '<br/><strong>Anomaly Score:</strong> ' || " + _fixed_sql("anomaly_score", 4) +
          " || ' | <strong>Confidence:</strong> ' || " + _fixed_sql("confidence_score", 2) +
          " || ' | <strong>MLM Prediction:</strong> ' || CAST(CAST(is_anomaly AS INTEGER) AS VARCHAR)"
          " || ' | <strong>Rule Match:</strong> ' || CAST(CAST(rule_based_flag AS INTEGER) AS VARCHAR)"
          " || ' | <strong>Combined:</strong> ' || CAST(CAST(combined_anomaly AS INTEGER) AS VARCHAR)"
          " || '<br/><strong>Explanation:</strong> ' || " + _esc_sql("explanation") +
          " || '</p></div><hr>' AS html FROM (" + _DET_MESSY + ")")
def q_report_rows(spark, sf_dir):
    return rp.report_row(_detect(spark, sf_dir, "messy")).select("log_id", "html")


@register("heatmap_long",
          "SELECT log_id, 'Log ' || CAST(rn AS VARCHAR) AS label, "
          "m.measure, m.value FROM (SELECT d.*, row_number() OVER (ORDER BY log_id) AS rn, "
          "round((anomaly_score - mn) / (mx - mn + 1e-5), 6) AS v1, CAST(confidence_score AS DOUBLE) AS v2, "
          "CAST(CAST(combined_anomaly AS INTEGER) AS DOUBLE) AS v3 FROM (" + _DET_MESSY + ") d, "
          "(SELECT min(anomaly_score) AS mn, max(anomaly_score) AS mx FROM (" + _DET_MESSY + ")) x) s, "
          "LATERAL (VALUES ('Anomaly Score', v1), ('Confidence Score', v2), ('Combined Anomaly', v3)) m(measure, value)")
def q_heatmap_long(spark, sf_dir):
    from logsieve.operators.prep import with_global_index
    d = with_global_index(_detect(spark, sf_dir, "messy").select("log_id", "anomaly_score", "confidence_score", "combined_anomaly"),
                          ["log_id"], "idx", "log_id")
    return rp.heatmap_long(d)


_TYPED_SQL = (f"SELECT log_id, anomaly_type, epoch(CAST(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP))::BIGINT AS s, "
              f"anomaly_score FROM (SELECT *, {_TYPE_SQL} AS anomaly_type FROM ({_DET_MESSY}) WHERE combined_anomaly)")


@register("anomaly_series_reduced",
          f"WITH d AS ({_TYPED_SQL}), b AS (SELECT d.*, coalesce((s - lo) * 500 // (hi - lo + 1), -1) AS bucket "
          "FROM d, (SELECT min(s) AS lo, max(s) AS hi FROM d)) "
          "SELECT anomaly_type, bucket, count(*) AS n, arg_min(anomaly_score, (coalesce(s, -1), log_id)) AS first_score, "
          "arg_max(anomaly_score, (coalesce(s, -1), log_id)) AS last_score, min(anomaly_score) AS least, max(anomaly_score) AS greatest "
          "FROM b GROUP BY anomaly_type, bucket")
def q_anomaly_series_reduced(spark, sf_dir):
    return rp.series_reduced(rp.anomaly_series(_detect(spark, sf_dir, "messy")))


@register("heatmap_reduced",
          "WITH d AS (SELECT log_id, anomaly_score, confidence_score, combined_anomaly, row_number() OVER (ORDER BY log_id) - 1 AS idx, "
          f"count(*) OVER () AS n FROM ({_DET_MESSY})), "
          "h AS (SELECT idx * least(200, n) // n AS cell, m.measure, CAST(m.value AS DOUBLE) AS value "
          "FROM (SELECT d.*, round((anomaly_score - mn) / (mx - mn + 1e-5), 6) AS v1 FROM d, "
          "(SELECT min(anomaly_score) AS mn, max(anomaly_score) AS mx FROM d)) s, LATERAL (VALUES ('Anomaly Score', v1), "
          "('Confidence Score', CAST(confidence_score AS DOUBLE)), ('Combined Anomaly', CAST(CAST(combined_anomaly AS INTEGER) AS DOUBLE))) m(measure, value)) "
          "SELECT cell, measure, count(*) AS n, min(value) AS least, max(value) AS greatest, "
          "round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(*), 6) AS mean FROM h GROUP BY cell, measure")
def q_heatmap_reduced(spark, sf_dir):
    from logsieve.operators.prep import with_global_index
    d = written(_detect(spark, sf_dir, "messy").select("log_id", "anomaly_score", "confidence_score", "combined_anomaly"))
    idx = written(with_global_index(d.select("log_id"), ["log_id"], "idx"))
    return rp.heatmap_reduced(rp.heatmap_long(d.join(idx, "log_id")), idx)


# ---------------------------------------------------------------- embeddings, metrics
@register("cross_entropy",
          "SELECT vec_id, label, round(list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) "
          "- e[label + 1], 6) AS cross_entropy FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e "
          "FROM embeddings)")
def q_cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.round(cross_entropy(F.col("embedding"), F.col("label")), 6)
                    .alias("cross_entropy"))


_ARGMAX_SQL = ("SELECT vec_id, label, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS prediction "
               "FROM (SELECT vec_id, label, embedding AS e FROM embeddings)")


@register("argmax", _ARGMAX_SQL)
def q_argmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", argmax(F.col("embedding")).alias("prediction"))


def _metrics_sql(src: str, by: str | None = None, ignore: bool = True) -> str:
    """Weighted metrics of (label, prediction[, by]) rows, as classification_metrics."""
    g = f"{by}, " if by else ""
    cond = "label IS NOT NULL" + (" AND label <> -100" if ignore else "")
    conf = f"SELECT {g}label AS y, prediction AS p, count(*) AS n FROM ({src}) WHERE {cond} GROUP BY ALL"
    sup = f"SELECT {g}y, sum(n) AS s, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY ALL"
    prd = f"SELECT {g}p AS y, sum(n) AS pc FROM conf GROUP BY ALL"
    on = f"a.{by} = b.{by} AND " if by else ""
    per = (f"SELECT {'a.' + by + ', ' if by else ''}a.s, a.tp, coalesce(b.pc, 0) AS pc FROM sup a "
           f"LEFT JOIN prd b ON {on}a.y = b.y")
    agg = ("sum(tp) / sum(s) AS accuracy, "
           "sum(s * CASE WHEN pc = 0 THEN 0.0 ELSE tp / pc END) / sum(s) AS precision, "
           "sum(s * tp / s) / sum(s) AS recall, "
           "sum(s * CASE WHEN s + pc = 0 THEN 0.0 ELSE 2.0 * tp / (s + pc) END) / sum(s) AS f1")
    return (f"WITH conf AS ({conf}), sup AS ({sup}), prd AS ({prd}) SELECT {g}{agg} FROM ({per}) "
            f"{'GROUP BY ' + by if by else ''}")


@register("weighted_metrics",
          f"SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, "
          f"round(f1, 6) AS f1 FROM ({_metrics_sql(_ARGMAX_SQL)})")
def q_weighted_metrics(spark, sf_dir):
    d = q_argmax(spark, sf_dir)
    return mt.round_all(mt.classification_metrics(d, "label", "prediction"),
                        ["accuracy", "precision", "recall", "f1"], 6)


_LOG_SQL = ("SELECT CAST(event_id % 5 + 1 AS INTEGER) AS chunk, event_id AS step, "
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS epoch, "
            "CASE WHEN event_type = 'click' THEN NULL ELSE value END AS loss, "
            "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) * 3e-6 END AS learning_rate "
            "FROM events")
_TRAIN_LOSS_SQL = (f"SELECT chunk, round(avg(loss), 6) AS avg_train_loss FROM ({_LOG_SQL}) "
                   f"WHERE loss IS NOT NULL AND epoch IS NOT NULL GROUP BY chunk")
_LR_SQL = (f"SELECT chunk, round(avg(learning_rate), 12) AS avg_learning_rate FROM ({_LOG_SQL}) "
           f"WHERE learning_rate IS NOT NULL GROUP BY chunk")


@register("train_loss_by_chunk", _TRAIN_LOSS_SQL)
def q_train_loss(spark, sf_dir):
    d = mt.train_loss_by_chunk(training_log_from_events(table(spark, sf_dir, "events")))
    return mt.round_all(d, ["avg_train_loss"], 6)


@register("lr_by_chunk", _LR_SQL)
def q_lr(spark, sf_dir):
    d = mt.lr_by_chunk(training_log_from_events(table(spark, sf_dir, "events")))
    return mt.round_all(d, ["avg_learning_rate"], 12)


# ---------------------------------------------------------------- tokens
_TOKS_SQL = f"SELECT doc_id, {S.tokens_sql('text')} AS tks FROM documents"
_SPECIAL_ROWS = " UNION ALL ".join(f"SELECT {i} AS token_id, {S.q(t)} AS token, CAST(0 AS BIGINT) AS count"
                                   for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]))


def _vocab_sql(src: str = _TOKS_SQL, min_count: int = 1) -> str:
    counts = (f"SELECT t AS token, count(*) AS count FROM (SELECT unnest(tks) AS t FROM ({src})) "
              f"WHERE t NOT IN {S.SPECIALS_SQL} GROUP BY t HAVING count(*) >= {min_count}")
    ranked = (f"SELECT CAST(row_number() OVER (ORDER BY count DESC, token ASC) + 4 AS INTEGER) AS token_id, "
              f"token, count FROM ({counts})")
    return f"{_SPECIAL_ROWS} UNION ALL SELECT * FROM ({ranked})"


def _docs_tokens(spark, sf_dir):
    return tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def _docs_vocab(toks, min_count=1):
    from logsieve.operators.tokens import build_vocab
    return build_vocab(toks, "tokens", min_count)


def _docs_encoded(spark, sf_dir):
    """(encoded documents, vocabulary); the documents are tokenized once."""
    from logsieve.operators.tokens import encode
    toks = written(_docs_tokens(spark, sf_dir))
    vocab = _docs_vocab(toks)
    return encode(toks, vocab, "doc_id", "tokens"), vocab


@register("tokens", f"SELECT doc_id, CAST(len(tks) AS INTEGER) AS n_tokens, array_to_string(tks, ' ') AS tokens "
                    f"FROM ({_TOKS_SQL})")
def q_tokens(spark, sf_dir):
    d = _docs_tokens(spark, sf_dir)
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), as_text(F.col("tokens")).alias("tokens"))


@register("vocabulary", _vocab_sql())
def q_vocabulary(spark, sf_dir):
    return _docs_vocab(_docs_tokens(spark, sf_dir))


_IDS_SQL = (f"WITH tk AS (SELECT doc_id, tks[1:62] AS tks FROM ({_TOKS_SQL})), vocab AS ({_vocab_sql()}), "
            f"ex AS (SELECT doc_id, tks, unnest(generate_series(1, len(tks))) AS pos FROM tk), "
            f"ids AS (SELECT ex.doc_id, list(coalesce(v.token_id, 1) ORDER BY ex.pos) AS ids, "
            f"list(coalesce(v.token, '[UNK]') ORDER BY ex.pos) AS words "
            f"FROM ex LEFT JOIN vocab v ON v.token = ex.tks[ex.pos] GROUP BY ex.doc_id) "
            f"SELECT tk.doc_id, coalesce(ids.ids, []) AS ids, coalesce(ids.words, []) AS words "
            f"FROM tk LEFT JOIN ids ON tk.doc_id = ids.doc_id")
_ENC_SQL = (f"SELECT doc_id, list_concat([2], ids, [3], list_transform(range(62 - len(ids)), lambda x: 0)) AS input_ids, "
            f"list_concat(list_transform(range(len(ids) + 2), lambda x: 1), "
            f"list_transform(range(62 - len(ids)), lambda x: 0)) AS attention_mask FROM ({_IDS_SQL})")


@register("encoded", f"SELECT doc_id, array_to_string(input_ids, ' ') AS input_ids, "
                     f"array_to_string(attention_mask, ' ') AS attention_mask FROM ({_ENC_SQL})")
def q_encoded(spark, sf_dir):
    e, _ = _docs_encoded(spark, sf_dir)
    return e.select("doc_id", as_text(F.col("input_ids")).alias("input_ids"),
                    as_text(F.col("attention_mask")).alias("attention_mask"))


@register("decoded", f"SELECT doc_id, array_to_string(list_concat(['[CLS]'], words, ['[SEP]'], "
                     f"list_transform(range(62 - len(words)), lambda x: '[PAD]')), ' ') AS decoded FROM ({_IDS_SQL})")
def q_decoded(spark, sf_dir):
    from logsieve.operators.tokens import decode
    d = decode(*_docs_encoded(spark, sf_dir), "doc_id", "input_ids")
    return d.select("doc_id", as_text(F.col("decoded")).alias("decoded"))


def _mask_sql(seed=42, p=0.15):
    pick = S.h01_sql(str(seed), "doc_id", "i - 1", "'pick'")
    kind = S.h01_sql(str(seed), "doc_id", "i - 1", "'kind'")
    word = S.h01_sql(str(seed), "doc_id", "i - 1", "'word'")
    vs = "v.vs"
    chosen = f"(x >= 5 AND {pick} < {p})"
    new = (f"CASE WHEN NOT {chosen} THEN x WHEN {kind} < 0.8 THEN 4 "
           f"WHEN {kind} < 0.9 THEN CAST(5 + floor({word} * ({vs} - 5)) AS INTEGER) ELSE x END")
    lab = f"CASE WHEN {chosen} THEN x ELSE -100 END"
    return (f"SELECT doc_id, array_to_string(list_transform(input_ids, lambda x, i: {new}), ' ') AS input_ids, "
            f"array_to_string(list_transform(input_ids, lambda x, i: {lab}), ' ') AS labels FROM ({_ENC_SQL}) e, "
            f"(SELECT count(*) AS vs FROM ({_vocab_sql()})) v")


@register("masked_examples", _mask_sql())
def q_masked(spark, sf_dir):
    from logsieve.operators.tokens import mask_tokens
    encoded, vocab = _docs_encoded(spark, sf_dir)
    m = mask_tokens(encoded, vocab.count(), "doc_id", seed=42)
    return m.select("doc_id", as_text(F.col("input_ids")).alias("input_ids"), as_text(F.col("labels")).alias("labels"))


# word pieces: words seen at least twice are whole pieces, rarer ones are split
_PIECES_SQL = (f"SELECT DISTINCT p FROM (SELECT unnest([token, '##' || token]) AS p FROM ({_vocab_sql(min_count=2)}) WHERE token_id > 4 "
               f"UNION ALL SELECT unnest([c, '##' || c]) FROM (SELECT DISTINCT unnest(string_split(w, '')) AS c FROM words))")
_SUBWORD_SQL = f"""
WITH RECURSIVE tk AS ({_TOKS_SQL}),
words AS (SELECT DISTINCT unnest(tks) AS w FROM tk),
pieces AS ({_PIECES_SQL}),
sizes AS (SELECT DISTINCT length(CASE WHEN p LIKE '##_%' THEN substr(p, 3) ELSE p END) AS n FROM pieces),
walk(w, place, out) AS (
  SELECT w, 0, CAST([] AS VARCHAR[]) FROM words WHERE length(w) <= 100
  UNION ALL
  SELECT s.w, CASE WHEN max(s.n) IS NULL THEN -1 ELSE s.place + max(s.n) END,
         CASE WHEN max(s.n) IS NULL THEN ['[UNK]'] ELSE list_append(any_value(s.out), any_value(s.mark) || substr(s.w, CAST(s.place + 1 AS BIGINT), CAST(max(s.n) AS BIGINT))) END
  FROM (SELECT c.w, c.place, c.out, c.mark, CASE WHEN p.p IS NOT NULL THEN c.n END AS n
        FROM (SELECT walk.*, sizes.n, CASE WHEN walk.place = 0 THEN '' ELSE '##' END AS mark FROM walk, sizes
              WHERE walk.place >= 0 AND walk.place < length(walk.w) AND walk.place + sizes.n <= length(walk.w)) c
        LEFT JOIN pieces p ON p.p = c.mark || substr(c.w, CAST(c.place + 1 AS BIGINT), CAST(c.n AS BIGINT))) s
  GROUP BY s.w, s.place),
done AS (SELECT w, out FROM walk WHERE place = length(w) OR place = -1 UNION ALL SELECT w, ['[UNK]'] FROM words WHERE length(w) > 100),
ex AS (SELECT doc_id, tks, unnest(generate_series(1, len(tks))) AS pos FROM tk),
per AS (SELECT ex.doc_id, flatten(list(d.out ORDER BY ex.pos)) AS ps FROM ex JOIN done d ON d.w = ex.tks[ex.pos] GROUP BY ex.doc_id)
SELECT tk.doc_id, CAST(coalesce(len(per.ps), 0) AS INTEGER) AS n_pieces, coalesce(array_to_string(per.ps, ' '), '') AS pieces
FROM tk LEFT JOIN per ON tk.doc_id = per.doc_id"""


@register("subword_tokens", _SUBWORD_SQL)
def q_subword(spark, sf_dir):
    from logsieve.operators.tokens import distinct_words, encode_subword, word_pieces
    toks = written(_docs_tokens(spark, sf_dir))
    pieces = word_pieces(_docs_vocab(toks, min_count=2), distinct_words(toks))
    out = encode_subword(toks, pieces, "doc_id", "tokens")
    return out.select("doc_id", F.size("pieces").alias("n_pieces"), as_text(F.col("pieces")).alias("pieces"))


# ---------------------------------------------------------------- index, split, chunks
@register("global_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events")
def q_global_index(spark, sf_dir):
    from logsieve.operators.prep import with_global_index
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return with_global_index(ev, ["ts", "event_id"], "idx", "event_id").select("event_id", "idx")


SEED = 42
_LAB_SQL = ("SELECT log_id, split_part(line, '##', 1) AS message, "
            "CAST(CASE WHEN contains(line, '##ANOMALY') THEN 1 ELSE 0 END AS INTEGER) AS label "
            f"FROM ({S.clean_sql(S.lines_sql('labelled'))}) "
            "WHERE contains(line, '##ANOMALY') OR contains(line, '##NORMAL')")
_SPLIT_SQL = (f"SELECT log_id, message, label, rk < (SELECT ceil(count(*) * 0.2) FROM ({_LAB_SQL})) AS is_test "
              f"FROM (SELECT *, row_number() OVER (ORDER BY {S.h01_sql(str(SEED), chr(39) + 'split' + chr(39), 'log_id')}, "
              f"log_id) - 1 AS rk FROM ({_LAB_SQL}))")


def _labelled(spark, sf_dir):
    return parse_labelled(clean_lines(lines(spark, sf_dir, "labelled")))


def _split(spark, sf_dir):
    from logsieve.operators.prep import train_test_split
    return train_test_split(_labelled(spark, sf_dir), "log_id", 0.2, seed=SEED, exact=True)


@register("split_rows", f"SELECT log_id, is_test FROM ({_SPLIT_SQL})")
def q_split_rows(spark, sf_dir):
    return _split(spark, sf_dir).select("log_id", "is_test")


@register("split_counts", f"SELECT is_test, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY is_test")
def q_split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


def _chunk_sql(src, k, remainder, order="log_id"):
    idx = f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS idx, count(*) OVER () AS n FROM ({src})"
    size = f"(n // {k})"
    if remainder == "last":
        c = f"CASE WHEN {size} = 0 THEN {k} ELSE least(idx // {size}, {k - 1}) + 1 END"
        return f"SELECT log_id, CAST({c} AS INTEGER) AS chunk FROM ({idx})"
    c = f"CASE WHEN {size} > 0 AND idx // {size} + 1 <= {k} THEN idx // {size} + 1 END"
    return f"SELECT log_id, CAST({c} AS INTEGER) AS chunk FROM ({idx}) WHERE {c} IS NOT NULL"


@register("chunks_keep", _chunk_sql(_LAB_SQL, 10, "last"))
def q_chunks_keep(spark, sf_dir):
    from logsieve.operators.prep import chunk
    return chunk(_labelled(spark, sf_dir), 10, ["log_id"], "last").select("log_id", "chunk")


_TRAIN_SQL = f"SELECT log_id, message, label FROM ({_SPLIT_SQL}) WHERE NOT is_test"


_SHUFFLED = f"{S.h01_sql(str(SEED), chr(39) + 'shuffle' + chr(39), 'log_id')}, log_id"


@register("chunks_drop", _chunk_sql(_TRAIN_SQL, 5, "drop", _SHUFFLED))
def q_chunks_drop(spark, sf_dir):
    from logsieve.plans.finetune import prepare
    return prepare(_labelled(spark, sf_dir), 5, seed=SEED)[0].select("log_id", "chunk")


@register("shuffled_logs", f"SELECT log_id, row_number() OVER (ORDER BY {_SHUFFLED}) - 1 AS place FROM ({_LAB_SQL})")
def q_shuffled_logs(spark, sf_dir):
    from logsieve.operators.prep import shuffle
    return shuffle(_labelled(spark, sf_dir), "log_id", SEED, out="place").select("log_id", "place")


# ---------------------------------------------------------------- model, chunked fit, evaluation
K_CHUNKS = 5
_PLAIN_LOGS_SQL = S.nonblank_sql(S.positional_sql(S.clean_sql(S.lines_sql("plain"))))
_BASE_POS_SQL = S.positions_sql(_PLAIN_LOGS_SQL)
_BASE_C3_SQL = f"SELECT l, t, r, count(*) AS n FROM ({_BASE_POS_SQL}) GROUP BY l, t, r"
_TRAIN_CHUNKS_SQL = (f"SELECT t.log_id, c.chunk, t.message FROM ({_TRAIN_SQL}) t "
                     f"JOIN ({_chunk_sql(_TRAIN_SQL, K_CHUNKS, 'drop', _SHUFFLED)}) c ON t.log_id = c.log_id")
_CUM_SQL = (f"SELECT CAST(c AS INTEGER) AS chunk, l, t, r, CAST(sum(n) AS BIGINT) AS n FROM ("
            f"SELECT unnest(generate_series(greatest(chunk, 1), {K_CHUNKS})) AS c, l, t, r, n FROM ("
            f"SELECT 0 AS chunk, l, t, r, n FROM ({_BASE_C3_SQL}) UNION ALL "
            f"SELECT chunk, l, t, r, count(*) AS n FROM ({S.positions_sql(_TRAIN_CHUNKS_SQL, keep='chunk')}) "
            f"GROUP BY chunk, l, t, r)) GROUP BY c, l, t, r")


def _chosen_sql(j: str) -> str:
    return f"({j} > 1 AND {j} < seq_len AND {S.h01_sql(str(SEED), 'log_id', j, chr(39) + 'pick' + chr(39))} < 0.15)"


_TRAIN_VOCAB_SQL = _vocab_sql(f"SELECT {S.tokens_sql('message')} AS tks FROM ({_TRAIN_CHUNKS_SQL})")


def _seen_sql(c: str, j: str) -> str:
    """What a neighbour at place j shows: itself, [MASK] (80 %), a random word (10 %) or itself."""
    kind = S.h01_sql(str(SEED), "log_id", j, "'kind'")
    word = S.h01_sql(str(SEED), "log_id", j, "'word'")
    return (f"CASE WHEN NOT {_chosen_sql(j)} THEN {c} WHEN {kind} < 0.8 THEN '[MASK]' WHEN {kind} < 0.9 THEN "
            f"words[CAST(1 + floor({word} * len(words)) AS BIGINT)] ELSE {c} END AS {c}")


_EVAL_POS_SQL = (f"SELECT log_id, pos, {_seen_sql('l', '(pos - 1)')}, t, {_seen_sql('r', '(pos + 1)')} "
                 f"FROM ({S.positions_sql(f'SELECT log_id, message FROM ({_SPLIT_SQL}) WHERE is_test')}), "
                 f"(SELECT list(token ORDER BY token_id) AS words FROM ({_TRAIN_VOCAB_SQL}) WHERE token_id > 4) "
                 f"WHERE {_chosen_sql('pos')}")


def _best_sql(keys: str, name: str) -> str:
    k = f"{keys}, " if keys else ""
    return (f"SELECT chunk, {k}arg_min(t, (-n, t)) AS {name} FROM (SELECT chunk, {k}t, sum(n) AS n FROM cum "
            f"GROUP BY chunk, {k}t) GROUP BY chunk{', ' + keys if keys else ''}")


_P_SQL = ("0.4 * coalesce(n3 / n_lr, 0) + 0.2 * coalesce(n_lt / n_l, 0) + 0.2 * coalesce(n_tr / n_r, 0) "
          "+ 0.2 * (coalesce(n_t, 0) + 0.1) / (big_n + 0.1 * (big_v + 1))")
_FT_CTES = (f"WITH cum AS ({_CUM_SQL}), ev AS ({_EVAL_POS_SQL}), "
            f"ev5 AS (SELECT CAST(c.chunk AS INTEGER) AS chunk, e.* FROM ev e, "
            f"(SELECT unnest(generate_series(1, {K_CHUNKS})) AS chunk) c), "
            f"pr AS (SELECT ev5.*, coalesce(p_lr, p_l, p_r, p_all) AS prediction FROM ev5 "
            f"LEFT JOIN ({_best_sql('l, r', 'p_lr')}) USING (chunk, l, r) "
            f"LEFT JOIN ({_best_sql('l', 'p_l')}) USING (chunk, l) "
            f"LEFT JOIN ({_best_sql('r', 'p_r')}) USING (chunk, r) "
            f"LEFT JOIN ({_best_sql('', 'p_all')}) USING (chunk)), "
            f"lo AS (SELECT pr.*, CAST(round(CAST(-ln({_P_SQL}) AS DECIMAL(20,9)), 6) AS DOUBLE) AS loss FROM pr "
            f"LEFT JOIN (SELECT chunk, l, t, r, n AS n3 FROM cum) USING (chunk, l, t, r) "
            f"LEFT JOIN (SELECT chunk, l, r, sum(n) AS n_lr FROM cum GROUP BY ALL) USING (chunk, l, r) "
            f"LEFT JOIN (SELECT chunk, l, t, sum(n) AS n_lt FROM cum GROUP BY ALL) USING (chunk, l, t) "
            f"LEFT JOIN (SELECT chunk, l, sum(n) AS n_l FROM cum GROUP BY ALL) USING (chunk, l) "
            f"LEFT JOIN (SELECT chunk, t, r, sum(n) AS n_tr FROM cum GROUP BY ALL) USING (chunk, t, r) "
            f"LEFT JOIN (SELECT chunk, r, sum(n) AS n_r FROM cum GROUP BY ALL) USING (chunk, r) "
            f"LEFT JOIN (SELECT chunk, t, sum(n) AS n_t FROM cum GROUP BY ALL) USING (chunk, t) "
            f"LEFT JOIN (SELECT chunk, sum(n) AS big_n, count(DISTINCT t) AS big_v FROM cum GROUP BY chunk) "
            f"USING (chunk)) ")
_EVAL_SQL = (f"SELECT e.chunk, round(e.eval_loss, 4) AS eval_loss, round(m.accuracy, 4) AS eval_accuracy, "
             f"round(m.precision, 4) AS eval_precision, round(m.recall, 4) AS eval_recall, "
             f"round(m.f1, 4) AS eval_f1 FROM (SELECT chunk, avg(loss) AS eval_loss FROM lo GROUP BY chunk) e "
             f"JOIN ({_metrics_sql('SELECT chunk, t AS label, prediction FROM pr', 'chunk', ignore=False)}) m "
             f"ON e.chunk = m.chunk")


def _base_model(spark, sf_dir):
    from logsieve.operators.model import fit, positions
    logs = drop_blank(written(parse_positional(lines(spark, sf_dir, "plain"))))
    return fit(positions(tokenize(distinct_messages(logs), "_text"), "_mid", keep=("_times",)), times="_times")


def _finetune(spark, sf_dir):
    from logsieve.plans import finetune as ft
    train, test = ft.prepare(_labelled(spark, sf_dir), K_CHUNKS, seed=SEED)
    train = written(train, spread=True)
    model = ft.fit_finetune(_base_model(spark, sf_dir), train, K_CHUNKS)
    vocab = build_vocab(tokenize(train.select("message")), "tokens")
    return model, ft.masked_eval_positions(test, vocab, seed=SEED)


@register("context_counts", _BASE_C3_SQL)
def q_context_counts(spark, sf_dir):
    return _base_model(spark, sf_dir).counts


@register("token_losses",
          f"SELECT log_id, pos, t, loss FROM ({S.ranked_losses_sql(_BASE_POS_SQL)})")
def q_token_losses(spark, sf_dir):
    from logsieve.operators.model import positions, token_losses
    logs = drop_blank(parse_positional(lines(spark, sf_dir, "plain")))
    return token_losses(positions(tokenize(logs))).select("log_id", "pos", "t", "loss")


@register("cumulative_counts", _CUM_SQL)
def q_cumulative_counts(spark, sf_dir):
    return _finetune(spark, sf_dir)[0].counts


@register("predictions", _FT_CTES + "SELECT chunk, log_id, pos, t AS label_token, prediction FROM pr")
def q_predictions(spark, sf_dir):
    from logsieve.plans import finetune as ft
    model, ev = _finetune(spark, sf_dir)
    pr = ft.chunk_predictions(model, ev, K_CHUNKS)
    return pr.select("chunk", "log_id", "pos", F.col("t").alias("label_token"), "prediction")


def _eval(spark, sf_dir):
    from logsieve.plans import finetune as ft
    model, ev = _finetune(spark, sf_dir)
    return ft.evaluate_chunks(model, ev, K_CHUNKS)


@register("eval_by_chunk", _FT_CTES + _EVAL_SQL)
def q_eval_by_chunk(spark, sf_dir):
    return _eval(spark, sf_dir)


@register("best_chunk", _FT_CTES + f"SELECT arg_min(chunk, (eval_loss, chunk)) AS best_chunk, "
                                   f"min(eval_loss) AS best_eval_loss FROM ({_EVAL_SQL})")
def q_best_chunk(spark, sf_dir):
    from logsieve.operators.model import best_chunk
    return best_chunk(_eval(spark, sf_dir))


@register("overall_metrics", _FT_CTES + " UNION ALL ".join(
    f"SELECT {S.q(n)} AS Metric, round(avg({c}), 2) AS Value FROM ({_EVAL_SQL})" for c, n in mt.METRIC_NAMES))
def q_overall_metrics(spark, sf_dir):
    return mt.overall_metrics(_eval(spark, sf_dir))


@register("metrics_joined", _FT_CTES + f"SELECT e.*, t.avg_train_loss FROM ({_EVAL_SQL}) e "
                                       f"LEFT JOIN ({_TRAIN_LOSS_SQL}) t ON e.chunk = t.chunk")
def q_metrics_joined(spark, sf_dir):
    return mt.join_metrics(_eval(spark, sf_dir), q_train_loss(spark, sf_dir))


@register("metric_series", _FT_CTES + "SELECT chunk, series, value FROM (" + " UNION ALL ".join(
    [f"SELECT e.chunk, {S.q(c)} AS series, CAST({'t.' if c == 'avg_train_loss' else 'e.'}{c} AS DOUBLE) AS value "
     f"FROM ({_EVAL_SQL}) e LEFT JOIN ({_TRAIN_LOSS_SQL}) t ON e.chunk = t.chunk"
     for c in ["eval_accuracy", "eval_precision", "eval_recall", "eval_f1", "avg_train_loss", "eval_loss"]]
    + [f"SELECT chunk, 'avg_learning_rate', avg_learning_rate FROM ({_LR_SQL})"]) + ")")
def q_metric_series(spark, sf_dir):
    return mt.metric_series(_eval(spark, sf_dir), q_train_loss(spark, sf_dir), q_lr(spark, sf_dir))


# ---------------------------------------------------------------- generator
def _gen(spark, sf_dir, mode):
    from logsieve.sources.generate import generate_logs
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return generate_logs(ids, mode, seed=SEED)


@register("gen_raw", S.generate_sql("raw", SEED))
def q_gen_raw(spark, sf_dir):
    return _gen(spark, sf_dir, "raw")


@register("gen_labelled", S.generate_sql("finetuned", SEED))
def q_gen_labelled(spark, sf_dir):
    return _gen(spark, sf_dir, "finetuned")


@register("gen_test", S.generate_sql("test", SEED))
def q_gen_test(spark, sf_dir):
    return _gen(spark, sf_dir, "test")


# ---------------------------------------------------------------- custom scorer
@register("custom_scorer",
          f"SELECT doc_id, round(list_avg(list_transform(input_ids, lambda x: ln(1 + x))), 6) AS score "
          f"FROM ({_ENC_SQL})")
def q_custom_scorer(spark, sf_dir):
    from logsieve.operators.scorers import make_mean_log1p, score_with
    e = score_with(_docs_encoded(spark, sf_dir)[0], make_mean_log1p, "input_ids", "score")
    return e.select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- fitted weights, stored model, large lookup
def _labelled_pos_sql(test: bool) -> str:
    """Positions of one part of the labelled logs, without their timestamps."""
    message = "regexp_replace(message, '^[0-9-]+ [0-9:]+ ', '') AS message"
    return S.positions_sql(f"SELECT log_id, {message} FROM ({_SPLIT_SQL}) WHERE {'' if test else 'NOT '}is_test")


_MARGINALS_SQL = ("LEFT JOIN (SELECT l, t, r, n AS n3 FROM cum) USING (l, t, r) LEFT JOIN (SELECT l, r, sum(n) AS n_lr FROM cum GROUP BY ALL) USING (l, r) "
                  "LEFT JOIN (SELECT l, t, sum(n) AS n_lt FROM cum GROUP BY ALL) USING (l, t) LEFT JOIN (SELECT l, sum(n) AS n_l FROM cum GROUP BY ALL) USING (l) "
                  "LEFT JOIN (SELECT t, r, sum(n) AS n_tr FROM cum GROUP BY ALL) USING (t, r) LEFT JOIN (SELECT r, sum(n) AS n_r FROM cum GROUP BY ALL) USING (r) "
                  "LEFT JOIN (SELECT t, sum(n) AS n_t FROM cum GROUP BY ALL) USING (t), "
                  "(SELECT sum(n) AS big_n, count(DISTINCT t) AS big_v FROM cum)")
_FOUR_SQL = ["coalesce(n3 / n_lr, 0)", "coalesce(n_lt / n_l, 0)", "coalesce(n_tr / n_r, 0)",
             "(coalesce(n_t, 0) + 0.1) / (big_n + 0.1 * (big_v + 1))"]
_MIX_SQL = "(w1 * p1 + w2 * p2 + w3 * p3 + w4 * p4)"
WEIGHT_ROUNDS = 8


def _weights_ctes() -> str:
    """cum: the model of the training part; s0..s8: the weights after each round on the held-out part."""
    parts = ", ".join(f"CAST({x} AS DOUBLE) AS p{k}" for k, x in enumerate(_FOUR_SQL, 1))
    held = f"SELECT l, t, r, count(*) AS m FROM ({_labelled_pos_sql(True)}) GROUP BY l, t, r"
    out = [f"cum AS MATERIALIZED (SELECT l, t, r, count(*) AS n FROM ({_labelled_pos_sql(False)}) GROUP BY l, t, r)",
           f"parts AS MATERIALIZED (SELECT m, {parts} FROM ({held}) {_MARGINALS_SQL})",
           "s0 AS (SELECT 0.4::DOUBLE AS w1, 0.2::DOUBLE AS w2, 0.2::DOUBLE AS w3, 0.2::DOUBLE AS w4)"]
    for i in range(WEIGHT_ROUNDS):
        new = ", ".join(f"round(sum(m * w{k} * p{k} / {_MIX_SQL}) / sum(m), 9) AS w{k}" for k in range(1, 5))
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT {new} FROM parts, s{i})")
    return ", ".join(out)


_WEIGHTS_SQL = f"WITH {_weights_ctes()} " + " UNION ALL ".join(
    f"SELECT {i} AS round, " + ", ".join(f"round(any_value(w{k}), 6) AS w{k}" for k in range(1, 5))
    + f", round(sum(m * -ln({_MIX_SQL})) / sum(m), 6) AS loss FROM parts, s{i}" for i in range(WEIGHT_ROUNDS + 1))


def _labelled_positions(spark, sf_dir):
    """Token positions of the labelled logs' training and held-out parts."""
    from logsieve.operators.model import positions
    labelled = parse_labelled(clean_lines(lines(spark, sf_dir, "labelled")), strip_timestamp=True)
    split = written(_split(spark, sf_dir).select("log_id", "is_test").join(labelled, "log_id"))
    of = lambda part: positions(tokenize(split.filter(part).select("log_id", "message")))
    return of(~F.col("is_test")), of(F.col("is_test"))


def _labelled_model(spark, sf_dir):
    """(model of the labelled logs' training part, its weights by round, fitted on the held-out part)."""
    from logsieve.operators.model import fit, fit_weights
    train, test = _labelled_positions(spark, sf_dir)
    model = fit(train)
    held = written(test.groupBy("l", "t", "r").agg(F.count(F.lit(1)).alias("m")))
    return model, fit_weights(model, held, WEIGHT_ROUNDS)


def _labelled_model_counts(spark, sf_dir):
    from logsieve.operators.model import fit
    return fit(_labelled_positions(spark, sf_dir)[0]).counts


@register("fitted_weights", _WEIGHTS_SQL)
def q_fitted_weights(spark, sf_dir):
    """Mixture weights after each round of expectation-maximisation, and the held-out loss under them."""
    fitted = _labelled_model(spark, sf_dir)[1]
    return fitted.select("round", *[F.round(c, 6).alias(c) for c in ("w1", "w2", "w3", "w4", "loss")])


_FITTED_P_SQL = " + ".join(f"round(0.001::DOUBLE + 0.996::DOUBLE * w{k}, 6) * {x}" for k, x in enumerate(_FOUR_SQL, 1))
_STORED_CTES = f"""
WITH {_weights_ctes()},
po AS ({S.positions_sql(_PLAIN_LOGS_SQL)}),
lo AS (SELECT po.log_id, po.pos, po.t, CAST(round(CAST(-ln({_FITTED_P_SQL}) AS DECIMAL(20,9)), 6) AS DOUBLE) AS loss
  FROM po {_MARGINALS_SQL}, s{WEIGHT_ROUNDS}),
sc AS (SELECT log_id, CAST(round(sum(CAST(loss AS DECIMAL(18,6))) * CAST(0.015625 AS DECIMAL(10,6)), 6) AS DOUBLE) AS anomaly_score FROM lo GROUP BY log_id)
"""
_STORED_SQL = f"""{_STORED_CTES}
SELECT log_id, anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, 0.7) FROM sc)
  AND NOT {S.contains_any_sql('message', fl.ALLOW_KEYWORDS)} AS is_anomaly
FROM sc JOIN ({_PLAIN_LOGS_SQL}) USING (log_id)"""


def _fitted_model(spark, sf_dir):
    from logsieve.operators.model import with_weights
    return with_weights(*_labelled_model(spark, sf_dir))


@register("detect_stored", _STORED_SQL)
def q_detect_stored(spark, sf_dir):
    """A model fitted on the training part of the labelled logs, with weights fitted on the
    held-out part, scores the plain logs."""
    return detect(lines(spark, sf_dir, "plain"), _fitted_model(spark, sf_dir)).select("log_id", "anomaly_score", "is_anomaly")


@register("low_rank_scores")
def q_low_rank_scores(spark, sf_dir):
    """A low-rank token model of the labelled logs' training part scores the plain logs in Arrow batches."""
    from logsieve.operators.lowrank import fit_low_rank, low_rank_losses
    model = fit_low_rank(_labelled_model_counts(spark, sf_dir))
    out = detect(lines(spark, sf_dir, "plain"), losses=low_rank_losses(model))
    return out.select("log_id", F.round("anomaly_score", 3).alias("anomaly_score"))


@register("stream_scores", f"{_STORED_CTES} SELECT log_id, anomaly_score FROM sc")
def q_stream_scores(spark, sf_dir):
    """The events files as a stream, scored in one streaming plan with the stored model."""
    import uuid

    from logsieve.session import checkpoint_dir
    from logsieve.streaming.scoring import run_scores, score_stream
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    # a pattern, because a stream reads a folder or a pattern, and the table may be one file
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    base = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    scores = score_stream(logs_from_events(events), _fitted_model(spark, sf_dir).summed())
    run_scores(scores, f"{base}/sink", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/sink/scores").select("log_id", "anomaly_score")


_DAYS_SQL = f"SELECT substr(timestamp, 1, 10) AS day, anomaly_score FROM ({_DET_PLAIN})"


@register("daily_thresholds",
          f"SELECT day, count(*) AS n, TRUE AS within FROM ({_DAYS_SQL}) GROUP BY day "
          f"UNION ALL SELECT 'all', count(*), TRUE FROM ({_DAYS_SQL})")
def q_daily_thresholds(spark, sf_dir):
    """Thresholds of each day and of all days, from one sketch per day: the days' sketches are stored, and the
    whole threshold is their merge.  `within`: the threshold's rank is as close to the percentile as promised."""
    from logsieve.operators import sketch as sk
    d = _scored(spark, sf_dir).select(F.substring("timestamp", 1, 10).alias("day"), "anomaly_score")
    days = written(sk.rank_sketches(d, ["day"]))
    whole = sk.merged(days).withColumn("day", F.lit("all"))
    rows = d.withColumn("day", F.explode(F.array("day", F.lit("all"))))
    errors = sk.rank_errors(rows, sk.sketch_thresholds(days.unionByName(whole), 70), ["day"], 70)
    return errors.select("day", "n", (F.col("error") <= sk.RANK_ERROR).alias("within"))


_DOC_WORDS_SQL = f"SELECT doc_id, t AS token, count(*) AS n FROM (SELECT doc_id, unnest(tks) AS t FROM ({_TOKS_SQL})) GROUP BY ALL"


@register("word_meanings", f"SELECT doc_id, w.token, n, coalesce('seen ' || CAST(v.count AS VARCHAR) || ' times', 'rare') AS meaning "
                           f"FROM ({_DOC_WORDS_SQL}) w LEFT JOIN ({_vocab_sql(min_count=2)}) v ON v.token = w.token AND v.token_id > 4")
def q_word_meanings(spark, sf_dir):
    """Token meanings from a table of any size (here the vocabulary), not a literal map."""
    from logsieve.operators.explain import lookup_meanings
    toks = written(_docs_tokens(spark, sf_dir))
    words = toks.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    known = _docs_vocab(toks, min_count=2).filter("token_id > 4")
    mapping = known.select("token", F.format_string("seen %d times", "count").alias("meaning"), F.col("count").alias("freq"))
    return lookup_meanings(words, mapping, default="rare")
