"""End-to-end detection: lines -> parsed logs -> token losses -> scores -> flags ->
confidence -> explanations.

Plan shape: equal messages are scored once.  The parsed logs, the distinct messages (with how
often each occurs), the context counts, the loss table and the scored logs are written to the shared
checkpoint folder as tables, so nothing is cached, each is computed once, and the threshold and
the min/max read single columns of the scored table.  Token positions are never stored: they are
exploded again where they are read, and those of frequent contexts, which are most, meet their losses where
they are; only the others are shuffled, and a message's sum and highest losses are gathered as numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import tokenize_expr
from logsieve.operators import explain as ex
from logsieve.operators import flags as fl
from logsieve.operators.model import ContextModel, positions, score, score_rounded, token_losses, tokens_at
from logsieve.operators.parse import drop_blank, parse_positional
from logsieve.operators.tokens import MAX_LENGTH, tokenize
from logsieve.session import dealt, written

RESULT_COLUMNS = ["log_id", "timestamp", "message", "anomaly_score", "is_anomaly", "rule_based_flag",
                  "is_whitelisted", "combined_anomaly", "confidence_score", "explanation"]

#: positions (id, pos, l, t, r) -> the same with a loss
Losses = Callable[[DataFrame], DataFrame]


def distinct_messages(logs: DataFrame, message_col: str = "message") -> DataFrame:
    """(_text, _times, _mid): each distinct message, how often it occurs, and a number."""
    counted = (logs.filter(F.col(message_col).isNotNull()).groupBy(F.col(message_col).alias("_text"))
               .agg(F.count(F.lit(1)).alias("_times")))
    # numbered in the tasks that write, so that a number never changes once it was seen
    return written(dealt(counted).withColumn("_mid", F.monotonically_increasing_id()))


def score_messages(logs: DataFrame, model: ContextModel | None = None, message_col: str = "message",
                   max_length: int = MAX_LENGTH, denominator: str = "max_length",
                   losses: Losses | None = None) -> DataFrame:
    """(message, anomaly_score, top_tokens) of every distinct message.  `losses` replaces the
    count model: any function that adds a column `loss` to positions (_mid, pos, l, t, r)."""
    distinct = distinct_messages(logs, message_col)
    pos = positions(tokenize(distinct, "_text"), "_mid", "tokens", max_length, keep=("_times",))
    if losses is not None:
        scored = distinct.join(score(losses(pos), "_mid", max_length, denominator), "_mid")
    else:
        # dealt once, by the key that the scores come back by: a file's few splits would be few large tasks, whose places
        # are sorted by message and spilled
        texts = dealt(distinct.select("_mid", "_text"), "_mid")
        places = positions(tokenize(texts, "_text"), "_mid", "tokens", max_length)
        scores = score_rounded(token_losses(places, model, times="_times", counted=pos), "_mid", max_length, denominator)
        top = tokens_at(tokenize_expr(F.col("_text")), F.col("_top"), max_length)
        scored = texts.join(scores, "_mid").withColumn("top_tokens", top)
    return scored.select(F.col("_text").alias(message_col), "anomaly_score", "top_tokens")


def score_logs(logs: DataFrame, model: ContextModel | None = None, id_col: str = "log_id",
               message_col: str = "message", max_length: int = MAX_LENGTH,
               denominator: str = "max_length", losses: Losses | None = None) -> DataFrame:
    """(id, anomaly_score, top_tokens) for every log with a message."""
    scores = score_messages(logs, model, message_col, max_length, denominator, losses)
    return logs.select(id_col, message_col).join(scores, message_col).drop(message_col)


def scored_logs(lines: DataFrame, model: ContextModel | None = None, losses: Losses | None = None) -> DataFrame:
    """Parsed logs with anomaly_score and top_tokens, as a written table."""
    # parsed once, before the blank filter: pushed below the parse, the filter would parse again
    logs = drop_blank(written(parse_positional(lines)))
    # both sides of the join by message are plain exchanges, so a line in a third of all rows is split
    scores = written(score_messages(logs, model, losses=losses))
    return written(logs.join(scores, "message"))


def detect(lines: DataFrame, model: ContextModel | None = None, percentile: float = fl.DEFAULT_PERCENTILE,
           threshold_method: str = "select", ignore_case: bool = False, keep_top_tokens: bool = False,
           losses: Losses | None = None) -> DataFrame:
    """`lines` = (log_id, line).  Returns the scored log table (RESULT_COLUMNS).  Scores come from
    the lines' own counts, from a stored `model`, or from `losses` (see score_messages)."""
    scored = scored_logs(lines, model, losses)
    out = fl.flag_scores(scored, fl.score_threshold(scored, "anomaly_score", percentile, method=threshold_method))
    out = fl.rule_flags(out)
    out = fl.apply_allowlist(out)
    out = fl.combine_flags(out)
    out = fl.confidence(out)
    out = ex.explain(out, "top_tokens", ignore_case)
    cols = RESULT_COLUMNS + (["top_tokens"] if keep_top_tokens else [])
    return out.select(*cols)
