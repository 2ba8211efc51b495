"""Explanations built from the highest-loss tokens of each log (in-row expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.text import lookup
from logsieve.operators.joins import frequency_split_join

# Token meanings (keys are upper case while tokens are lower case, so by
# default they never match -- pass ignore_case=True to look tokens up in upper case),
# the default meaning and the three explanation texts (plus the unreachable one).
TOKEN_MEANINGS = {
    "CRIT": "critical failure event",
    "ERR": "indicates a system failure",
    "WRN": "system degraded",
}
DEFAULT_MEANING = "uncommon usage"
TEXT_ALLOWED = ("No anomaly detected in this log. The content aligns with expected patterns "
                "for normal operations.")
TEXT_FLAGGED_HEAD = "This log shows unusual patterns with tokens: "
TEXT_FLAGGED_TAIL = (". These contributed significantly to the anomaly score. It was flagged as "
                     "anomalous because of high model loss and/or matching critical keywords.")
TEXT_NORMAL_HEAD = "Although some tokens like: "
TEXT_NORMAL_MID = " show moderate deviation, the model determined this log to be normal. "
REASON_RULE = ("However, despite containing flagged keywords, the overall pattern was not "
               "considered anomalous by the model.")
REASON_NORMAL = ("The log's content closely aligns with patterns seen in normal logs, resulting "
                 "in a low anomaly score.")


def token_meaning(tok: Column, ignore_case: bool = False) -> Column:
    key = F.upper(tok) if ignore_case else tok
    return lookup(key, TOKEN_MEANINGS, DEFAULT_MEANING)


def lookup_meanings(df: DataFrame, mapping: DataFrame, token_col: str = "token", out: str = "meaning",
                    default: str = DEFAULT_MEANING) -> DataFrame:
    """Meanings from a table (token, meaning, freq) of any size: a join that broadcasts only its
    hot tokens (see joins); tokens that it does not have get `default`."""
    keyed = mapping.select(F.col("token").alias(token_col), F.col("meaning").alias(out), "freq")
    return frequency_split_join(df, keyed, [token_col], "freq", "left").withColumn(out, F.coalesce(out, F.lit(default)))


def explain_tokens(arr: Column, ignore_case: bool = False) -> Column:
    """`'tok' (meaning)` phrases joined by `, `."""
    phrases = F.transform(arr, lambda t: F.concat(F.lit("'"), t, F.lit("' ("),
                                                  token_meaning(t, ignore_case), F.lit(")")))
    return F.array_join(phrases, ", ")


def explain(df: DataFrame, tokens_col: str = "top_tokens", ignore_case: bool = False) -> DataFrame:
    detail = explain_tokens(F.col(tokens_col), ignore_case)
    text = (F.when(F.col("is_whitelisted"), F.lit(TEXT_ALLOWED))
            .when(F.col("combined_anomaly"),
                  F.concat(F.lit(TEXT_FLAGGED_HEAD), detail, F.lit(TEXT_FLAGGED_TAIL)))
            .otherwise(F.concat(F.lit(TEXT_NORMAL_HEAD), detail, F.lit(TEXT_NORMAL_MID),
                                F.when(F.col("rule_based_flag"), F.lit(REASON_RULE))
                                .otherwise(F.lit(REASON_NORMAL)))))
    return df.withColumn("explanation", text)
