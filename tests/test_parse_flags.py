"""Hand-made lines (FIXTURES section 7): parsers and keyword flags."""

from pyspark.sql import functions as F

from logsieve.operators import flags as fl
from logsieve.operators.parse import coerce_timestamp, drop_blank, parse_labelled, parse_positional, parse_strict
from logsieve.sources.logs import clean_lines

LINES = [
    (1, "2024-01-01 00:00:01 a  b [ERR]\t"),
    (2, "one"),
    (3, "two words"),
    (4, "   \t "),
    (5, "2024-13-01 00:00:01 q"),
    (6, " lead [ERR] [OK] x"),
    (7, "2024-01-01 00:00:01 x [err] y"),
    (8, "2024-01-01 00:00:01 x [ERR] a [WRN] b"),
    (9, "2024-01-01 00:00:01"),
]


def frame(spark, rows=LINES):
    return spark.createDataFrame(rows, "log_id bigint, line string")


def by_id(df):
    return {r["log_id"]: r for r in df.collect()}


def test_strict_parse(spark):
    got = by_id(parse_strict(clean_lines(frame(spark))))
    assert 4 not in got
    assert (got[1]["timestamp"], got[1]["message"]) == ("2024-01-01 00:00:01", "a  b [ERR]")
    assert (got[2]["timestamp"], got[2]["message"]) == (None, "one")
    assert (got[3]["timestamp"], got[3]["message"]) == (None, "two words")
    assert (got[5]["timestamp"], got[5]["message"]) == ("2024-13-01 00:00:01", "q")
    assert (got[6]["timestamp"], got[6]["message"]) == (None, "lead [ERR] [OK] x")
    assert got[9]["message"] == ""


def test_positional_parse_and_blank_drop(spark):
    got = by_id(drop_blank(parse_positional(clean_lines(frame(spark)))))
    assert (got[1]["timestamp"], got[1]["message"]) == ("2024-01-01 00:00:01", "a b [ERR]")
    assert (got[2]["timestamp"], got[2]["message"]) == ("N/A", "one")
    assert 3 not in got and 4 not in got and 9 not in got
    assert (got[6]["timestamp"], got[6]["message"]) == ("lead [ERR]", "[OK] x")


def test_flags_and_allowlist(spark):
    d = drop_blank(parse_positional(clean_lines(frame(spark))))
    raw = by_id(fl.rule_flags(d))
    assert (raw[1]["rule_based_flag"], raw[1]["is_whitelisted"]) == (True, False)
    assert (raw[6]["rule_based_flag"], raw[6]["is_whitelisted"]) == (False, True)
    assert (raw[7]["rule_based_flag"], raw[7]["is_whitelisted"]) == (False, False)
    assert raw[8]["rule_based_flag"] is True
    strict = by_id(fl.rule_flags(parse_strict(clean_lines(frame(spark)))))
    assert (strict[6]["rule_based_flag"], strict[6]["is_whitelisted"]) == (True, True)
    after = by_id(fl.combine_flags(fl.apply_allowlist(
        fl.rule_flags(parse_strict(clean_lines(frame(spark)))).withColumn("is_anomaly", F.lit(True)))))
    assert after[6]["rule_based_flag"] is False and after[6]["is_anomaly"] is False
    assert after[6]["combined_anomaly"] is False
    assert after[1]["combined_anomaly"] is True


def test_labelled_parse(spark):
    rows = [(1, "2024-01-01 00:00:01 ok ##NORMAL"), (2, "a##b ##ANOMALY"),
            (3, "x ##NORMAL ##ANOMALY"), (4, "no tag")]
    got = by_id(parse_labelled(frame(spark, rows)))
    assert (got[1]["message"], got[1]["label"]) == ("2024-01-01 00:00:01 ok ", 0)
    assert (got[2]["message"], got[2]["label"]) == ("a", 1)
    assert (got[3]["message"], got[3]["label"]) == ("x ", 1)
    assert 4 not in got


def test_coerce_timestamp(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10",), ("2024-13-01 00:00:01",), ("N/A",)], "t string")
    vals = [r[0] for r in df.select(coerce_timestamp(F.col("t"))).collect()]
    assert str(vals[0]) == "2024-01-01 00:00:10" and vals[1] is None and vals[2] is None
