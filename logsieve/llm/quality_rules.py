"""Quality rules as a ledger of bits.

1. `measure` reads every text once and keeps whole-number measurements of it.
2. `ledger` evaluates every rule once on the measurements: rule k that fails sets bit k of
   `fail_bits`.  Texts are not needed again.
3. `apply_policy` keeps the rows whose failure bits do not meet the mask of a policy, a named
   and versioned set of rules, so that a new policy costs a scan of two columns.
4. `ablation` counts rows by failure bits (one map-side combined aggregate, at most two to the power
   of the number of rules patterns) and derives from the patterns, by mask arithmetic, what
   each policy drops, what a rule alone drops and what stays when it is taken out.

Words are runs of characters other than space and tab to carriage return.  A word is repeated when it
lies in a window of three words whose words occur twice or more in the text; windows are compared
by their words (numbered within the text), not by hashes.

Defined results: null text is empty (no words, so the word rule fails and the row is not
kept); null and repeated identifiers are rows like others, and every row has one result; an empty
table gives no rows (the ablation gives zeros); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.llm.common import map_batches, table

#: Measurements, all whole numbers.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that begin no letter: controls, digits and punctuation of ASCII, and the bytes inside a
#: longer character, of which only the first counts.
NO_LETTER = bytes(b for b in range(0xC0) if not chr(b).isalpha() or b >= 0x80)


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL condition on the measurements, in whole numbers."""
    name: str
    fails: str


#: Bit k belongs to rule k; a new rule goes to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule("upper_case", "10 * n_upper > 3 * word_chars"),
    Rule("few_letters", "10 * n_letters < 6 * word_chars"),
)

#: The rules that decide, by version.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}
POLICY = "v2"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of `width` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    size = len(number)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    window = ids
    for k in range(1, width):  # numbers of longer and longer windows, below n each, so products fit
        window = window[:-1] * size + ids[k:]
        _, window, counts = np.unique(window, return_inverse=True, return_counts=True)
        if len(counts) == len(window):
            return 0  # all different already, so longer ones are too
    found = np.flatnonzero(counts[window] > 1)
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def measurements(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text in UTF-8."""
    def without(drop: bytes, of: bytes = text) -> int:
        return len(of) - len(of.translate(None, drop))

    words = text.split()  # bytes split at exactly the white space of the definition
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    inner = without(bytes(range(0x80, 0xC0)))
    chars = len(text) - inner - without(SPACES)
    return (len(words), chars, without(SYMBOLS), len(lines), len(lines) - len(set(lines)),
            repeated_words(words), without(UPPER), len(text.translate(None, NO_LETTER)))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and MEASURES of every document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measurements(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *MEASURES])

    return map_batches(slim, run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES), __name__)


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    out = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        out = out.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: 1 << k for k, r in enumerate(rules)}
    return sum(bit[n] for n in set(names))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, MEASURES and fail_bits of every document; to be stored and read by policies."""
    if len(rules) > 62:
        raise ValueError("a ledger has at most 62 rules")
    return measure(docs, id_col, text_col).withColumn("fail_bits", fail_bits(rules))


def apply_policy(entries: DataFrame, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES,
                 out: str = "kept") -> DataFrame:
    """The ledger with a boolean column: no rule of the policy fails."""
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask_of(names, rules)).cast("long")) == 0)


def ablation(entries: DataFrame, policies: dict[str, tuple[str, ...]] | None = None,
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, rule, n_docs, fails, only (no other rule of the policy fails), kept, kept_without (the
    policy without the rule): one row per policy and rule of it, zeros included."""
    spark = entries.sparkSession
    policies = POLICIES if policies is None else policies
    pairs = [(p, r, mask_of(names, rules), mask_of((r,), rules)) for p, names in policies.items() for r in names]
    if not pairs:
        return spark.createDataFrame([], "policy string, rule string, n_docs long, fails long, only long, kept long, kept_without long")
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"),
                              F.lit(b).cast("long").alias("bit")) for p, r, m, b in pairs])
    bits, n = F.col("fail_bits"), F.col("n")
    mask, bit = F.col("x.mask"), F.col("x.bit")
    within = bits.bitwiseAND(mask)
    total = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    zero = spark.range(1).select(F.lit(0).cast("long").alias("fail_bits"), F.lit(0).cast("long").alias("n"))
    return (patterns.unionByName(zero).withColumn("x", F.explode(each))
            .groupBy(F.col("x.policy").alias("policy"), F.col("x.rule").alias("rule"))
            .agg(F.sum("n").alias("n_docs"), total(bits.bitwiseAND(bit) != 0).alias("fails"),
                 total(within == bit).alias("only"), total(within == 0).alias("kept"),
                 total((within == 0) | (within == bit)).alias("kept_without")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["base"], out="base_kept")
    return apply_policy(entries, POLICIES[POLICY]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits", "n_lines", "n_upper", "n_letters")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ln
  FROM documents),
windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
repeated AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c >= 2),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'))::BIGINT AS n_letters
  FROM d LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_upper > 3 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_letters < 6 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, n_lines, n_upper, n_letters
FROM b
"""
