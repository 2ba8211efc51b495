"""Column expressions.  Nothing here shuffles; everything stays in the JVM."""

from logsieve.functions.hashing import h01, rand_int, rand_choice
from logsieve.functions.text import (
    strip, split_words, contains_any, tokenize_expr, TOKEN_PATTERN, lookup,
)
from logsieve.functions.numeric import cross_entropy, argmax

__all__ = [
    "h01", "rand_int", "rand_choice", "strip", "split_words", "contains_any",
    "tokenize_expr", "TOKEN_PATTERN", "lookup", "cross_entropy", "argmax",
]
