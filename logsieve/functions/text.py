"""Text expressions shared by the parsers, the tokenizer and the flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.isspace defines it (what str.strip / str.split use),
# built from that rule; strip is a character-set trim and split a character class, so
# neither needs a Unicode-mode regular expression.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE) + "]"
# Regular expressions (Java syntax, as Spark sees them).
WORD_SPLIT_PATTERN = WS_CLASS + "+"
STRIP_PATTERN = "^" + WS_CLASS + "+|" + WS_CLASS + "+$"
# Uncased word splitting: after lower-casing, accents and control characters are removed; a token is
# one punctuation mark (Unicode category P, or an ASCII symbol), one CJK ideograph, or a run of
# other characters between white space.
CJK_RANGES = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
              (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
_CJK = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CJK_RANGES)
_SINGLE = r"\p{P}$+<=>^`|~" + _CJK
TOKEN_PATTERN = rf"([{_SINGLE}]|[^{_SINGLE}\p{{Z}}\t\n\r]+)"
# The same for printable ASCII text, where the classes are small and fast.
ASCII_TOKEN_PATTERN = r"([^\p{Punct}\s]+|\p{Punct})"
CONTROL_PATTERN = r"[\p{C}\x{fffd}&&[^\t\n\r]]"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space."""
    return F.btrim(c, F.lit(WHITESPACE))


# The same set as a Java class: the White_Space property plus U+001C..U+001F (the
# explicit 29-entry class matches the same characters but is several times slower).
WORD_PATTERN = r"([^\p{IsWhite_Space}\x{1c}-\x{1f}]+)"


def split_words(c: Column) -> Column:
    """Words (runs of non-white-space) of a string.  `regexp_extract_all` keeps its
    compiled pattern across rows (`split` with a multi-character pattern recompiles it
    for every row)."""
    return F.regexp_extract_all(c, F.lit(WORD_PATTERN), 1)


def contains_any(c: Column, keywords) -> Column:
    """True when `c` contains any keyword, literally and case-sensitively."""
    cond = F.lit(False)
    for kw in keywords:
        cond = cond | c.contains(kw)
    return F.coalesce(cond, F.lit(False))


def tokenize_expr(c: Column, accents: bool = False) -> Column:
    """Uncased word and punctuation tokens (array<string>); accents=True keeps accents.  Printable
    ASCII text has neither accents nor control characters and skips their removal."""
    clean = F.lower(F.regexp_replace(c, CONTROL_PATTERN, ""))
    clean = clean if accents else strip_accents(clean)
    return (F.when(c.rlike(r"[^\x20-\x7e\t\n\r]"), F.regexp_extract_all(clean, F.lit(TOKEN_PATTERN), 1))
            .otherwise(F.regexp_extract_all(F.lower(c), F.lit(ASCII_TOKEN_PATTERN), 1)))


def lookup(c: Column, mapping: dict, default=None) -> Column:
    """Value of `c` in a small literal map, else `default` (a map literal, no join)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    hit = F.try_element_at(F.create_map(*kv), c)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def _accent_table():
    """(accented, base) characters: every character of the basic plane whose canonical decomposition
    is one letter followed only by combining marks (a rule, not a list)."""
    import unicodedata
    src, dst = [], []
    for code in range(0x00C0, 0xFFFE):
        ch = chr(code)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]) and unicodedata.category(d[0]) != "Mn":
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


ACCENTED, ACCENT_BASE = _accent_table()


def strip_accents(c: Column) -> Column:
    """Accented letters become their base letters (JVM-side `translate`), and combining marks go."""
    return F.regexp_replace(F.translate(c, ACCENTED, ACCENT_BASE), r"\p{Mn}", "")
