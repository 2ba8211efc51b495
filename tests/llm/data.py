"""Small hard tables that every operator has to take."""
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
BODY = " ".join(f"word{i}" for i in range(40))

#: doc_id, text, lang, source, n_chars and columns named like the operators' own.
ROWS = [
    (1, BODY, "en", "s", 5), (2, BODY, None, None, None), (2, BODY, None, None, None), (3, None, "en", "s", 1),
    (None, "", None, "s", 0), (4, "", "de", "s", 0), (5, " \n\t ", "de", "s", 3), (6, LONG, "en", "s", 9),
    (7, BODY.replace(" ", "  \n"), "en", "s", 4), (8, BODY + " tail", "en", "s", 2), (9, "日本語 café “x”—y <|endoftext|>", "ja", "s", 1),
    (None, None, None, None, None), (10, "a", "en", "s", 1), (11, LONG + " more", "en", "s", 1), (12, "x" * 200_000, "en", "s", 1),
]
EXTRA = ["__row", "__id", "__text", "h", "content", "key", "n", "keep_id", "severity"]


def schema(extra=True):
    base = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
            ("n_chars", T.LongType())] + ([(c, T.StringType()) for c in EXTRA] if extra else [])
    return T.StructType([T.StructField(n, t) for n, t in base])


def hard_docs(spark):
    return spark.createDataFrame([(*r, *["z"] * len(EXTRA)) for r in ROWS], schema()).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], schema())


def table_of(rows):
    return sorted((tuple(r) for r in rows), key=str)
