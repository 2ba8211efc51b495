"""Text to tokens: word splitting, vocabulary, fixed-length encoding, decoding,
word pieces and masked examples.  Work is distributed by row; token lookups are
joins against the vocabulary, never driver-side dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.hashing import h01
from logsieve.functions.text import tokenize_expr
from logsieve.operators.joins import apart_join, frequency_split_join
from logsieve.operators.prep import descending, with_global_index
from logsieve.session import written

# Special tokens and their ids, sequence length and the ignore label.
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIAL_TOKENS = [PAD, UNK, CLS, SEP, MASK]          # ids 0, 1, 2, 3, 4
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
MAX_LENGTH = 64
IGNORE_LABEL = -100


def tokenize(df: DataFrame, col: str = "message", out: str = "tokens", accents: bool = False) -> DataFrame:
    """Lower-case word / punctuation tokens as array<string>, without accents unless `accents`."""
    return df.withColumn(out, tokenize_expr(F.col(col), accents))


def token_sequence(tokens: Column, max_length: int = MAX_LENGTH) -> Column:
    """`[CLS]` + the first max_length-2 tokens + `[SEP]`."""
    return F.concat(F.array(F.lit(CLS)), F.slice(tokens, 1, max_length - 2), F.array(F.lit(SEP)))


def build_vocab(df: DataFrame, tokens_col: str = "tokens", min_count: int = 1,
                max_size: int | None = None, times: str | None = None) -> DataFrame:
    """(token_id INT, token STRING, count BIGINT): specials 0-4, then tokens by count
    desc, token asc, numbered by one distributed global numbering; max_size keeps the
    smallest ids.  `times` is a column with the number of rows that a row stands for."""
    n = F.count(F.lit(1)) if times is None else F.sum("_times")
    rows = df.select(tokens_col, (F.lit(1) if times is None else F.col(times)).cast("long").alias("_times"))
    # outer: for a plain explode the optimizer adds a filter that would tokenize once more
    counts = (rows.select("_times", F.explode_outer(tokens_col).alias("token")).filter(F.col("token").isNotNull())
              .groupBy("token").agg(n.alias("count"))
              .filter((F.col("count") >= min_count) & ~F.col("token").isin(*SPECIAL_TOKENS)))
    ranked = with_global_index(counts, [descending("count"), "token"], "_rank")
    if max_size is not None:
        ranked = ranked.filter(F.col("_rank") < max_size - len(SPECIAL_TOKENS))
    words = ranked.select((F.col("_rank") + len(SPECIAL_TOKENS)).cast("int").alias("token_id"),
                          "token", "count")
    spark = df.sparkSession
    specials = spark.createDataFrame([(i, t, 0) for i, t in enumerate(SPECIAL_TOKENS)],
                                     "token_id int, token string, count bigint")
    return specials.unionByName(words)


def encode(df: DataFrame, vocab: DataFrame, id_col: str = "log_id", tokens_col: str = "tokens",
           max_length: int = MAX_LENGTH) -> DataFrame:
    """(id, input_ids, attention_mask, labels): `[CLS]` + ids of the first max_length-2
    tokens (unknown -> `[UNK]`) + `[SEP]`, padded with 0 to max_length."""
    pos = df.select(id_col, F.posexplode_outer(F.slice(tokens_col, 1, max_length - 2)).alias("pos", "token"))
    # a row without tokens gets a key of its own that no word has, so such rows are dealt evenly
    alone = F.concat(F.lit("\u0000"), F.col(id_col).cast("string"))
    looked = frequency_split_join(pos.withColumn("token", F.coalesce("token", alone)),
                                  vocab.select("token", "token_id", "count"), ["token"], "count", how="left")
    item = F.when(F.col("pos").isNotNull(),
                  F.struct(F.col("pos"), F.coalesce(F.col("token_id"), F.lit(UNK_ID)).alias("id")))
    grouped = looked.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    ids = F.col("_items").getField("id")
    n = F.size(ids)
    return grouped.select(
        id_col,
        F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)),
                 F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - n - 2)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n + 2),
                 F.array_repeat(F.lit(0), F.lit(max_length) - n - 2)).alias("attention_mask"),
    ).withColumn("labels", F.col("input_ids"))


def decode(df: DataFrame, vocab: DataFrame, id_col: str = "log_id", ids_col: str = "input_ids",
           out: str = "decoded") -> DataFrame:
    """Ids -> token strings (same order, same length)."""
    pos = df.select(id_col, F.posexplode(ids_col).alias("pos", "token_id"))
    joined = frequency_split_join(pos, vocab.select("token_id", "token", "count"),
                                  ["token_id"], "count", how="left")
    return (joined.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit(UNK)).alias("t"))))
                 .getField("t").alias(out)))


def mask_tokens(encoded: DataFrame, vocab_size: int, id_col: str = "log_id", seed: int = 0,
                p: float = 0.15, mask_share: float = 0.8, random_share: float = 0.1) -> DataFrame:
    """Masked-example builder, in-row (no shuffle).  Each real, non-special position is
    chosen with probability p; a chosen id becomes `[MASK]` (80 %), a random word id
    (10 %) or stays (10 %).  labels = original id where chosen, else -100.  Draws are
    h01(seed, row id, position, name), so the result is reproducible."""
    rid, first = F.col(id_col), len(SPECIAL_TOKENS)

    def drawn(x, i):
        """(new id, label): the pick is drawn once and both outputs follow from it."""
        kind = h01(seed, rid, i, "kind")
        word = (F.lit(first) + F.floor(h01(seed, rid, i, "word") * F.lit(vocab_size - first))).cast("int")
        new = F.when(kind < F.lit(mask_share), F.lit(MASK_ID)).when(kind < F.lit(mask_share + random_share), word).otherwise(x)
        picked = (x >= first) & (h01(seed, rid, i, "pick") < F.lit(p))
        return F.when(picked, F.struct(new.alias("id"), x.alias("label"))).otherwise(
            F.struct(x.alias("id"), F.lit(IGNORE_LABEL).alias("label")))

    both = F.transform(F.col("input_ids"), drawn)
    rest = [c for c in encoded.columns if c not in ("input_ids", "labels")]
    return (encoded.select(*rest, both.alias("_both"))
            .select(*rest, F.col("_both.id").alias("input_ids"), F.col("_both.label").alias("labels")))


# ---------------------------------------------------------------- word pieces
def word_pieces(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """A piece table: the vocabulary words as word starts and as `##` continuations, plus every
    character of `words` (distinct words, column `word`) in both roles."""
    whole = vocab.filter(~F.col("token").isin(*SPECIAL_TOKENS)).select(F.col("token").alias("piece"))
    chars = words.select(F.explode(F.split("word", "")).alias("piece")).filter(F.col("piece") != "")
    base = whole.unionByName(chars).distinct()
    return base.unionByName(base.select(F.concat(F.lit("##"), F.col("piece")).alias("piece"))).distinct()


def distinct_words(df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(word, m): each distinct token and how often it occurs."""
    words = df.select(F.explode_outer(tokens_col).alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("m"))


#: A longer word is not split but becomes `[UNK]`.
MAX_WORD_CHARS = 100


def split_words_greedily(words: DataFrame, pieces: DataFrame, max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """(word, wp): greedy longest-match pieces of each distinct word; continuation pieces start
    with `##`; a word that cannot be covered becomes `[UNK]`, as does one longer than `max_chars`.

    The pieces' lengths are gathered by their first one or two letters, so a place of a word is paired only with the
    lengths that pieces beginning with its letters have.  Candidates longer than those letters are joined with the piece
    table, a word keeps the longest match of each place, and the greedy walk over those is an in-row fold.  A
    word has at most `max_chars` places and a piece as many letters, so the work is linear in the number of
    distinct words; the piece table may have any size."""
    n = F.length("word")
    short = words.select("word").filter(n <= max_chars)
    # a piece as a word's start, and without its mark as a continuation
    roles = F.array(F.struct(F.lit(False).alias("inner"), F.col("piece").alias("body")),
                    F.struct(F.lit(True).alias("inner"), F.expr("substring(piece, 3)").alias("body")))
    bodies = (pieces.select(F.inline(roles), "piece").filter(~F.col("inner") | F.col("piece").startswith("##"))
              .filter((F.col("body") != "") & (F.length("body") <= max_chars)))
    heads = (bodies.groupBy("inner", F.substring("body", 1, 2).alias("head"))
             .agg(F.collect_set(F.length("body")).alias("sizes")))       # at most max_chars lengths
    places = short.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    letters = lambda k: F.substring(F.col("word"), F.col("at") + 1, F.lit(k))
    places = places.select("word", "at", (F.col("at") > 0).alias("inner"),
                           F.explode(F.array_distinct(F.array(letters(1), letters(2)))).alias("head"))
    # once each: a head of one letter has only the size 1, one of two letters only larger sizes
    spans = (places.join(heads, ["inner", "head"]).select("word", "at", "head", F.explode("sizes").alias("size"))
             .filter(F.col("at") + F.col("size") <= n))
    # a piece as long as its head is the head, so those candidates are pieces and are not looked up
    proven = F.col("size") == F.length("head")
    part = F.substring(F.col("word"), F.col("at") + 1, F.col("size"))
    spelled = F.when(F.col("at") == 0, part).otherwise(F.concat(F.lit("##"), part))
    # one row per piece on the other side; candidates of a frequent piece are split by AQE
    hits = spans.filter(~proven).select("word", "at", "size", spelled.alias("piece")).join(pieces, "piece").select("word", "at", "size")
    longest = (spans.filter(proven).select("word", "at", "size").unionByName(hits)
               .groupBy("word", "at").agg(F.max("size").alias("size")))
    found = longest.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("best"))
    cover = words.select("word").join(found, "word", "left")
    best = F.coalesce("best", F.create_map().cast("map<int,int>"))

    def step(acc, i):
        size = F.try_element_at(best, i)
        text = F.substring(F.col("word"), i + 1, size)
        piece = F.when(i == 0, text).otherwise(F.concat(F.lit("##"), text))
        return F.when(i != acc["next"], acc).when(size.isNull(), F.struct(
            F.lit(-1).alias("next"), acc["out"].alias("out"))).otherwise(
            F.struct((i + size).alias("next"), F.concat(acc["out"], F.array(piece)).alias("out")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    walk = F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(max_chars)) - 1), start, step)
    return (cover.withColumn("_walk", walk)
            .select("word", F.when(F.col("_walk.next") == n, F.col("_walk.out")).otherwise(F.array(F.lit(UNK))).alias("wp")))


def encode_subword(df: DataFrame, pieces: DataFrame, id_col: str = "log_id", tokens_col: str = "tokens",
                   out: str = "pieces", max_chars: int = MAX_WORD_CHARS) -> DataFrame:
    """Split every token into word pieces: once per distinct word, then joined back to the token
    positions (only those of rare words are shuffled, see joins.apart_join)."""
    words = written(distinct_words(df, tokens_col))
    table = written(split_words_greedily(words, written(pieces), max_chars).join(words, "word"))
    pos = df.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "word"))
    # frequent words, which are most, are split where they are; a row without words is kept
    bare = pos.filter(F.col("word").isNull()).withColumn("wp", F.lit(None).cast(table.schema["wp"].dataType))
    looked = apart_join(pos, table, ["word"], "m").unionByName(bare)
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "wp"))
    return (looked.groupBy(id_col)
            .agg(F.flatten(F.coalesce(F.array_sort(F.collect_list(item)).getField("wp"),
                                      F.array().cast("array<array<string>>"))).alias(out)))
