"""Chunked continued fitting and its evaluation, as one job for all chunks.

labelled logs -> exact 80/20 split -> k equal chunks of the training part in a seeded random
order (rest dropped) -> model after chunk i = base counts + chunks 1..i -> masked-token
examples from the held-out part -> per chunk: back-off predictions, mean loss of the true
token, accuracy and support-weighted precision / recall / F1.

The evaluation works on distinct contexts with their counts: predictions and losses are looked
up once per distinct context and chunk, and every metric is a sum weighted by the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsieve.functions.hashing import h01
from logsieve.operators import metrics as mt
from logsieve.operators.joins import frequency_split_join
from logsieve.operators.model import ContextModel, fit, fit_chunks, loss_table, positions, predict
from logsieve.operators.prep import chunk, train_test_split
from logsieve.operators.tokens import MASK, SPECIAL_TOKENS, tokenize
from logsieve.session import written

EVAL_DIGITS = 4


def masked_eval_positions(logs: DataFrame, vocab: DataFrame | None = None, seed: int = 0, p: float = 0.15,
                          id_col: str = "log_id", mask_share: float = 0.8, random_share: float = 0.1) -> DataFrame:
    """Held-out examples at token level: inner positions are chosen with probability p (draw
    h01(seed, id, pos, 'pick')).  A chosen neighbour of a chosen position reads `[MASK]` (80 %), a
    random word of `vocab` (10 %) or itself (10 %), as in the masked-example builder; without a
    vocabulary it always reads `[MASK]`.  Returns (id, pos, l, t, r) of chosen positions; t is the truth."""
    pos = positions(tokenize(logs.select(id_col, "message")), id_col, "tokens", with_len=True)

    def draw(j, name):
        return h01(seed, F.col(id_col), j, name)

    def chosen(j):
        return (j > 1) & (j < F.col("seq_len")) & (draw(j, "pick") < F.lit(p))

    here, left, right = F.col("pos"), F.col("pos") - 1, F.col("pos") + 1
    picked = pos.filter(chosen(here)).withColumns({"_cl": chosen(left), "_cr": chosen(right)})
    if vocab is None:
        seen = lambda c, flag: F.when(F.col(flag), F.lit(MASK)).otherwise(F.col(c)).alias(c)
        return picked.select(id_col, "pos", seen("l", "_cl"), "t", seen("r", "_cr"))
    size = vocab.agg((F.count(F.lit(1)) - len(SPECIAL_TOKENS)).alias("_words"))
    words = vocab.select(F.col("token_id").cast("long").alias("_id"), F.col("token").alias("_word"))

    def replaced(df: DataFrame, c: str, flag: str, j: Column) -> DataFrame:
        df = df.withColumn("_kind", F.when(F.col(flag), draw(j, "kind")))
        random = (F.col("_kind") >= mask_share) & (F.col("_kind") < mask_share + random_share)
        number = F.lit(len(SPECIAL_TOKENS)) + F.floor(draw(j, "word") * F.col("_words"))
        # rows without a random word get a negative key of their own: no common null key
        key = F.when(random, number).otherwise(-1 - F.pmod(F.xxhash64(id_col, "pos"), F.lit(1 << 20)))
        df = df.withColumn("_id", key.cast("long")).join(words, "_id", "left")
        new = (F.when(F.col("_kind") < mask_share, F.lit(MASK)).when(random, F.col("_word")).otherwise(F.col(c)))
        return df.withColumn(c, new).drop("_id", "_word", "_kind")

    both = replaced(replaced(picked.crossJoin(F.broadcast(size)), "l", "_cl", left), "r", "_cr", right)
    return both.select(id_col, "pos", "l", "t", "r")


def prepare(labelled: DataFrame, k: int = 5, seed: int = 0, test_size: float = 0.2):
    """(train chunks, held-out rows) of a labelled log table (log_id, message, label).  The training
    part is shuffled by a seeded draw before it is cut, so each chunk is a random sample."""
    split = written(train_test_split(written(labelled), "log_id", test_size, seed=seed, exact=True), spread=True)
    order = [h01(seed, "shuffle", F.col("log_id")), "log_id"]
    train = chunk(split.filter(~F.col("is_test")), k, order, "drop")
    test = split.filter(F.col("is_test"))
    return train, test


def fit_finetune(base: ContextModel | None, train_chunks: DataFrame, k: int = 5,
                 label_filter: str | None = None) -> ContextModel:
    """Continued fit over the chunks.  By default every training line is learned (the
    labels are not used, as in masked-token training); label_filter (e.g. "label = 0")
    fits on the normal lines only."""
    if label_filter:
        train_chunks = train_chunks.filter(label_filter)
    pos = positions(tokenize(train_chunks.select("log_id", "chunk", "message")), "log_id", "tokens", keep=("chunk",))
    model = fit_chunks(base, pos, k)
    return ContextModel(written(model.counts), model.by, model.weights, model.alpha).summed()


def context_predictions(model: ContextModel, eval_pos: DataFrame, k: int) -> DataFrame:
    """(chunk, l, t, r, m, loss, prediction): every distinct held-out context, occurring m times,
    under every chunk's model."""
    distinct = written(eval_pos.groupBy("l", "t", "r").agg(F.count(F.lit(1)).alias("m")), spread=True)
    each = distinct.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("chunk"), "*")
    return predict(loss_table(model, each), model)


def chunk_predictions(model: ContextModel, eval_pos: DataFrame, k: int) -> DataFrame:
    """Every held-out example under every chunk's model: (chunk, log_id, pos, l, t, r, prediction, loss)."""
    table = written(context_predictions(model, eval_pos, k))
    each = eval_pos.select(F.explode(F.sequence(F.lit(1), F.lit(k))).alias("chunk"), "*")
    return frequency_split_join(each, table, ["chunk", "l", "t", "r"], "m")


def evaluate_chunks(model: ContextModel, eval_pos: DataFrame, k: int, metrics=None) -> DataFrame:
    """Metrics table per chunk (eval_loss, eval_accuracy, eval_precision, eval_recall,
    eval_f1), rounded to 4 places.  `metrics` may replace the classification metrics:
    a function DataFrame(chunk, label, prediction, m) -> DataFrame(chunk, ...), m rows each."""
    pr = written(context_predictions(model, eval_pos, k))
    labelled = pr.select("chunk", F.col("t").alias("label"), "prediction", "m")
    m = (metrics(labelled) if metrics is not None
         else mt.classification_metrics(labelled, "label", "prediction", by=["chunk"], ignore_label=None, weight="m"))
    m = m.select("chunk", *[F.col(c).alias(f"eval_{c}") for c in m.columns if c != "chunk"])
    el = pr.groupBy("chunk").agg((F.sum(F.col("loss") * F.col("m")) / F.sum("m")).alias("eval_loss"))
    out = el.join(m, "chunk")
    return mt.round_all(out, [c for c in out.columns if c != "chunk"], EVAL_DIGITS)


def fit_base(logs: DataFrame, k: int = 10, scope: str = "all", test_size: float = 0.2, seed: int = 0) -> ContextModel:
    """Base fit on unlabelled logs (log_id, message), on the training part of a seeded split.
    scope='all' fits on every line of it; scope='last_chunk' cuts the lines into k contiguous chunks
    (the last takes the rest) and keeps only the last chunk's model, as a fresh model per
    chunk would.  test_size=0 fits on all lines."""
    if scope == "last_chunk":
        logs = chunk(logs, k, ["log_id"], "last").filter(F.col("chunk") == k).drop("chunk")
    elif scope != "all":
        raise ValueError(scope)
    if test_size > 0:
        logs = train_test_split(logs, "log_id", test_size, seed=seed).filter(~F.col("is_test"))
    return fit(positions(tokenize(logs.select("log_id", "message"))))
