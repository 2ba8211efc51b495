"""A low-rank token model: a scorer with parameters that generalise over neighbours, fitted by Spark and run in
Arrow batches through `scorers.score_with`.

Context counts become a sparse matrix of neighbours (left and right ones apart) by tokens, scaled to
a = n / sqrt(row sum * column sum).  Its leading right singular vectors are found by subspace iteration: a
round multiplies the matrix and its transpose with a thin matrix (two joins with a broadcast table and two
aggregates) and orthonormalises by the Cholesky factor of a rank-by-rank Gram matrix.  The vocabulary is bounded
(`max_size`; other words share [UNK]), so the factors are too, whatever the size of the corpus, and they are
what the driver ships to the workers.

    p(t | l, r) = 0.45 q(t | left l) + 0.45 q(t | right r) + 0.1 (s_t + 1) / (S + V)

where q is the clipped low-rank estimate of the conditional, normalised over the vocabulary; loss = -ln p.
Defined results: padding has loss 0; no counts give the smoothed uniform distribution."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.functions.hashing import h01
from logsieve.operators.scorers import score_with
from logsieve.operators.tokens import MAX_LENGTH, PAD_ID, SPECIAL_TOKENS, UNK_ID, build_vocab
from logsieve.session import written

RANK, ROUNDS, VOCAB = 8, 4, 4096
#: Shares of the left, the right and the smoothed estimate.
SHARES = (0.45, 0.45, 0.1)


@dataclass
class LowRank:
    """`token` (V, rank) and `context` (2 V, rank) factors, column and row sums; `vocab` is the bounded token table."""
    token: np.ndarray
    context: np.ndarray
    token_sum: np.ndarray
    context_sum: np.ndarray
    vocab: DataFrame


def _dense(rows: list, size: int, names: list[str], key: str) -> np.ndarray:
    out = np.zeros((size, len(names)))
    for r in rows:
        out[r[key]] = [r[n] for n in names]
    return out


def fit_low_rank(counts: DataFrame, rank: int = RANK, rounds: int = ROUNDS, max_size: int = VOCAB, seed: int = 0) -> LowRank:
    """`counts` has l, t, r, n (a model's context counts)."""
    spark = counts.sparkSession
    seen = counts.groupBy("t").agg(F.sum("n").alias("n"))
    table = seen.filter(~F.col("t").isin(*SPECIAL_TOKENS)).select(F.array("t").alias("tokens"), "n")
    vocab = written(build_vocab(table, "tokens", max_size=max_size, times="n"))
    size = max_size
    known = F.broadcast(vocab.select("token", "token_id"))             # at most max_size rows

    def numbered(df: DataFrame, c: str) -> DataFrame:
        named = known.select(F.col("token").alias(c), F.col("token_id").alias(f"_{c}"))
        return df.join(named, c, "left").withColumn(c, F.coalesce(f"_{c}", F.lit(UNK_ID))).drop(f"_{c}")

    ids = numbered(numbered(numbered(counts.select("l", "t", "r", "n"), "l"), "t"), "r")
    sides = ids.select("t", "n", F.explode(F.array(F.col("l"), F.col("r") + size)).alias("c"))
    cells = written(sides.groupBy("c", "t").agg(F.sum("n").cast("double").alias("n")))
    rows, cols = (written(cells.groupBy(k).agg(F.sum("n").alias(f"s_{k}"))) for k in "ct")
    entries = written(cells.join(F.broadcast(rows), "c").join(F.broadcast(cols), "t")
                      .select("c", "t", (F.col("n") / F.sqrt(F.col("s_c") * F.col("s_t"))).alias("a")))
    x = [f"x{k}" for k in range(rank)]
    basis = cols.select("t", *[(h01(seed, F.col("t"), F.lit(k)) - 0.5).alias(n) for k, n in enumerate(x)])

    def times_matrix(thin: DataFrame, given: str, out: str) -> DataFrame:
        return (entries.join(F.broadcast(thin), given).groupBy(out)
                .agg(*[F.sum(F.col("a") * F.col(n)).alias(n) for n in x]))

    def orthonormal(thin: DataFrame) -> DataFrame:
        pairs = [(i, j) for i in range(rank) for j in range(i + 1)]
        gram = thin.agg(*[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
        g = np.zeros((rank, rank))
        for i, j in pairs:
            g[i, j] = g[j, i] = gram[f"g{i}_{j}"] or 0.0
        # directions beyond the matrix' own rank are left out instead of divided by nearly nothing
        values, vectors = np.linalg.eigh(g)
        fit = values > max(values.max(), 1e-300) * 1e-12
        turn = vectors * np.where(fit, 1 / np.sqrt(np.where(fit, values, 1)), 0)
        return thin.select("t", *[sum((F.col(n) * F.lit(float(turn[i, k])) for i, n in enumerate(x)), F.lit(0.0)).alias(x[k])
                                  for k in range(rank)])

    basis = written(orthonormal(basis))
    for _ in range(rounds):
        basis = written(orthonormal(written(times_matrix(written(times_matrix(basis, "t", "c")), "c", "t"))))
    context = times_matrix(basis, "t", "c")
    return LowRank(_dense(basis.collect(), size, x, "t"), _dense(context.collect(), 2 * size, x, "c"),
                   _dense(cols.collect(), size, ["s_t"], "t")[:, 0], _dense(rows.collect(), 2 * size, ["s_c"], "c")[:, 0], vocab)


def token_loss_fn(model: LowRank, pad: int = PAD_ID):
    """For score_with(per_token=True): builds, once per worker, a function from ids (batch, length) to losses."""
    token, context, token_sum, context_sum = model.token, model.context, model.token_sum, model.context_sum
    shares = SHARES

    def make():
        import numpy as np
        size = len(token_sum)
        scale = np.sqrt(token_sum)

        def estimate(c, t):
            return np.maximum((context[c] * token[t]).sum(axis=-1), 0) * scale[t]

        whole = np.zeros(2 * size)
        for a in range(0, 2 * size, 1024):
            whole[a:a + 1024] = np.maximum(context[a:a + 1024] @ token.T, 0) @ scale
        whole = np.where(whole > 0, whole, np.inf)               # a neighbour never seen has no estimate
        smooth = (token_sum + 1) / (token_sum.sum() + size)

        def predict(x):
            ids = np.asarray(x).astype(np.int64)
            edge = np.full((len(ids), 1), pad)
            left = np.concatenate([edge, ids[:, :-1]], axis=1)
            right = np.concatenate([ids[:, 1:], edge], axis=1) + size
            p = shares[0] * estimate(left, ids) / whole[left] + shares[1] * estimate(right, ids) / whole[right]
            return np.where(ids == pad, 0.0, -np.log(p + shares[2] * smooth[ids]))

        return predict

    return make


def low_rank_losses(model: LowRank, id_col: str = "_mid", max_length: int = MAX_LENGTH, batch_size: int = 256):
    """For `plans.detect.detect(losses=...)`: positions (id, pos, l, t, r) -> the same with a loss, scored sequence by
    sequence (at most `max_length` positions)."""
    make = token_loss_fn(model)

    def losses(pos: DataFrame) -> DataFrame:
        known = F.broadcast(model.vocab.select(F.col("token").alias("t"), "token_id"))
        rest = [c for c in pos.columns if c != id_col]
        item = F.struct(*rest, F.coalesce("token_id", F.lit(UNK_ID)).alias("_id"))
        seq = (pos.join(known, "t", "left").groupBy(id_col).agg(F.sort_array(F.collect_list(
            F.struct("pos", item.alias("item")))).getField("item").alias("_items")))
        ids = F.col("_items").getField("_id")
        padded = F.concat(ids, F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - F.size(ids)))
        scored = score_with(seq.withColumn("_ids", padded), make, "_ids", "_losses", batch_size, per_token=True, max_length=max_length)
        both = scored.select(id_col, F.inline(F.arrays_zip(F.col("_items").alias("item"),
                                                          F.slice("_losses", F.lit(1), F.size("_items")).alias("loss"))))
        return both.select(id_col, *[F.col("item").getField(c).alias(c) for c in rest], F.round("loss", 6).alias("loss"))

    return losses
