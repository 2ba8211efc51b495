"""A masked-token model fitted by distributed counting.

The model answers "how likely is token t between left neighbour l and right
neighbour r": it is the table of context counts c(l,t,r) over all positions of the
sequences `[CLS] tokens... [SEP]` (the outer neighbours are `[PAD]`).  Every other
count is a marginal of it.  Probability (weights w, smoothing alpha):

  p(t|l,r) = w0 c(l,t,r)/c(l,.,r) + w1 c(l,t)/c(l,.) + w2 c(t,r)/c(.,r)
             + w3 (c(t)+alpha)/(N + alpha (V+1))

a term with a zero denominator counts 0; N = total positions, V = distinct tokens.
The loss of a position is -ln p, rounded to 6 places so that ranks and flags do not
depend on summation order.  Fitting is one aggregation (map-side partial counts);
fitting in chunks is a running sum of per-chunk counts.  A model scores its own contexts by three
exchanges of them (`own_marginals`); other contexts look the marginals up (joins.frequency_split_join).
The weights can be fitted on held-out contexts (`fit_weights`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsieve.operators.joins import LEAST_ROWS, apart_join, frequency_split_join, heavy_keys, key_hash
from logsieve.operators.tokens import MAX_LENGTH, PAD, SPECIAL_TOKENS, token_sequence
from logsieve.session import written

# Default mixture weights and smoothing.
DEFAULT_WEIGHTS = (0.4, 0.2, 0.2, 0.2)
DEFAULT_ALPHA = 0.1
LOSS_DIGITS = 6
# Marginals of c(l,t,r) that the mixture needs: name -> keys.
MARGINALS = {"n_lr": ["l", "r"], "n_lt": ["l", "t"], "n_tr": ["t", "r"], "n_l": ["l"], "n_r": ["r"], "n_t": ["t"]}


@dataclass
class ContextModel:
    """Context counts `(by..., l, t, r, n)`; `by` is e.g. ["chunk"] for a model per chunk.
    `tables` holds marginals that are already summed (of a stored model)."""
    counts: DataFrame
    by: tuple = ()
    weights: tuple = DEFAULT_WEIGHTS
    alpha: float = DEFAULT_ALPHA
    tables: dict = field(default_factory=dict)

    def marginal(self, name: str) -> DataFrame:
        """(by..., keys, <name>, rows): the sum of n per key, and its number of contexts."""
        if name not in self.tables:
            return self.counts.groupBy(*self.by, *MARGINALS[name]).agg(
                F.sum("n").alias(name), F.count(F.lit(1)).alias("rows"))
        return self.tables[name]

    def totals(self) -> DataFrame:
        """(by..., _N positions, _V distinct tokens): one row per model."""
        if "totals" not in self.tables:
            return self.counts.groupBy(*self.by).agg(F.sum("n").alias("_N"), F.countDistinct("t").alias("_V"))
        return self.tables["totals"]

    def summed(self) -> "ContextModel":
        """The same model with its marginals written once, for scoring many batches."""
        tables = {name: written(self.marginal(name)) for name in MARGINALS} | {"totals": written(self.totals())}
        return ContextModel(self.counts, self.by, self.weights, self.alpha, tables)


def positions(df: DataFrame, id_col: str = "log_id", tokens_col: str = "tokens",
              max_length: int = MAX_LENGTH, keep: tuple = (), with_len: bool = False) -> DataFrame:
    """One row per sequence position: (id, pos 1..L, l, t, r).  Built in-row with array
    shifts and one `inline` (no lambdas, no window)."""
    seq = token_sequence(F.col(tokens_col), max_length)
    base = df.select(id_col, *keep, seq.alias("_seq"))
    n = F.size("_seq")
    arrays = base.select(
        id_col, *keep,
        F.sequence(F.lit(1), n).alias("pos"),
        F.concat(F.array(F.lit(PAD)), F.slice("_seq", 1, n - 1)).alias("l"),
        F.col("_seq").alias("t"),
        F.concat(F.slice("_seq", 2, n - 1), F.array(F.lit(PAD))).alias("r"),
    )
    if with_len:
        arrays = arrays.withColumn("seq_len", F.size("t"))
        keep = (*keep, "seq_len")
    # outer (a sequence is never empty): for a plain inline the optimizer adds a filter on the
    # arrays, which would tokenize once more
    return arrays.select(id_col, *keep, F.inline_outer(F.arrays_zip("pos", "l", "t", "r")))


def fit(pos: DataFrame, by: tuple = (), weights=DEFAULT_WEIGHTS, alpha=DEFAULT_ALPHA,
        times: str | None = None) -> ContextModel:
    """Count contexts (partial counts per partition, then one shuffle of the partials);
    `times` is a column with the number of sequences that a position stands for."""
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    # the counts are read by every marginal and by the scoring: one written table
    counts = written(pos.groupBy(*by, "l", "t", "r").agg(n.cast("long").alias("n")))
    return ContextModel(counts, tuple(by), tuple(weights), alpha)


def fit_chunks(base: ContextModel | None, chunk_pos: DataFrame, k: int,
               chunk_col: str = "chunk") -> ContextModel:
    """Continued fitting over chunks 1..k: the model after chunk i = base + chunks 1..i.
    Each count row is replicated to the chunks at and after its own (k/2 copies on
    average), then summed per (chunk, context) -- one job for all chunks."""
    per_chunk = chunk_pos.groupBy(chunk_col, "l", "t", "r").agg(F.count(F.lit(1)).alias("n"))
    if base is not None:
        per_chunk = per_chunk.unionByName(base.counts.select(F.lit(0).alias(chunk_col), "l", "t", "r", "n"))
    spread = per_chunk.select(
        F.explode(F.sequence(F.greatest(F.col(chunk_col), F.lit(1)), F.lit(k))).alias(chunk_col),
        "l", "t", "r", "n")
    counts = spread.groupBy(chunk_col, "l", "t", "r").agg(F.sum("n").alias("n"))
    w = base.weights if base is not None else DEFAULT_WEIGHTS
    a = base.alpha if base is not None else DEFAULT_ALPHA
    return ContextModel(counts, (chunk_col,), w, a)


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def round_loss(x: Column) -> Column:
    """Round to LOSS_DIGITS through a 9-place decimal: a last-bit difference of `ln`
    between engines is absorbed before the half-up rounding at 6 places."""
    return F.round(x.cast("decimal(20,9)"), LOSS_DIGITS).cast("double")


def _attach_totals(df: DataFrame, model: ContextModel) -> DataFrame:
    g = model.totals()          # one row per model (per chunk): bounded
    by = list(model.by)
    return df.crossJoin(F.broadcast(g)) if not by else df.join(F.broadcast(g), by, "left")


# The lookups by their first key: one exchange each gives the sums of the key and of the pair.
EXCHANGES = (("l", "t", "r", "n_l", "n_lt"), ("r", "l", "t", "n_r", "n_lr"), ("t", "r", "l", "n_t", "n_tr"))


def own_marginals(counts: DataFrame, by: tuple = (), least_rows: int = LEAST_ROWS) -> DataFrame:
    """(by..., l, t, r, n) with all marginals of MARGINALS, summed beside the rows.

    Three exchanges: by l (sums of l and of l,t), by r (r and l,r) and by t (t and t,r).  Keys that
    hold a large share of the rows are found by sketches first; their sums are few and are
    broadcast, and their rows are dealt by a second key too (and by all three where a pair is heavy), so
    that no exchange brings more rows of a key into a task than a light key has.  `counts` is a written table."""
    by = list(by)
    sets = {name: [*by, *keys] for name, keys in MARGINALS.items()}
    heavy = heavy_keys(counts, sets, least_rows)
    sums = None
    if heavy:
        # exact sums of the heavy keys, in one pass: every row is offered under the keys that it has
        kinds = [F.struct(F.lit(name).alias("_kind"), *[(F.col(c) if c in MARGINALS[name] else F.lit(None).cast("string")).alias(f"_{c}")
                                                        for c in "ltr"], key_hash(sets[name]).alias("_heavy")) for name in heavy]
        named = None
        for name, keys in heavy.items():
            part = keys.withColumn("_kind", F.lit(name))
            named = part if named is None else named.unionByName(part)
        sums = written(counts.select(*by, "n", F.inline(F.array(*kinds))).join(F.broadcast(named), ["_kind", "_heavy"])
                       .groupBy(*by, "_kind", "_l", "_t", "_r").agg(F.sum("n").alias("_sum")))

    def with_heavy(df: DataFrame, name: str) -> DataFrame:
        if name not in heavy:
            return df.withColumn(f"_{name}", F.lit(None).cast("long"))
        keys = MARGINALS[name]
        few = sums.filter(F.col("_kind") == name).select(*by, *[F.col(f"_{c}").alias(c) for c in keys],
                                                         F.col("_sum").alias(f"_{name}"))
        return df.join(F.broadcast(few), [*by, *keys], "left")      # at most HEAVY_KEYS and hash collisions

    out = counts
    for x, y, z, one, pair in EXCHANGES:
        out = with_heavy(with_heavy(out, one), pair)
        is_heavy = F.col(f"_{one}").isNotNull()
        # further keys only where some key is heavy: dealt by a constant too, the rows would be exchanged again for the windows
        dealt_by = [*by, x]
        if one in heavy:
            out, dealt_by = out.withColumn("_a", F.when(is_heavy, F.col(y))), [*dealt_by, "_a"]
        if one in heavy and pair in heavy:
            out = out.withColumn("_b", F.when(is_heavy & F.col(f"_{pair}").isNotNull(), F.col(z)))
            dealt_by = [*dealt_by, "_b"]
        out = out.repartition(*dealt_by)
        inner, outer = Window.partitionBy(*dealt_by, y), Window.partitionBy(*dealt_by)
        out = (out.withColumn(pair, F.coalesce(f"_{pair}", F.sum("n").over(inner)))
               .withColumn(one, F.coalesce(f"_{one}", F.sum("n").over(outer)))
               .drop("_a", "_b", f"_{one}", f"_{pair}"))
    return out


def summed_together(model: ContextModel, contexts: DataFrame) -> DataFrame:
    """`looked_up` for a model without summed tables: its counts and the contexts (which count 0) are put
    together, so the marginals are summed beside the contexts by the three exchanges of `own_marginals`.  A marginal
    that the model has not is 0, like its estimate."""
    zero = F.lit(0).cast("long")
    both = (model.counts.select("l", "t", "r", "n", zero.alias("m"))
            .unionByName(contexts.select("l", "t", "r", zero.alias("n"), F.col("m").cast("long"))))
    counts = written(both.groupBy("l", "t", "r").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    return own_marginals(counts).filter("m > 0").withColumnRenamed("n", "n3")


def looked_up(model: ContextModel, contexts: DataFrame, max_hot: int = 50_000, sketched: bool = True) -> DataFrame:
    """`contexts` (by..., l, t, r, m: distinct) with n3 and all marginals, null where the model has none.
    With `sketched`, keys that hold a large share of the contexts are found first, so that a token
    that the model never saw is dealt evenly too; `contexts` should then be a written table."""
    by = list(model.by)
    if sketched and not by and not model.tables:
        return summed_together(model, contexts)
    own = model.counts.select(*by, "l", "t", "r", F.col("n").alias("n3"))
    q = contexts.select(*by, "l", "t", "r", "m")
    heavy = heavy_keys(q, {name: [*by, *keys] for name, keys in MARGINALS.items()}) if sketched else {}
    q = q.join(own, [*by, "l", "t", "r"], "left")
    for name, keys in MARGINALS.items():
        q = frequency_split_join(q, model.marginal(name), [*by, *keys], "rows", "left", max_hot, heavy.get(name))
    return q


def loss_of(model: ContextModel, pos: DataFrame, own: DataFrame | None = None, max_hot: int = 50_000) -> DataFrame:
    """`pos` (a table or a stream, with l, t, r) with the loss of every row, by joins with the model's tables
    alone: nothing of `pos` is written or aggregated on the way.

    `own` is the written loss table of the model's own contexts.  Rows with one of its frequent contexts (at most `max_hot`, broadcast)
    stay where they are, the other contexts of the model cost one exchange, and only rows with a context that the
    model never saw look its marginals up."""
    if model.by:
        raise ValueError("one model at a time")
    keys = ["l", "t", "r"]
    own = written(loss_table(model)) if own is None else own
    seen = apart_join(pos, own, keys, "m", max_hot)
    total = own.agg(F.sum("m")).scalar()
    hot, cold = own.filter(F.col("m") * F.lit(max_hot) >= total), own.filter(F.col("m") * F.lit(max_hot) < total)
    q = (pos.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.select(*keys), keys, "left_anti")
         .withColumn("n3", F.lit(0).cast("long")))
    for name, part in MARGINALS.items():
        q = frequency_split_join(q, model.marginal(name), part, "rows", "left", max_hot)
    parts = _estimates(_attach_totals(q, model), model.alpha, pos.columns)
    unseen = parts.select(*pos.columns, round_loss(-F.log(mixture(model.weights))).alias("loss"))
    return seen.select(*unseen.columns).unionByName(unseen)


def _estimates(q: DataFrame, alpha: float, keep: list) -> DataFrame:
    a = F.lit(alpha)
    smooth = (F.coalesce(F.col("n_t"), F.lit(0)) + a) / (F.col("_N") + a * (F.col("_V") + F.lit(1)))
    return q.select(*keep, _ratio(F.col("n3"), F.col("n_lr")).alias("p1"),
                    _ratio(F.col("n_lt"), F.col("n_l")).alias("p2"), _ratio(F.col("n_tr"), F.col("n_r")).alias("p3"),
                    smooth.alias("p4"))


def components(model: ContextModel, contexts: DataFrame | None = None, max_hot: int = 50_000,
               sketched: bool = True) -> DataFrame:
    """(by..., l, t, r, m, p1..p4): the four estimates that the mixture weighs, for the model's own
    contexts or for others."""
    by = list(model.by)
    if contexts is None:
        q = own_marginals(model.counts, model.by).withColumn("n3", F.col("n")).withColumn("m", F.col("n"))
    else:
        q = looked_up(model, contexts, max_hot, sketched)
    return _estimates(_attach_totals(q, model), model.alpha, [*by, "l", "t", "r", "m"])


def mixture(weights) -> Column:
    """The weighted sum of p1..p4; `weights` are numbers or columns."""
    w = [x if isinstance(x, Column) else F.lit(x) for x in weights]
    return w[0] * F.col("p1") + w[1] * F.col("p2") + w[2] * F.col("p3") + w[3] * F.col("p4")


def loss_table(model: ContextModel, queries: DataFrame | None = None, max_hot: int = 50_000,
               sketched: bool = True) -> DataFrame:
    """Loss for distinct contexts `(by..., l, t, r, m)` -> adds `loss`.  Without `queries` the contexts
    are the model's own (scoring the fitted corpus)."""
    parts = components(model, queries, max_hot, sketched)
    return parts.select(*model.by, "l", "t", "r", "m", round_loss(-F.log(mixture(model.weights))).alias("loss"))


#: Rounds of the weights' fit, and the places that its numbers are rounded to, so that they do not
#: depend on summation order.
WEIGHT_ROUNDS, WEIGHT_DIGITS = 8, 9


def fit_weights(model: ContextModel, held_out: DataFrame, rounds: int = WEIGHT_ROUNDS,
                start=DEFAULT_WEIGHTS, max_hot: int = 50_000) -> DataFrame:
    """Mixture weights by expectation-maximisation on held-out contexts (l, t, r, m; not those that the model
    was fitted on, else the exact context takes all the weight): (round, w1..w4, loss), round 0
    being `start`.  `loss` is the mean held-out loss under the row's weights, which no round raises.

    The estimates of all contexts are written once; a round is one aggregate over them, and the state between
    rounds a one-row table.  No held-out contexts leave the weights as they are, with a null loss."""
    if model.by:
        raise ValueError("weights are fitted for one model at a time")
    parts = written(components(model, held_out, max_hot))
    names = ["w1", "w2", "w3", "w4"]
    state = held_out.sparkSession.range(1).select(*[F.lit(float(w)).alias(n) for n, w in zip(names, start, strict=True)])
    out = None
    mixed = mixture([F.col(n) for n in names])
    for i in range(rounds + 1):
        each = parts.crossJoin(F.broadcast(state)).withColumn("_mix", mixed)
        total = F.sum("m")
        share = [F.coalesce(F.round(F.sum(F.col("m") * F.col(n) * F.col(f"p{k}") / F.col("_mix")) / total, WEIGHT_DIGITS),
                            F.max(n)).alias(f"_{n}") for k, n in enumerate(names, 1)]
        # the state joined in from the left: it stays when there are no contexts
        found = written(state.crossJoin(each.agg((F.sum(F.col("m") * -F.log("_mix")) / total).alias("loss"), *share)))
        row = found.select(F.lit(i).alias("round"), *names, F.round("loss", WEIGHT_DIGITS).alias("loss"))
        out = row if out is None else out.unionByName(row)
        state = found.select(*[F.coalesce(f"_{n}", n).alias(n) for n in names])
    return out


#: Share that every estimate keeps: a fitted smoothing weight of zero would make unseen tokens impossible.
LEAST_WEIGHT = 0.001


def with_weights(model: ContextModel, fitted: DataFrame, digits: int = 6, least: float = LEAST_WEIGHT) -> ContextModel:
    """The model under the weights of the last round of `fit_weights` (one row goes to the driver), drawn a little
    towards equal ones so that none is below `least`."""
    row = fitted.orderBy(F.desc("round")).first()
    weights = tuple(round(least + (1 - 4 * least) * row[f"w{k}"], digits) for k in range(1, 5))
    return ContextModel(model.counts, model.by, weights, model.alpha, model.tables)


def token_losses(pos: DataFrame, model: ContextModel | None = None, max_hot: int = 50_000,
                 times: str | None = None, keep=written, counted: DataFrame | None = None) -> DataFrame:
    """Loss of every position.  Without a model, the positions themselves are the fit
    corpus.  `keep` stores the distinct contexts and the loss table (one row per distinct context), which
    several joins read; without storing (in a micro-batch) heavy keys are not looked for, and the positions are read once.
    `counted` is the same positions, with `times`, for the counting, where those to be scored come from an exchange."""
    by = list(model.by) if model is not None else []
    counted = pos if counted is None else counted
    if model is None:
        table = loss_table(fit(counted, times=times), max_hot=max_hot)
    else:
        n = F.count(F.lit(1)) if times is None else F.sum(times)
        contexts = keep(counted.groupBy(*by, "l", "t", "r").agg(n.alias("m")))
        table = loss_table(model, contexts, max_hot, sketched=keep is written)
    table, keys = keep(table.select(*by, "l", "t", "r", "m", "loss")), [*by, "l", "t", "r"]
    if keep is written:
        return apart_join(pos, table, keys, "m", max_hot)      # most positions have a frequent context and stay
    return frequency_split_join(pos, table, keys, "m", max_hot=max_hot)


def score(losses: DataFrame, id_col: str = "log_id", max_length: int = MAX_LENGTH,
          denominator: str = "max_length", top_k: int = 3) -> DataFrame:
    """Per sequence: anomaly_score = sum of losses / max_length (padding adds 0) or /
    number of positions, and the top_k highest-loss tokens (loss desc, position desc)
    with special tokens removed afterwards.  One aggregate by id."""
    # exact decimal sum and division, then one half-up rounding: the result does not
    # depend on summation order or on how an engine breaks ties of binary doubles
    den = F.lit(max_length) if denominator == "max_length" else F.count(F.lit(1))
    den = den.cast("decimal(10,0)")
    total = F.sum(F.col("loss").cast("decimal(18,6)"))
    # a group holds at most max_length positions
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("loss")).alias("a"), (-F.col("pos")).alias("b"), "t")))
    agg = losses.groupBy(id_col).agg(F.round(total / den, LOSS_DIGITS).cast("double").alias("anomaly_score"),
                                     F.slice(ranked, 1, top_k).getField("t").alias("_top"))
    kept = F.filter("_top", lambda t: ~t.isin(*SPECIAL_TOKENS))
    return agg.select(id_col, "anomaly_score", kept.alias("top_tokens"))


def units_of(loss: Column) -> Column:
    """A loss of at most LOSS_DIGITS places as a whole number of units of the last one."""
    return F.round(loss * F.lit(10 ** LOSS_DIGITS)).cast("long")


def mean_of_units(units: Column, den: Column) -> Column:
    """A sum of `units_of` by `den`, divided in exact decimal and rounded once, as in `score`."""
    total = units.cast("decimal(22,0)") / F.lit(10 ** LOSS_DIGITS).cast("decimal(10,0)")
    return F.round(total.cast("decimal(28,6)") / den.cast("decimal(10,0)"), LOSS_DIGITS).cast("double")


#: Bits of a packed place that hold the position.
PLACE_BITS = 20


def score_rounded(losses: DataFrame, id_col: str = "log_id", max_length: int = MAX_LENGTH,
                  denominator: str = "max_length", top_k: int = 3) -> DataFrame:
    """`score` for losses of at most LOSS_DIGITS places (the count model's): (id, anomaly_score, _top), where `_top` are
    the positions of the top_k tokens.  A position travels as one number, its loss in units of the last place
    and below it its place (under 2**PLACE_BITS), so that sums are whole numbers and numbers sort as `score` ranks;
    the tokens are read off the sequence by `tokens_at`."""
    if max_length >= 1 << PLACE_BITS:
        raise ValueError(f"sequences of less than {1 << PLACE_BITS} positions")
    packed = losses.select(id_col, (units_of(F.col("loss")) * F.lit(1 << PLACE_BITS) + F.col("pos")).alias("_place"))
    den = F.lit(max_length) if denominator == "max_length" else F.count(F.lit(1))
    agg = packed.groupBy(id_col).agg(mean_of_units(F.sum(F.shiftright("_place", PLACE_BITS)), den).alias("anomaly_score"),
                                     F.slice(F.sort_array(F.collect_list("_place"), asc=False), 1, top_k).alias("_best"))
    place = F.transform("_best", lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    return agg.select(id_col, "anomaly_score", place.alias("_top"))


def tokens_at(tokens: Column, places: Column, max_length: int = MAX_LENGTH) -> Column:
    """The tokens at these positions of the sequence, without special tokens."""
    found = F.transform(F.arrays_zip(places.alias("p"), F.array_repeat(token_sequence(tokens, max_length), F.size(places)).alias("s")),
                        lambda x: F.element_at(x["s"], x["p"]))
    return F.filter(found, lambda t: ~t.isin(*SPECIAL_TOKENS))


def best_tokens(model: ContextModel) -> dict:
    """Most likely token per context for back-off prediction: by (l,r), by l, by r and
    overall; ties broken by the smaller token.  (keys..., p_<name>, rows)."""
    by = list(model.by)
    pick = F.min_by(F.col("t"), F.struct((-F.col("n")).alias("k"), F.col("t").alias("s")))

    def best(keys, name):
        return (model.counts.groupBy(*by, *keys, "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
                .groupBy(*by, *keys).agg(pick.alias(name), F.sum("c").alias("rows")))

    return {"lr": best(["l", "r"], "p_lr"), "l": best(["l"], "p_l"),
            "r": best(["r"], "p_r"), "all": best([], "p_all").drop("rows")}


def predict(contexts: DataFrame, model: ContextModel, max_hot: int = 50_000) -> DataFrame:
    """Prediction for distinct contexts `(by..., l, r, ...)`: back-off (l,r) -> l -> r -> overall."""
    by = list(model.by)
    b = best_tokens(model)
    out = contexts
    for name, keys in (("lr", ["l", "r"]), ("l", ["l"]), ("r", ["r"])):
        out = frequency_split_join(out, b[name], [*by, *keys], "rows", "left", max_hot)
    out = out.crossJoin(F.broadcast(b["all"])) if not by else out.join(F.broadcast(b["all"]), by, "left")
    return (out.withColumn("prediction", F.coalesce("p_lr", "p_l", "p_r", "p_all"))
            .drop("p_lr", "p_l", "p_r", "p_all"))


def best_chunk(metrics: DataFrame, chunk_col: str = "chunk", loss_col: str = "eval_loss") -> DataFrame:
    """The chunk with the lowest evaluation loss (first chunk on ties)."""
    return metrics.agg(F.min_by(F.col(chunk_col), F.struct(F.col(loss_col), F.col(chunk_col))).alias("best_chunk"),
                       F.min(loss_col).alias("best_eval_loss"))
