"""Lexical translation model (IBM Model 1) trained by EM (PIP6b, JOI9, TOP1, PIP7).

Source sequences are ``<sos> tokens <eos>`` (``<sos>`` plays the NULL
word); target labels are ``tokens <eos>``.  A pair is collapsed to token
counts ``ce`` / ``cf`` and its *cells* are the (source type, target type)
combinations of that pair.

E-step (per pair, per target type f):   w(e) = ce * t(f|e),  Z = sum_e w(e)
                                        c(e, f) += cf * w(e) / Z
M-step:                                 t(f|e) = c(e, f) / sum_f c(e, f)

The uniform start needs no table: with t = 1 the first E-step gives the
same expectations as any constant start.  Training and scoring run over packed pairs parted by target type
(``lexical_parts``): a step shuffles only the totals by source type.  Where even those are too large to be sent to
all tasks, the cells are built as a table and joined (``build_cells``, ``em_step``).

Score of a pair (mirrors the per-pair loss of the selection loop):
    loss = mean over target labels f of
           -ln((1 - lam) * sum_i t(f|e_i) / l + lam / |V_trg|)
with l the source length including both specials.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import EOS, SOS
from corpusforge.operators import lexical_parts, lookup
from corpusforge.operators.joins import fits_broadcast
from corpusforge.session import materialize, stored

LAMBDA = 0.1
LOSS_DECIMALS = 6
# Largest number of cells of one sentence pair produced by a single join key.
CELLS_PER_SPLIT = 1_000_000
MAX_DECODE = 50
# Probabilities are compared at this many decimals when picking the best
# translation, so values that are equal up to float noise count as ties.
ARGMAX_DECIMALS = 12


@dataclass
class LexicalModel:
    made: DataFrame | None    # (e, f, t); None: the table of ``job``, which is made when it is first asked for
    n_target_types: int
    history: list = field(default_factory=list)  # (iteration, valid_loss)
    job: lexical_parts.Training | None = None

    @property
    def table(self) -> DataFrame:
        if self.made is None:
            self.made = materialize(self.job.table())
        return self.made


def source_sequence(tokens) -> "F.Column":
    return F.concat(F.array(F.lit(SOS)), tokens, F.array(F.lit(EOS)))


def target_labels(tokens) -> "F.Column":
    return F.concat(tokens, F.array(F.lit(EOS)))


def build_cells(pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str,
                cells_per_split: int = CELLS_PER_SPLIT) -> DataFrame:
    """Per-pair cells ``(key, e, f, ce, cf, l)``; both sides joined on the pair key.

    A very long pair would put its whole cross product into one task, so the
    join key carries a salt: a pair with ``|distinct src| * |distinct trg|``
    cells gets ``ceil(cells / cells_per_split)`` salts, source types are spread
    over them by hash and target types are repeated once per salt.  Every cell
    is produced exactly once.
    """
    base = pairs.select(*key_cols, source_sequence(F.col(src_col)).alias("_s"),
                        target_labels(F.col(trg_col)).alias("_t"))
    n_cells = F.size(F.array_distinct("_s")).cast("long") * F.size(F.array_distinct("_t")).cast("long")
    base = base.withColumn("_k", F.greatest(F.lit(1), F.ceil(n_cells / F.lit(cells_per_split))).cast("int"))
    s = (base.select(*key_cols, "_k", F.size("_s").alias("l"), F.explode("_s").alias("e"))
         .groupBy(*key_cols, "_k", "l", "e").agg(F.count(F.lit(1)).cast("double").alias("ce"))
         .withColumn("_salt", F.pmod(F.xxhash64("e"), F.col("_k")).cast("int")).drop("_k"))
    t = (base.select(*key_cols, "_k", F.explode("_t").alias("f"))
         .groupBy(*key_cols, "_k", "f").agg(F.count(F.lit(1)).cast("double").alias("cf"))
         .select(*key_cols, "f", "cf", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_salt")))
    return s.join(t, key_cols + ["_salt"]).drop("_salt")


def _join_table(cells: DataFrame, table: DataFrame) -> DataFrame:
    return cells.join(table, ["e", "f"], "left")


def em_step(cells: DataFrame, key_cols: list[str], table: DataFrame | None) -> DataFrame:
    """One EM iteration; ``table=None`` is the uniform start."""
    if table is None:
        w = cells.withColumn("w", F.col("ce"))
    else:
        w = _join_table(cells, table).withColumn("w", F.col("ce") * F.coalesce(F.col("t"), F.lit(0.0)))
    z = F.sum("w").over(Window.partitionBy(*key_cols, "f"))
    expected = w.withColumn("x", F.col("cf") * F.col("w") / z).filter(F.col("x") > 0)
    # counts feed both the numerator and the per-source totals: compute them once
    counts = materialize(expected.groupBy("e", "f").agg(F.sum("x").alias("c")))
    totals = counts.groupBy("e").agg(F.sum("c").alias("ct"))
    totals = F.broadcast(totals) if fits_broadcast(totals) else totals
    return counts.join(totals, "e").select("e", "f", (F.col("c") / F.col("ct")).alias("t"))


def score(model: LexicalModel, pairs: DataFrame, key_cols: list[str], src_col: str, trg_col: str,
          lam: float = LAMBDA) -> DataFrame:
    """Per-pair loss ``(key, n_tok, sum_nll, loss)``; a pair with no target tokens has the end mark."""
    if model.job is not None:
        found = model.job.losses(pairs, key_cols, src_col, trg_col, lam)
    else:
        found = lexical_parts.losses(model.table, model.n_target_types, pairs, key_cols, src_col, trg_col, lam)
    return found.withColumn("loss", F.round(F.col("sum_nll") / F.col("n_tok"), LOSS_DECIMALS))


def _steps(job: lexical_parts.Training, train: DataFrame, key_cols: list[str], src_col: str, trg_col: str, prune_below: float):
    """The model after each EM step, without end: in parts as long as ``job`` makes steps, then as a table."""
    while job.step():
        yield LexicalModel(None, job.lay.targets, job=job.now())
    table = materialize(job.table()) if job.history else None
    cells = materialize(build_cells(train, key_cols, src_col, trg_col))
    while True:  # from the last table on
        nxt = em_step(cells, key_cols, table)
        table = materialize(nxt.filter(F.col("t") >= prune_below) if prune_below > 0 else nxt)
        yield LexicalModel(table, job.lay.targets)


def fit(train: DataFrame, key_cols: list[str], src_col: str, trg_col: str, iterations: int = 2,
        valid: DataFrame | None = None, prune_below: float = 0.0,
        loss_of: Callable[[DataFrame], float | None] | None = None) -> LexicalModel:
    """EM for ``iterations`` steps.  With ``valid`` given, the iteration with the
    smallest validation loss is kept (strict ``<``: the first of ties wins, AGG7);
    without any validation pair, the last one.  The table is made when it is first asked for.  ``loss_of`` turns scored pairs into that loss, by
    default the token-weighted mean."""
    train = stored(train.select(*key_cols, src_col, trg_col), "train")  # counted, packed and perhaps joined: tokens are made once
    job = lexical_parts.training(train, key_cols, src_col, trg_col, prune_below)
    steps = _steps(job, train, key_cols, src_col, trg_col, prune_below)
    best, best_loss, history = None, float("inf"), []
    last = LexicalModel(None, job.lay.targets)
    for it in range(1, iterations + 1):
        last = next(steps)
        if valid is None:
            continue
        scored = score(last, valid, key_cols, src_col, trg_col)
        r = scored.agg((F.sum("sum_nll") / F.sum("n_tok")).alias("l")).first()["l"] if loss_of is None else loss_of(scored)
        history.append((it, r))
        if r is not None and r < best_loss:
            best_loss, best = r, last
    steps.close()
    return replace(last if best is None else best, history=history)


def best_translation(model: LexicalModel, exclude: tuple[str, ...] = (EOS,)) -> DataFrame:
    """TOP1: per source type the most probable target type; ties -> smallest token.

    ``min_by`` over ``(-t, f)`` sorts its rows.  A model that was trained in parts hands on only what leads in a part, so neither the whole
    table nor the rows of a hot source type (``<sos>``, punctuation) are written, moved or sorted.
    """
    if model.job is None:
        t = model.table.filter(~F.col("f").isin(list(exclude)))
    else:  # what rounds to the largest value is less than two units of the last decimal from it
        t = model.job.leading(exclude, 2 * 10.0 ** -ARGMAX_DECIMALS).repartition("e")
    order = F.struct((-F.round("t", ARGMAX_DECIMALS)).alias("nt"), F.col("f"))
    return t.groupBy("e").agg(F.min_by("f", order).alias("best"))


def shared_translations(model_best: DataFrame) -> lookup.SharedTable:
    """The best-translation table, measured once for any number of ``translate`` calls."""
    return lookup.share(model_best, "e", "best")


def translate(model_best: DataFrame | lookup.SharedTable, sentences: DataFrame, key_cols: list[str], tokens_col: str,
              max_len: int | None = None) -> DataFrame:
    """PIP7: word-by-word arg-max translation; unknown tokens are copied through.

    Output ``(key, hyp)`` in source order, one target word per source word,
    over the whole text.  ``max_len`` re-imposes the neural decoder's step
    limit (``MAX_DECODE`` = 50) when a caller wants it; a word-by-word
    translator has no reason to stop early, so it is off by default.
    """
    best = model_best if isinstance(model_best, lookup.SharedTable) else shared_translations(model_best)
    rows = sentences.select(*key_cols, F.col(tokens_col).alias("_toks"))
    out = lookup.map_arrays(rows, "_toks", best, "hyp", keep=True, key_cols=key_cols)
    hyp = F.col("hyp") if max_len is None else F.slice("hyp", 1, max_len)
    return out.select(*key_cols, hyp.alias("hyp"))
