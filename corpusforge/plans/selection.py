"""Self-learning data selection (PIP1) and its random-pick baseline (PIP2).

Before round 0 the rows of the test set leave both tables (JOI2).  Round i:
  split the trusted pool (SMP1, seed and round in the hash) -> fit the
  model on the train split, of several iterations the one with the smallest validation loss (AGG7) ->
  validation and test loss, each the mean over length batches of the batches' token-weighted means (AGG6) -> candidate window of
  500 * 2**i + 1 rows in file order (WIN2) -> per-row loss (AGG5) -> exact
  0.25 quantile (AGG4) -> accept ``loss <= quantile`` (FLT4), or a seeded
  random quarter for the baseline (SMP3/SMP4) -> pool += accepted (SET1) ->
  candidates -= accepted (JOI3) -> one statistics row (SNK4).

Candidates are consumed in file order, so their keys are ranked once: the rows
left in a round are the rejected rows of the window before and the ranks not reached
yet.  The candidate table is neither rewritten nor anti-joined, and the pool is the
trusted table plus the accepted rows of all rounds.  Each round writes its split, window losses, new window rows, accepted and
rejected rows as parquet below the run folder, which cuts the lineage and lets a
lost executor recompute at most one round.  The pool is never written again: a split is a comparison of row hashes with a
cut, so the trusted and the accepted rows are read where they are: one pass per round takes out the validation rows.  A model of counts is not
refitted on the pool; it has the counts of the pool before and of the rows accepted since, without those of the validation rows.  Driver traffic per
round: a handful of scalars.
"""

from __future__ import annotations

import math
import os
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.text import tokenize_nds
from corpusforge.operators import bleu, lexical, lm
from corpusforge.operators.batching import BATCH_SIZE, length_batches
from corpusforge.operators.joins import join_small
from corpusforge.operators.leakage import remove_leaks
from corpusforge.operators.ordering import dense_index, exact_quantile
from corpusforge.operators.sampling import (ACCEPT_SHARE, SEED, VALID_SHARE, accept_count, candidate_window,
                                            sample_n, train_valid_split, window_size)
from corpusforge.operators.udf import add_tokens
from corpusforge.session import discard, materialize, scratch_path, stored

KEY = ["source", "pair_id"]

ROUND_STATS_SCHEMA = (
    "run_id string, round int, best_valid_loss double, epoch_mins int, epoch_secs int, "
    "test_loss double, residual_loss double, residual_mins int, residual_secs int, "
    "quantile double, test_bleu double, total_samples long, n_window long, n_accepted long"
)
_STATS_COLS = [c.split()[0] for c in ROUND_STATS_SCHEMA.split(",")]


def total_samples(n_train: int, n_valid: int, batch_size: int = BATCH_SIZE) -> int:
    """AGG3: both splits rounded up to whole batches."""
    return (math.ceil(n_train / batch_size) + math.ceil(n_valid / batch_size)) * batch_size


def with_tokens(df: DataFrame, text_col: str = "text", lower: bool = False, tokenizer=None) -> DataFrame:
    """Adds ``tokens``: by STR1, or by ``tokenizer`` (a Column function or a foreign tokenizer), which then sees lower-cased text with ``lower``."""
    if tokenizer is None:
        return df.withColumn("tokens", tokenize_nds(F.col(text_col), lower))
    if not lower:
        return add_tokens(df, text_col, tokenizer)
    return add_tokens(df.withColumn("_lower", F.lower(text_col)), "_lower", tokenizer).drop("_lower")


def loss_batches(df: DataFrame, length) -> DataFrame:
    """``(source, pair_id, batch_id)``: batches of ``BATCH_SIZE`` rows of similar length (WIN3)."""
    rows = df.select(*KEY, F.coalesce(length, F.lit(0)).alias("_len"))
    return materialize(length_batches(rows, KEY, F.col("_len"), BATCH_SIZE).select(*KEY, "batch_id"))


def batch_loss(scored: DataFrame, batches: DataFrame) -> float | None:
    """AGG6 of a scored table; rows without tokens take no part, None without any row."""
    rows = scored.filter(F.col("n_tok") > 0).join(batches, KEY)
    r = lm.split_loss(rows).first()["split_loss"]
    return None if r is None else float(r)


def score_round(trusted_train: DataFrame, window: DataFrame, tokens_col: str = "tokens"):
    model = lm.fit_unigram(trusted_train, tokens_col)
    return model, lm.score_unigram(model, window, KEY, tokens_col)


def select_round(trusted_train: DataFrame, candidates: DataFrame, round_i: int,
                 q: float = ACCEPT_SHARE, tokens_col: str = "tokens"):
    """One selection step; returns (scored window, threshold, accepted rows)."""
    window = candidate_window(candidates, round_i)
    _, scored = score_round(trusted_train, window, tokens_col)
    # the quantile makes several passes over the scores: compute them once
    scored = materialize(scored)
    threshold = exact_quantile(scored, "loss", q)
    accepted = scored.filter(F.col("loss") <= F.lit(threshold)) if threshold is not None \
        else scored.limit(0)
    return scored, threshold, accepted


@dataclass
class UnigramScorer:
    """Text tables: add-one unigram model over a token column."""
    tokens_col: str = "tokens"

    @property
    def length(self):
        return F.size(self.tokens_col)

    @property
    def reads(self) -> list[str]:
        """The columns that fitting, scoring and ``length`` read."""
        return [self.tokens_col]

    def fit(self, train: DataFrame, valid: DataFrame | None = None, batches: DataFrame | None = None):
        return lm.fit_unigram(train, self.tokens_col)

    def fit_grown(self, known: lm.UnigramModel | None, added: DataFrame, valid: DataFrame) -> tuple[lm.UnigramModel, lm.UnigramModel]:
        """The model of a pool without ``valid``, which is part of it, and the counts of the whole pool: those of the pool before (``known``) plus ``added``."""
        pool = lm.fit_unigram(added, self.tokens_col) if known is None else lm.update_unigram(known, added, self.tokens_col)
        return lm.without_rows(pool, valid, self.tokens_col), pool

    def score(self, model, df: DataFrame) -> DataFrame:
        return lm.score_unigram(model, df, KEY, self.tokens_col)


@dataclass
class LexicalScorer:
    """Pair tables: IBM Model 1 fitted by EM on the train split; the iteration with the smallest validation
    loss (by batches, the first of ties) is the model."""
    src_col: str = "src"
    trg_col: str = "tokens"
    iterations: int = 2

    @property
    def length(self):
        return F.size(self.src_col)

    @property
    def reads(self) -> list[str]:
        return [self.src_col, self.trg_col]

    def fit(self, train: DataFrame, valid: DataFrame | None = None, batches: DataFrame | None = None):
        loss_of = None if batches is None else (lambda scored: batch_loss(scored, batches))
        return lexical.fit(train, KEY, self.src_col, self.trg_col, self.iterations, valid, loss_of=loss_of)

    def score(self, model, df: DataFrame) -> DataFrame:
        return lexical.score(model, df, KEY, self.src_col, self.trg_col)

    def valid_loss(self, model) -> float | None:
        """The loss by which ``fit`` chose the iteration; None if it had no validation pairs."""
        return min((loss for _, loss in model.history if loss is not None), default=None)

    def bleu(self, model, df: DataFrame) -> float | None:
        """Corpus BLEU of the word-by-word translations of ``df`` against its targets."""
        hyp = lexical.translate(lexical.best_translation(model), df, KEY, self.src_col)
        pairs = df.select(*KEY, F.col(self.trg_col).alias("_ref")).join(hyp, KEY)
        return bleu.corpus_bleu(pairs, KEY, "hyp", "_ref").first()["bleu"]


def at_once(*jobs) -> list:
    """Results of functions that run at the same time: the rounds' jobs are small and many, and one after another they leave most cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


@dataclass
class SelectionRun:
    run_id: str
    out_dir: str
    stats: list = field(default_factory=list)

    def stats_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stats, ROUND_STATS_SCHEMA)


def run_selection(trusted: DataFrame, candidates: DataFrame, test: DataFrame | None,
                  rounds: int = 14, strategy: str = "loss", run_id: str | None = None,
                  out_dir: str | None = None, seed: int = SEED, valid_share: float = VALID_SHARE,
                  q: float = ACCEPT_SHARE, tokens_col: str = "tokens", scorer=None,
                  resume: bool = False, with_bleu: bool = False, leak_cols: list[str] | None = None) -> SelectionRun:
    """PIP1 (``strategy='loss'``) or PIP2 (``strategy='random'``).

    ``trusted``/``candidates``/``test``: text or pair tables with ``source``,
    ``pair_id``, ``pos`` and token array column(s).  ``scorer`` has
    ``fit(train, valid, batches) -> model`` (or ``fit_grown(known, added, valid) -> (model, known)`` where rows can be added and left out), ``score(model, df) -> (key, n_tok, sum_nll,
    loss)`` and ``length``, the column whose order makes the batches of the losses; the default is the unigram model over ``tokens_col``.  Outputs under ``out_dir``:
    ``trusted``, ``order`` (candidate keys by rank), ``split/round=i`` (whole rows in round 0, then keys and ``split``; the rows are in
    ``trusted`` and ``accepted``), ``fresh/round=i`` (window rows that no earlier window had), ``accepted/round=i``, ``rejected/round=i``,
    ``losses/round=i`` (long loss summary) and ``round_stats/round=i``, each
    written with overwrite so a retried round replaces its own output.

    ``leak_cols`` names the text columns on which rows equal to a test row leave ``trusted`` and
    ``candidates`` first.  The random strategy scores no candidates, so its losses are null.
    ``resume=True`` with an existing ``out_dir`` continues after the last round
    whose statistics row was written.
    ``with_bleu=True`` (scorers with a ``bleu`` method) fills ``test_bleu`` with the
    corpus BLEU of the round's model on the test table.
    """
    spark = trusted.sparkSession
    scorer = scorer or UnigramScorer(tokens_col)
    run_id = run_id or time.strftime("%Y%m%d-%H%M%S")
    out_dir = out_dir or scratch_path(spark, f"selection-{run_id}")
    run = SelectionRun(run_id, out_dir)
    cols = [c for c in trusted.columns]
    valid_cols = [*KEY, *scorer.reads] if hasattr(scorer, "reads") else cols

    def persist(df: DataFrame, name: str, i: int) -> DataFrame:
        path = os.path.join(out_dir, name, f"round={i}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def exists(name: str, i: int) -> bool:
        try:
            spark.read.parquet(os.path.join(out_dir, name, f"round={i}")).schema
            return True
        except AnalysisException:
            return False

    if leak_cols and test is not None:
        trusted, candidates = (remove_leaks(df, test, leak_cols) for df in (trusted, candidates))
    all_cands = candidates.select(*cols)

    def of_rounds(name: str, upto: int) -> DataFrame:
        return spark.read.parquet(os.path.join(out_dir, name)).filter(F.col("round") < upto).select(*cols)

    def next_candidates(ranks: DataFrame, first: int, n: int) -> DataFrame:
        """The candidates of ranks ``first`` to ``first + n - 1``; their range of ``pos`` reaches the scan."""
        keys = ranks.filter(F.col("rank").between(first, first + n - 1))
        ends = keys.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
        if ends["lo"] is None:
            return all_cands.limit(0)
        near = all_cands.filter(F.col("pos").between(ends["lo"], ends["hi"]))
        return join_small(near, keys.select(*KEY), KEY, "left_semi")

    test_batches = loss_batches(test, scorer.length) if test is not None else None
    start, known = 0, None
    if resume:
        while start < rounds and exists("round_stats", start) and exists("accepted", start) \
                and exists("rejected", start):
            start += 1
        if start:
            st = spark.read.parquet(os.path.join(out_dir, "round_stats")).filter(F.col("round") < start)
            run.stats = [tuple(r[c] for c in _STATS_COLS) for r in st.orderBy("round").collect()]
    if start:
        pool0 = spark.read.parquet(os.path.join(out_dir, "trusted", "round=0"))
        ranks = spark.read.parquet(os.path.join(out_dir, "order", "round=0"))
        left = spark.read.parquet(os.path.join(out_dir, "rejected", f"round={start - 1}"))
        n_left, seen = left.count(), sum(r[-1] for r in run.stats)
        seen += n_left  # ranks reached: accepted in some round, or rejected in the last one
    else:
        pool0 = persist(trusted.select(*cols), "trusted", 0)
        ranks = persist(dense_index(all_cands.filter(F.col("pos").isNotNull()).select("pos", *KEY), ["pos", *KEY], "rank"), "order", 0)
        left, n_left, seen = None, 0, 0
    for i in range(start, rounds):
        t0 = time.time()
        fresh = persist(next_candidates(ranks, seen, window_size(i) - n_left), "fresh", i)
        window = fresh if left is None else left.unionByName(fresh)
        n_window = window.count()
        if not n_window:
            break
        seen += n_window - n_left
        pool = pool0 if i == 0 else pool0.unionByName(of_rounds("accepted", i))
        split = train_valid_split(pool, KEY, seed, valid_share, salt=str(i))
        train = split.filter(F.col("split") == "train")
        valid = stored(split.filter(F.col("split") == "valid").select(*valid_cols), f"valid-{i}")  # read several times, a tenth of the pool

        def split_sizes():
            kept = persist(split if i == 0 else split.select(*KEY, "split"), "split", i)
            return {r["split"]: r["count"] for r in kept.groupBy("split").count().collect()}      # two rows

        def grown():
            added = pool if known is None else spark.read.parquet(os.path.join(out_dir, "accepted", f"round={i - 1}"))
            return scorer.fit_grown(known, added, valid)

        with_counts = hasattr(scorer, "fit_grown")
        sizes, batches, fitted = at_once(split_sizes, lambda: loss_batches(valid, scorer.length), grown if with_counts else lambda: None)
        n_train, n_valid = sizes.get("train", 0), sizes.get("valid", 0)
        if with_counts:
            model, known = fitted
        else:
            model = scorer.fit(train, valid if n_valid else None, batches)
        fit_secs = time.time() - t0

        def losses():
            t1 = time.time()
            valid_loss = scorer.valid_loss(model) if hasattr(scorer, "valid_loss") else None  # known from the fit
            if valid_loss is None:
                valid_loss = batch_loss(scorer.score(model, valid), batches)
            return valid_loss, time.time() - t1

        def test_losses():
            t1 = time.time()
            test_loss = batch_loss(scorer.score(model, test), test_batches) if test is not None else None
            test_bleu = scorer.bleu(model, test) if with_bleu and test is not None and hasattr(scorer, "bleu") else None
            return test_loss, test_bleu, time.time() - t1

        def chosen():
            t1 = time.time()
            if strategy == "loss":
                # every window row gets a score row (null loss when it has no tokens)
                scored = window.select(*KEY).join(scorer.score(model, window), KEY, "left")
                scored = persist(scored, "losses", i)
                w_stats = scored.agg(F.count("loss").alias("n_scored"), lm.mean_of_rounded("loss").alias("avg")).first()
                residual_loss = w_stats["avg"]
                threshold = exact_quantile(scored, "loss", q, n=w_stats["n_scored"])
                acc_keys = scored.filter(F.col("loss") <= F.lit(threshold)).select(*KEY)
            elif strategy == "random":
                persist(window.select(*KEY, F.lit(None).cast("double").alias("loss")), "losses", i)
                threshold = residual_loss = None
                acc_keys = sample_n(window.select(*KEY), accept_count(n_window, q), KEY, seed, salt=f"pick{i}")
            else:
                raise ValueError(strategy)
            acc_keys = materialize(acc_keys)
            _, rest = at_once(lambda: persist(window.join(acc_keys, KEY, "left_semi").select(*cols), "accepted", i),
                              lambda: persist(window.join(acc_keys, KEY, "left_anti").select(*cols), "rejected", i))
            return residual_loss, threshold, rest, rest.count(), time.time() - t1

        # three chains of small jobs that need nothing of each other
        (valid_loss, valid_secs), (test_loss, test_bleu, test_secs), (residual_loss, threshold, left, n_left, score_secs) = at_once(losses, test_losses, chosen)
        fit_secs += max(valid_secs, test_secs)
        n_acc = n_window - n_left

        row = (run_id, i, valid_loss, int(fit_secs // 60), int(fit_secs - 60 * (fit_secs // 60)),
               test_loss, residual_loss, int(score_secs // 60),
               int(score_secs - 60 * (score_secs // 60)), threshold, test_bleu,
               total_samples(n_train, n_valid), n_window, n_acc)
        run.stats.append(row)
        # SNK4: one statistics row per round, written as soon as the round is done
        spark.createDataFrame([row], ROUND_STATS_SCHEMA).drop("round") \
            .write.mode("overwrite").parquet(os.path.join(out_dir, "round_stats", f"round={i}"))
        discard(valid)
    return run


def selection_round0(trusted: DataFrame, candidates: DataFrame, q: float = ACCEPT_SHARE) -> DataFrame:
    """Flagship: round 0 with the model fitted on the whole trusted table.

    Returns the accepted rows ``(pair_id, loss)``.
    """
    scored, threshold, accepted = select_round(with_tokens(trusted), with_tokens(candidates), 0, q)
    return accepted.select("pair_id", "loss")
