"""Corpus assembly for a final training run (PIP4: SET2, SMP5, WIN5, SUB1, FLT3).

train + word book -> shuffle -> dense re-index; subword vocabularies are
trained on this set *before* the monolingual rows are added (they must not
shape the vocabulary); the monolingual rows are sampled, encoded, rows whose
``deu`` side has ``max_pieces`` or more pieces are dropped (after the sample,
as in the original order), and the union is shuffled and re-indexed again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators import subword
from corpusforge.operators.sampling import SEED, sample_n, shuffle_reindex

KEY = ["source", "pair_id"]
MONO_SEED = 42
MAX_PIECES = 60


@dataclass
class Assembly:
    corpus: DataFrame          # (idx, source, pair_id, deu, nds)
    deu_model: subword.BpeModel
    nds_model: subword.BpeModel
    n_mono_dropped: int


def assemble(train: DataFrame, wordbook: DataFrame | None, mono: DataFrame | None,
             vocab_size: int = subword.VOCAB_SIZE,
             mono_sample: int | None = None, max_pieces: int = MAX_PIECES, seed: int = SEED) -> Assembly:
    cols = KEY + ["deu", "nds"]
    base = train.select(*cols)
    if wordbook is not None:
        base = base.unionByName(wordbook.select(*cols))
    base = shuffle_reindex(base, KEY, seed)
    # a training is some hundred small jobs one after another, which leave most cores idle: both sides at once
    with ThreadPoolExecutor(2) as pool:
        deu_model, nds_model = pool.map(lambda side: subword.train_bpe(base, side, vocab_size), ("deu", "nds"))
    dropped = 0
    corpus = base
    if mono is not None:
        m = mono.select(*cols)
        if mono_sample is not None:
            m = sample_n(m, mono_sample, KEY, MONO_SEED)
        enc = subword.encode(deu_model, m, KEY, "deu")
        keep = enc.filter(F.size("ids") < max_pieces).select(*KEY)
        kept = m.join(keep, KEY, "left_semi")
        dropped = m.count() - kept.count()
        corpus = shuffle_reindex(base.drop("idx").unionByName(kept), KEY, seed)
    return Assembly(corpus.select("idx", *cols), deu_model, nds_model, dropped)
