"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the given tables (or data Spark derives from them) in full.
Column names match the SQL oracle in ``corpusforge.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions import text as T
from corpusforge.operators import batching, bleu, leakage, lexical, lm, normalise, sampling, subword, subword_unigram, udf, vocab
from corpusforge.operators.ordering import dense_index, exact_quantile, first_n, order_statistic
from corpusforge.plans import assembly, report, selection
from corpusforge.session import materialize, scratch_path
from corpusforge.sources import files, tables
from corpusforge.streaming import requests as req_stream

Query = Callable[[SparkSession, str], DataFrame]

_MEMO: dict = {}


_INPUTS = ("documents", "labels", "benchmark", "conversations")


def _memo(spark, key, build):
    """Models trained once per session and input data, shared by several queries; ``key`` has a name and the input folder."""
    stamps = tuple(tables.table_stamp(spark, key[1], t) for t in _INPUTS)
    k = (id(spark), spark.sparkContext.applicationId, stamps) + tuple(key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def q_select_round0_docs(spark, sf):
    """PIP1 round 0 on documents: unigram LM of trusted docs, window 501, quarter cut."""
    return selection.selection_round0(tables.trusted_documents(spark, sf),
                                      tables.candidate_documents(spark, sf))


def q_tokenize_nds_docs(spark, sf):
    """STR1 over every document."""
    d = tables.read_table(spark, sf, "documents").select("doc_id", T.tokenize_nds("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tok"), T.join_tokens("t").alias("tokens"))


def q_tokenize_de_docs(spark, sf):
    """STR2 (+ STR3 lower-casing) over every document."""
    d = tables.read_table(spark, sf, "documents").select(
        "doc_id", T.tokenize_de("text").alias("t"), T.tokenize_de("text", lower=True).alias("tl"))
    return d.select("doc_id", F.size("t").alias("n_tok"), T.join_tokens("t").alias("tokens"),
                    T.join_tokens("tl").alias("tokens_lower"))


def q_length_filter_requests(spark, sf):
    """FLT1 + FLT2: untranslated sentences with 1..30 split parts."""
    s = tables.request_sentences(spark, sf).withColumn("n_parts", T.word_count("deu"))
    return s.filter(F.col("n_parts").between(1, 30)).select("sent_id", "n_parts")


def q_vocab_trusted(spark, sf):
    """AGG1 + WIN4: vocabulary of the trusted documents (specials first)."""
    t = tables.trusted_documents(spark, sf).select(T.tokenize_nds("text").alias("tokens"))
    return vocab.build_vocab(t, "tokens").select("token", "freq", "id")


def q_conversation_pairs(spark, sf):
    """Pair table derived from conversations (user turn -> next assistant turn)."""
    return tables.conversation_pairs(spark, sf)


def q_leak_matches(spark, sf):
    """JOI1: line-level matches of documents against the test set, per document."""
    lines = tables.document_lines(spark, sf)
    test = tables.test_lines(spark, sf).select("line")
    m = leakage.leak_matches(lines, test, ["line"])
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"))


def q_leak_free_lines(spark, sf):
    """JOI2: document lines left after removing every test line (null-safe)."""
    lines = tables.document_lines(spark, sf)
    test = tables.test_lines(spark, sf)
    return leakage.remove_leaks(lines, test, ["line"]).select("doc_id", "line_no")


def q_leak_probe_docs(spark, sf):
    """FLT5: one test line drawn with seed 1234 and one with seed 42; documents containing it."""
    lines = tables.test_lines(spark, sf)
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "text")
    out = None
    for seed in (1234, 42):
        hits = leakage.leak_probe(docs, lines.withColumnRenamed("line", "text"), "text",
                                  ["item_id", "line_no"], seed=seed)
        hits = hits.select(F.lit(seed).alias("seed"), "doc_id")
        out = hits if out is None else out.unionByName(hits)
    return out


def q_split_trusted_docs(spark, sf):
    """SMP1: seeded 90/10 train/valid split of the trusted documents."""
    t = tables.trusted_documents(spark, sf)
    return sampling.train_valid_split(t, ["source", "pair_id"]).select("pair_id", "split")


def q_split_sizes_docs(spark, sf):
    """AGG2 + AGG3: split sizes and the batch-rounded sample count."""
    t = tables.trusted_documents(spark, sf)
    s = sampling.train_valid_split(t, ["source", "pair_id"])
    c = s.groupBy().agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("n_train"),
                        F.sum(F.when(F.col("split") == "valid", 1).otherwise(0)).alias("n_valid"))
    b = F.lit(selection.BATCH_SIZE)
    return c.select("n_train", "n_valid",
                    ((F.ceil(F.col("n_train") / b) + F.ceil(F.col("n_valid") / b)) * b)
                    .cast("long").alias("total_samples"))


def q_sample_requests(spark, sf):
    """FLT2 then SMP3: 50 length-filtered untranslated sentences, seed 42."""
    s = tables.request_sentences(spark, sf).filter(T.word_count("deu").between(1, 30))
    return sampling.sample_n(s, 50, ["sent_id"], seed=42).select("sent_id", "deu")


def q_random_round0_docs(spark, sf):
    """PIP2 round 0: seeded random pick of int(0.25 * |window|) candidates."""
    cands = tables.candidate_documents(spark, sf)
    window = sampling.candidate_window(cands, 0)
    n = sampling.accept_count(window.count())
    return sampling.sample_n(window, n, ["source", "pair_id"], salt="pick0").select("pair_id")


def q_window_quantile_docs(spark, sf):
    """WIN2 + AGG5 + AGG4: window size, mean loss and exact 0.25 quantile of round 0."""
    trusted = selection.with_tokens(tables.trusted_documents(spark, sf))
    window = sampling.candidate_window(selection.with_tokens(tables.candidate_documents(spark, sf)), 0)
    _, scored = selection.score_round(trusted, window)
    q = exact_quantile(scored, "loss", 0.25)
    agg = scored.agg(F.count(F.lit(1)).alias("n_window"),
                     F.round(lm.mean_of_rounded("loss"), 6).alias("residual_loss"),
                     F.max("pair_id").alias("last_pair_id"))
    return agg.withColumn("quantile", F.round(F.lit(q), 6))


def _pair_tokens(spark, sf):
    pairs = tables.with_roles(spark, sf, tables.conversation_pairs(spark, sf))
    return pairs.withColumn("src", T.tokenize_de("deu")).withColumn("tokens", T.tokenize_nds("nds"))


def q_pair_batches(spark, sf):
    """WIN3 + ARR3: 64-row batches by source length; width = longest source + 2 specials."""
    p = _pair_tokens(spark, sf)
    b = batching.length_batches(p, ["source", "pair_id"], F.size("src"))
    return b.select("pair_id", "batch_id", "batch_len", (F.col("width") + 2).alias("width"))


def q_batch_loss_pairs(spark, sf):
    """AGG6: unigram model of trusted target sides, loss of candidate pairs by batch."""
    p = _pair_tokens(spark, sf)
    model = lm.fit_unigram(tables.trusted_pairs(p))
    cand = tables.candidate_pairs(p)
    scored = lm.score_unigram(model, cand, ["source", "pair_id"])
    b = batching.length_batches(cand.select("source", "pair_id", "src"), ["source", "pair_id"], F.size("src"))
    return lm.split_loss(scored.join(b.select("source", "pair_id", "batch_id"), ["source", "pair_id"])
                         .filter(F.col("n_tok") > 0))


def q_bigram_scores_pairs(spark, sf):
    """WIN7 + bigram LM: add-one bigram loss of candidate target sides."""
    p = _pair_tokens(spark, sf)
    model = lm.fit_bigram(tables.trusted_pairs(p))
    return lm.score_bigram(model, tables.candidate_pairs(p), ["pair_id"]).select("pair_id", "n_tok", "loss")


def _event_stats(spark, sf):
    ev = tables.read_table(spark, sf, "events").select("ts", "event_type", "value")
    day0 = ev.agg(F.min(F.to_date("ts"))).first()[0]
    daily = (ev.groupBy(F.col("event_type").alias("run_id"),
                        F.datediff(F.to_date("ts"), F.lit(day0)).alias("round"))
             .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("test_loss")))
    from pyspark.sql import Window
    w = Window.partitionBy("run_id").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("total_samples", F.sum("n").over(w))


def q_run_new_samples_events(spark, sf):
    """WIN1: per-run ``total_samples.diff()`` on event-derived round statistics."""
    st = report.with_new_samples(_event_stats(spark, sf))
    return st.select("run_id", "round", "total_samples", "new_samples")


def q_run_shares_events(spark, sf):
    """AGG10: share of all rows absorbed in the first six and all-but-last rounds."""
    n = tables.read_table(spark, sf, "events").count()
    return report.absorbed_shares(_event_stats(spark, sf), n)


def q_run_compare_events(spark, sf):
    """JOI5 + MTH3: 'click' run against 'view' run, aligned on round."""
    c = report.compare_runs(_event_stats(spark, sf), "click", "view")
    return c.select("round", F.round("loss_delta", 6).alias("loss_delta"),
                    F.round("loss_delta_pct", 6).alias("loss_delta_pct"), "samples")


_KEY = ["source", "pair_id"]


def _lexical_model(spark, sf, iterations: int = 2):
    p = _pair_tokens(spark, sf)
    model = _memo(spark, ("ibm1", sf, iterations),
                  lambda: lexical.fit(tables.trusted_pairs(p), _KEY, "src", "tokens", iterations))
    return p, model


def q_ibm1_scores_pairs(spark, sf):
    """PIP6b + JOI9: IBM Model 1 (2 EM steps) on trusted pairs, loss of candidate pairs."""
    p, model = _lexical_model(spark, sf)
    sc = lexical.score(model, tables.candidate_pairs(p), _KEY, "src", "tokens")
    return sc.select("pair_id", "n_tok", "loss")


def q_ibm1_best_iteration_pairs(spark, sf):
    """AGG7: three EM steps on the train split of the trusted pairs, validation loss after
    each; the smallest wins, the first of ties (strict <)."""
    p = _pair_tokens(spark, sf)
    split = sampling.train_valid_split(tables.trusted_pairs(p), _KEY)
    train, valid = split.filter("split = 'train'"), split.filter("split = 'valid'")
    model = lexical.fit(train, _KEY, "src", "tokens", iterations=3, valid=valid)
    best = min(model.history, key=lambda h: (h[1], h[0]))[0]
    rows = [(it, loss, it == best) for it, loss in model.history]
    return spark.createDataFrame(rows, "iteration int, valid_loss double, is_best boolean") \
        .withColumn("valid_loss", F.round("valid_loss", 6))


def q_ibm1_best_pairs(spark, sf):
    """TOP1: most probable target token per source token."""
    _, model = _lexical_model(spark, sf)
    return lexical.best_translation(model).select("e", "best")


def q_translate_requests(spark, sf):
    """PIP7 + STR4: word-by-word translation of every untranslated sentence (<= 50 tokens)."""
    _, model = _lexical_model(spark, sf)
    req = tables.request_sentences(spark, sf).withColumn("toks", T.tokenize_de("deu"))
    out = lexical.translate(lexical.best_translation(model), req, ["sent_id"], "toks")
    return out.select("sent_id", T.join_tokens("hyp").alias("ai_nds"))


def _candidate_translations(spark, sf):
    p, model = _lexical_model(spark, sf)
    cand = tables.candidate_pairs(p)
    hyp = lexical.translate(lexical.best_translation(model), cand, ["pair_id"], "src")
    return cand.select("pair_id", "nds", F.col("tokens").alias("ref")).join(hyp, "pair_id")


def q_bleu_tokens_pairs(spark, sf):
    """AGG8: corpus BLEU of lexical translations of candidate pairs (token n-grams)."""
    return bleu.corpus_bleu(_candidate_translations(spark, sf), ["pair_id"], "hyp", "ref")


def q_bleu_chars_pairs(spark, sf):
    """AGG9: the same corpus BLEU over characters of the joined strings."""
    d = _candidate_translations(spark, sf).select(
        "pair_id", bleu.char_units(T.join_tokens("hyp")).alias("hc"), bleu.char_units("nds").alias("rc"))
    return bleu.corpus_bleu(d, ["pair_id"], "hc", "rc")


def _bpe_model(spark, sf):
    return _memo(spark, ("bpe", sf), lambda: subword.train_bpe(
        tables.trusted_documents(spark, sf), "text", vocab_size=subword.VOCAB_SIZE))


def q_bpe_pair_counts_trusted(spark, sf):
    """SUB1 first step: symbol pair counts over the word-type table of trusted documents."""
    w = subword.word_types(tables.trusted_documents(spark, sf), "text")
    return subword.pair_counts(w).select("a", "b", "n")


def q_bpe_vocab_trusted(spark, sf):
    """SUB1: 10 000-piece subword vocabulary of the trusted documents."""
    return _bpe_model(spark, sf).vocab.select("piece", "id")


def q_subword_roundtrip_requests(spark, sf):
    """SUB2 + SUB3: encode every request with the trusted-document model and decode it."""
    model = _bpe_model(spark, sf)
    req = tables.request_sentences(spark, sf)
    enc = subword.encode(model, req, ["sent_id"], "deu")
    dec = subword.decode(model, enc, ["sent_id"], "ids", "back")
    return req.join(dec, "sent_id").select(
        "sent_id", (F.col("back") == subword.normalize_spaces(F.col("deu"))).alias("roundtrip_ok"))


def _spelling(spark, sf):
    def build():
        tr = tables.trusted_documents(spark, sf).select(T.tokenize_nds("text").alias("tokens"))
        # both tables feed several joins and a size check: compute them once
        counts = materialize(vocab.token_counts(tr, "tokens"))
        return counts, materialize(normalise.case_variants(counts))
    return _memo(spark, ("spelling", sf), build)


def q_spelling_normalise_candidates(spark, sf):
    """JOI8 + PIP9: candidate documents with case variants replaced by the preferred form."""
    _, dictionary = _spelling(spark, sf)
    c = tables.candidate_documents(spark, sf).withColumn("tokens", T.tokenize_nds("text"))
    n = normalise.normalise_tokens(c, ["pair_id"], "tokens", dictionary)
    return n.select(F.col("pair_id").alias("doc_id"), "n_tokens", "n_changed",
                    T.join_tokens("normalised").alias("text"))


def q_spelling_share_candidates(spark, sf):
    """AGG11: share of candidate-document words the dictionary changed."""
    _, dictionary = _spelling(spark, sf)
    c = tables.candidate_documents(spark, sf).withColumn("tokens", T.tokenize_nds("text"))
    return normalise.changed_share(normalise.normalise_tokens(c, ["pair_id"], "tokens", dictionary))


def q_autocorrect_requests(spark, sf):
    """PIP10: request tokens outside the trusted vocabulary -> most frequent word within edit distance 1."""
    counts, _ = _spelling(spark, sf)
    req = tables.request_sentences(spark, sf).select(F.explode(T.tokenize_nds("deu")).alias("token"))
    return normalise.autocorrect(req, counts)


def _selection_run(spark, sf, strategy: str, rounds: int = 2):
    def build():
        trusted = selection.with_tokens(tables.trusted_documents(spark, sf))
        cands = selection.with_tokens(tables.candidate_documents(spark, sf))
        b = tables.read_table(spark, sf, "benchmark")
        test = selection.with_tokens(b.select(F.lit("benchmark").alias("source"), F.col("item_id").alias("pair_id"),
                                              F.col("item_id").alias("pos"), "text"))
        return selection.run_selection(trusted, cands, test, rounds=rounds, strategy=strategy,
                                       run_id=f"{strategy}-{rounds}", leak_cols=["text"])
    return _memo(spark, ("selection", sf, strategy, rounds), build)


def _pair_selection_run(spark, sf, rounds: int = 2, strategy: str = "loss"):
    def build():
        p = _pair_tokens(spark, sf)
        lines = tables.test_lines(spark, sf)
        # test pairs: consecutive lines of a benchmark item (line i -> line i + 1)
        nxt = lines.select("item_id", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("nds"))
        test = lines.join(nxt, ["item_id", "line_no"]).select(
            F.lit("benchmark").alias("source"), tables.compound_key("item_id", "line_no").alias("pair_id"), F.col("item_id").alias("pos"),
            F.col("line").alias("deu"), "nds")
        test = test.withColumn("src", T.tokenize_de("deu")).withColumn("tokens", T.tokenize_nds("nds"))
        return selection.run_selection(tables.trusted_pairs(p), tables.candidate_pairs(p), test, rounds=rounds, strategy=strategy,
                                       run_id=f"pairs-{strategy}-{rounds}", scorer=selection.LexicalScorer(), leak_cols=["deu", "nds"],
                                       with_bleu=strategy == "random")
    return _memo(spark, ("pair-selection", sf, strategy, rounds), build)


def _accepted_with_loss(spark, run):
    import os
    acc = spark.read.parquet(os.path.join(run.out_dir, "accepted"))
    losses = spark.read.parquet(os.path.join(run.out_dir, "losses"))
    return acc.select("round", "source", "pair_id").join(
        losses.select("round", "source", "pair_id", "loss"), ["round", "source", "pair_id"], "left") \
        .select("round", "pair_id", "loss")


def q_selection_rounds_docs(spark, sf):
    """PIP1: two chained selection rounds (split, fit, window, score, quantile cut, grow)."""
    return _accepted_with_loss(spark, _selection_run(spark, sf, "loss"))


def q_selection_stats_docs(spark, sf):
    """SNK4: deterministic columns of the round statistics of the two-round run."""
    st = _selection_run(spark, sf, "loss").stats_df(spark)
    return st.select("round", "n_window", "n_accepted", "total_samples",
                     F.round("quantile", 6).alias("quantile"),
                     F.round("best_valid_loss", 6).alias("best_valid_loss"),
                     F.round("test_loss", 6).alias("test_loss"),
                     F.round("residual_loss", 6).alias("residual_loss"),
                     F.round(T.perplexity("best_valid_loss"), 6).alias("valid_ppl"),
                     F.round(T.perplexity("test_loss"), 6).alias("test_ppl"))


def q_selection_rounds_pairs(spark, sf):
    """PIP1 on sentence pairs: two rounds scored by IBM Model 1 refitted on each round's train split."""
    return _accepted_with_loss(spark, _pair_selection_run(spark, sf))


def q_selection_stats_pairs(spark, sf):
    """SNK4 for the pair run: deterministic statistics of both rounds."""
    st = _pair_selection_run(spark, sf).stats_df(spark)
    return st.select("round", "n_window", "n_accepted", "total_samples",
                     F.round("quantile", 6).alias("quantile"),
                     F.round("best_valid_loss", 6).alias("best_valid_loss"),
                     F.round("test_loss", 6).alias("test_loss"),
                     F.round("residual_loss", 6).alias("residual_loss"),
                     F.round(T.perplexity("best_valid_loss"), 6).alias("valid_ppl"),
                     F.round(T.perplexity("test_loss"), 6).alias("test_ppl"))


def q_selection_full_docs(spark, sf):
    """PIP1 with the original run length: 14 chained rounds (windows 501, 1001, ... of what is left)."""
    return _accepted_with_loss(spark, _selection_run(spark, sf, "loss", rounds=14))


def q_selection_full_stats_docs(spark, sf):
    """SNK4 of the 14-round run."""
    st = _selection_run(spark, sf, "loss", rounds=14).stats_df(spark)
    return st.select("round", "n_window", "n_accepted", "total_samples",
                     F.round("quantile", 6).alias("quantile"),
                     F.round("best_valid_loss", 6).alias("best_valid_loss"),
                     F.round("test_loss", 6).alias("test_loss"),
                     F.round("residual_loss", 6).alias("residual_loss"),
                     F.round(T.perplexity("best_valid_loss"), 6).alias("valid_ppl"),
                     F.round(T.perplexity("test_loss"), 6).alias("test_ppl"))


def q_random_rounds_docs(spark, sf):
    """PIP2: two chained rounds of the random-pick baseline."""
    return _accepted_with_loss(spark, _selection_run(spark, sf, "random")).select("round", "pair_id")


def q_csv_roundtrip_pairs(spark, sf):
    """SRC1: pairs written as pandas-style CSV (quotes, newlines) and read back."""
    path = scratch_path(spark, "pairs-csv")
    files.write_pairs_csv(tables.conversation_pairs(spark, sf), path)
    return files.read_pairs(spark, path, files.KEYED_PAIR_FILE_SCHEMA)


def q_tsv_positional_pairs(spark, sf):
    """SRC2 + SRC3: TSV written, read back by position (id dropped, src, trg)."""
    path = scratch_path(spark, "pairs-tsv")
    files.write_pairs_tsv(tables.conversation_pairs(spark, sf), path)
    return files.read_positional(spark, path, sep="\t")


def q_text_export_trusted(spark, sf):
    """SNK3: one side exported as plain text lines (no quoting), read back."""
    path = scratch_path(spark, "side-text")
    files.export_side(tables.trusted_documents(spark, sf), "text", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_loss_summary_docs(spark, sf):
    """SNK5 + JOI4: wide loss summary of the two-round run (null where not scored)."""
    import os
    run = _selection_run(spark, sf, "loss")
    losses = spark.read.parquet(os.path.join(run.out_dir, "losses"))
    cands = tables.candidate_documents(spark, sf).select("source", "pair_id")
    wide = files.loss_summary_wide(losses, [0, 1], ["source", "pair_id"])
    return cands.join(wide, ["source", "pair_id"], "left").select(
        "pair_id", F.col("0").alias("r0"), F.col("1").alias("r1"))


def q_shuffle_reindex_pairs(spark, sf):
    """SMP5 + WIN5: seeded permutation of all pairs with a dense 0-based index."""
    p = tables.conversation_pairs(spark, sf)
    return sampling.shuffle_reindex(p, _KEY).select("idx", "pair_id")


def q_corpus_assembly_pairs(spark, sf):
    """PIP4: trusted pairs + word book (best lexical translations), subword models,
    candidate pairs as monolingual rows filtered to < 60 pieces, shuffled and re-indexed."""
    p, model = _lexical_model(spark, sf)
    best = lexical.best_translation(model).filter(~F.col("e").isin("<sos>", "<eos>"))
    book = dense_index(best, ["e"], "pair_id").select(
        F.lit("wordbook").alias("source"), F.col("pair_id").cast("string"), F.col("e").alias("deu"), F.col("best").alias("nds"))
    mono = tables.candidate_pairs(p).withColumn("source", F.lit("mono"))
    a = assembly.assemble(tables.trusted_pairs(p), book, mono)
    return a.corpus.select("idx", "source", "pair_id")


def q_head_candidates_docs(spark, sf):
    """FLT7: preview, the first five candidates in file order."""
    return first_n(tables.candidate_documents(spark, sf), 5, "pos", ["source", "pair_id"]).select("pair_id")


def q_window_example_docs(spark, sf):
    """FLT6: the example at ordinal 8 of the round-0 window, with its token count."""
    w = selection.with_tokens(sampling.candidate_window(tables.candidate_documents(spark, sf), 0))
    pos = order_statistic(w, "pos", 9)[0]
    return w.filter(F.col("pos") == pos).select("pair_id", F.size("tokens").alias("n_tok"))


def q_length_limit_pairs(spark, sf):
    """FLT8: pairs that fit the 100-position limit (source + 2 specials, target + 1)."""
    p = _pair_tokens(spark, sf)
    return p.filter((F.size("src") + 2 <= 100) & (F.size("tokens") + 1 <= 100)).select("pair_id")


def q_numericalize_pairs(spark, sf):
    """AGG1 + JOI6 + JOI7: target vocabulary of trusted pairs; candidate targets to ids and back."""
    p = _pair_tokens(spark, sf)
    voc = vocab.build_vocab(tables.trusted_pairs(p), "tokens")
    ids = vocab.numericalize(tables.candidate_pairs(p), ["pair_id"], "tokens", voc)
    back = vocab.denumericalize(ids, ["pair_id"], "ids", voc)
    return ids.join(back, "pair_id").select(
        "pair_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"),
        F.size(F.filter("ids", lambda x: x == 0)).alias("n_unk"), T.join_tokens("tokens").alias("back"))


def q_stream_translate_requests(spark, sf):
    """PIP8: the request table read as a file stream, translated batch by batch."""
    import os
    _, model = _lexical_model(spark, sf)
    best = _memo(spark, ("best", sf), lambda: lexical.shared_translations(lexical.best_translation(model)))  # measured once, not per micro-batch
    conv = tables.read_table(spark, sf, "conversations")
    stream = req_stream.table_stream(spark, os.path.join(sf, "conversations.parquet"), conv.schema)
    reqs = stream.filter(F.col("role") == "user").select(
        tables.compound_key("conv_id", "turn").alias("sent_id"), F.col("text").alias("deu"))
    sink = scratch_path(spark, "stream-sink")
    q = req_stream.translate_stream(reqs, best, sink)
    q.awaitTermination()
    return req_stream.read_translations(spark, sink).select("sent_id", "ai_nds")


def _unigram_model(spark, sf):
    return _memo(spark, ("unigram-pieces", sf), lambda: subword_unigram.train_unigram(tables.trusted_documents(spark, sf), "text"))


def q_unigram_vocab_trusted(spark, sf):
    """SUB1 by the unigram model: 10 000-piece subword vocabulary of the trusted documents."""
    return _unigram_model(spark, sf).vocab(spark)


def q_unigram_roundtrip_requests(spark, sf):
    """SUB2 + SUB3 with the unigram vocabulary: every request to its most probable pieces and back.  Characters that the trusted
    documents do not have are ``<unk>`` and vanish, so they are left out of the comparison."""
    model = _unigram_model(spark, sf)
    req = tables.request_sentences(spark, sf)
    enc = subword_unigram.encode(model, req, ["sent_id"], "deu")
    dec = subword.decode(subword.BpeModel([], model.vocab(spark), None), enc, ["sent_id"], "ids", "back")
    known = "".join(sorted(p for p in model.logp if len(p) == 1))
    kept = F.array_join(F.filter(F.split("deu", ""), lambda c: F.lit(known).contains(c) | c.rlike(T.WHITESPACE)), "")
    return req.join(dec, "sent_id").select("sent_id", (F.col("back") == subword.normalize_spaces(kept)).alias("roundtrip_ok"))


def q_subword_ends_requests(spark, sf):
    """ARR1, subword form: the ids of every request with begin and end marks, added once however often they are asked for."""
    ids = subword.encode(_bpe_model(spark, sf), tables.request_sentences(spark, sf), ["sent_id"], "deu")
    once = ids.withColumn("ends", T.add_specials_if_missing("ids"))
    twice = once.withColumn("again", T.add_specials_if_missing("ends"))
    return twice.select("sent_id", F.element_at("ends", 1).alias("first_id"), F.element_at("ends", -1).alias("last_id"),
                        (F.size("ends") - F.size("ids")).alias("n_added"), (F.size("again") - F.size("ends")).alias("n_added_again"))


def q_user_scorer_rounds_docs(spark, sf):
    """UDF1 as the loop's scorer: two rounds with a model of the user's, which here prefers texts of short words."""
    trusted = selection.with_tokens(tables.trusted_documents(spark, sf))
    cands = selection.with_tokens(tables.candidate_documents(spark, sf))

    def measured(model, pdf):
        words = pdf["tokens"].map(lambda t: [] if t is None else t)
        return words.map(len), words.map(lambda t: model["weight"] * sum(map(len, t)))

    scorer = udf.UserScorer(load=lambda trained: {"weight": 1.0}, fn=measured, columns=["tokens"], length=F.size("tokens"))
    run = selection.run_selection(trusted, cands, None, rounds=2, run_id="user-2", scorer=scorer)
    return _accepted_with_loss(spark, run)


def q_foreign_tokens_docs(spark, sf):
    """UDF2: every document through a tokenizer that is a Python function, loaded once per task."""
    def load():
        import re
        return re.compile(T.NDS_PUNCT), re.compile(r"\s")

    def split(model, texts):
        return [[w for w in model[1].split(model[0].sub(r" \1", t)) if w] for t in texts]

    docs = tables.read_table(spark, sf, "documents").select("doc_id", "text")
    out = selection.with_tokens(docs, tokenizer=udf.ForeignTokenizer(load, split))
    return out.select("doc_id", F.size("tokens").alias("n_tok"), T.join_tokens("tokens").alias("tokens"))


def q_padded_batches_pairs(spark, sf):
    """WIN3 + JOI6 + ARR1 + ARR3: source ids of all pairs with both ends, padded to their batch's width, and the padding mask."""
    p = _pair_tokens(spark, sf)
    voc = vocab.build_vocab(tables.trusted_pairs(p), "src")
    ids = vocab.numericalize(p.select(*_KEY, T.add_specials("src").alias("s")), _KEY, "s", voc)
    batches = batching.length_batches(ids, _KEY, F.size("ids"))
    out = batching.pad_batch(batches, "ids", 1)
    digits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ")
    return out.select("pair_id", "batch_id", digits("padded").alias("padded"), digits("mask").alias("mask"))


def q_tsv_pairs(spark, sf):
    """SRC2: pairs written as TSV and read back with their ids."""
    path = scratch_path(spark, "pairs-tsv")
    files.write_pairs_tsv(tables.conversation_pairs(spark, sf), path)
    return files.read_pairs_tsv(spark, path, files.KEYED_PAIR_FILE_SCHEMA)


def q_sides_by_position_pairs(spark, sf):
    """SRC4: both sides of a file whose id is its first data column, taken by position."""
    path = scratch_path(spark, "pairs-csv")
    files.write_pairs_csv(tables.conversation_pairs(spark, sf), path)
    return files.sides_by_position(files.read_pairs(spark, path, files.KEYED_PAIR_FILE_SCHEMA).toDF("a", "b", "c"))


def q_snapshot_docs(spark, sf):
    """SRC5 + SNK8: inputs of two runs and rounds copied next to the results; one run's round read back by partition."""
    base = scratch_path(spark, "snapshots")
    trusted, cands = (t(spark, sf).select("pair_id", "text") for t in (tables.trusted_documents, tables.candidate_documents))
    for run, i, df in (("a", 0, trusted), ("a", 1, cands), ("b", 0, cands), ("a", 0, trusted)):
        files.snapshot(df, base, run, i, "inputs")
    return files.read_run_table(spark, base, "inputs", "a", 0).select("run_id", F.col("round").cast("int").alias("round"), "pair_id", "text")


def q_translations_sink_requests(spark, sf):
    """SNK6: translations of all requests written and read back."""
    path = scratch_path(spark, "translations")
    req = tables.request_sentences(spark, sf)
    files.write_translations(req.join(q_translate_requests(spark, sf), "sent_id"), path)
    return spark.read.parquet(path).select("sent_id", "deu", "ai_nds")


def q_saved_vocab_trusted(spark, sf):
    """SNK7: the vocabulary saved and loaded."""
    path = scratch_path(spark, "vocab")
    files.save_vocab(q_vocab_trusted(spark, sf), path)
    return files.load_vocab(spark, path)


def q_elapsed_events(spark, sf):
    """MTH2: minutes and seconds of the time that passed from each user's first event to each event."""
    ev = tables.read_table(spark, sf, "events").select("user_id", "ts")
    first = ev.groupBy("user_id").agg(F.min("ts").alias("t0"))
    e = ev.join(first, "user_id").withColumn("e", F.col("ts").cast("timestamp").cast("double") - F.col("t0").cast("timestamp").cast("double"))
    return e.groupBy("user_id").agg(F.sum(T.elapsed_minutes("e")).alias("mins"), F.sum(T.elapsed_seconds("e")).alias("secs"))


def q_random_bleu_pairs(spark, sf):
    """PIP2 with BLEU: a round of the random baseline on pairs, its losses, and BLEU of its model on the test pairs."""
    st = _pair_selection_run(spark, sf, 1, "random").stats_df(spark)
    return st.select("round", "n_window", "n_accepted", "total_samples", F.round("best_valid_loss", 6).alias("best_valid_loss"),
                     F.round("test_loss", 6).alias("test_loss"), F.round("test_bleu", 6).alias("test_bleu"))


def q_run_compare_selection_docs(spark, sf):
    """PIP3 on the two real runs: the selection run against the random run, round by round."""
    runs = {kind: _selection_run(spark, sf, kind).stats_df(spark).withColumn("run_id", F.lit(kind)) for kind in ("loss", "random")}
    c = report.compare_runs(runs["loss"].unionByName(runs["random"]), "loss", "random")
    return c.select("round", F.round("loss_delta", 6).alias("loss_delta"), F.round("loss_delta_pct", 6).alias("loss_delta_pct"), "samples")


REGISTRY: dict[str, Query] = {
    "select_round0_docs": q_select_round0_docs,
    "tokenize_nds_docs": q_tokenize_nds_docs,
    "tokenize_de_docs": q_tokenize_de_docs,
    "length_filter_requests": q_length_filter_requests,
    "vocab_trusted": q_vocab_trusted,
    "conversation_pairs": q_conversation_pairs,
    "leak_matches": q_leak_matches,
    "leak_free_lines": q_leak_free_lines,
    "leak_probe_docs": q_leak_probe_docs,
    "split_trusted_docs": q_split_trusted_docs,
    "split_sizes_docs": q_split_sizes_docs,
    "sample_requests": q_sample_requests,
    "random_round0_docs": q_random_round0_docs,
    "window_quantile_docs": q_window_quantile_docs,
    "pair_batches": q_pair_batches,
    "batch_loss_pairs": q_batch_loss_pairs,
    "bigram_scores_pairs": q_bigram_scores_pairs,
    "run_new_samples_events": q_run_new_samples_events,
    "run_shares_events": q_run_shares_events,
    "run_compare_events": q_run_compare_events,
    "ibm1_scores_pairs": q_ibm1_scores_pairs,
    "ibm1_best_pairs": q_ibm1_best_pairs,
    "ibm1_best_iteration_pairs": q_ibm1_best_iteration_pairs,
    "translate_requests": q_translate_requests,
    "bleu_tokens_pairs": q_bleu_tokens_pairs,
    "bleu_chars_pairs": q_bleu_chars_pairs,
    "bpe_pair_counts_trusted": q_bpe_pair_counts_trusted,
    "bpe_vocab_trusted": q_bpe_vocab_trusted,
    "subword_roundtrip_requests": q_subword_roundtrip_requests,
    "spelling_normalise_candidates": q_spelling_normalise_candidates,
    "spelling_share_candidates": q_spelling_share_candidates,
    "autocorrect_requests": q_autocorrect_requests,
    "selection_rounds_docs": q_selection_rounds_docs,
    "selection_stats_docs": q_selection_stats_docs,
    "random_rounds_docs": q_random_rounds_docs,
    "selection_full_docs": q_selection_full_docs,
    "selection_full_stats_docs": q_selection_full_stats_docs,
    "selection_rounds_pairs": q_selection_rounds_pairs,
    "selection_stats_pairs": q_selection_stats_pairs,
    "csv_roundtrip_pairs": q_csv_roundtrip_pairs,
    "tsv_positional_pairs": q_tsv_positional_pairs,
    "text_export_trusted": q_text_export_trusted,
    "loss_summary_docs": q_loss_summary_docs,
    "shuffle_reindex_pairs": q_shuffle_reindex_pairs,
    "corpus_assembly_pairs": q_corpus_assembly_pairs,
    "head_candidates_docs": q_head_candidates_docs,
    "window_example_docs": q_window_example_docs,
    "length_limit_pairs": q_length_limit_pairs,
    "numericalize_pairs": q_numericalize_pairs,
    "stream_translate_requests": q_stream_translate_requests,
    "unigram_vocab_trusted": q_unigram_vocab_trusted,
    "unigram_roundtrip_requests": q_unigram_roundtrip_requests,
    "subword_ends_requests": q_subword_ends_requests,
    "user_scorer_rounds_docs": q_user_scorer_rounds_docs,
    "foreign_tokens_docs": q_foreign_tokens_docs,
    "padded_batches_pairs": q_padded_batches_pairs,
    "tsv_pairs": q_tsv_pairs,
    "sides_by_position_pairs": q_sides_by_position_pairs,
    "snapshot_docs": q_snapshot_docs,
    "translations_sink_requests": q_translations_sink_requests,
    "saved_vocab_trusted": q_saved_vocab_trusted,
    "elapsed_events": q_elapsed_events,
    "random_bleu_pairs": q_random_bleu_pairs,
    "run_compare_selection_docs": q_run_compare_selection_docs,
}
