"""Independent SQL (DuckDB dialect) for every registered query.

Written from the operator definitions, not from the Spark code: plain window
functions and ``quantile_cont`` where the Spark side uses distributed order
statistics.  Regular expressions are the same fixed values as in
``corpusforge.functions.text``.
"""

from __future__ import annotations

from corpusforge.functions.text import DE_TOKEN, LENGTH_SPLIT, NDS_PUNCT, WHITESPACE


def _q(s: str) -> str:
    return s.replace("'", "''")


def tok_nds(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace({x}, '{_q(NDS_PUNCT)}', ' \\1', 'g'), "
            f"'{_q(WHITESPACE)}'), lambda t: length(t) > 0)")


def tok_de(x: str) -> str:
    return f"regexp_extract_all({x}, '{_q(DE_TOKEN)}', 0)"


def word_count(x: str) -> str:
    return f"len(regexp_split_to_array({x}, '{_q(LENGTH_SPLIT)}'))"


TRUSTED_DOCS = """
  SELECT d.doc_id, d.text FROM documents d
  WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)"""
CANDIDATE_DOCS = """
  SELECT d.doc_id, d.text FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
PAIRS = """
  SELECT 'conversations' AS source, printf('%d:%06d', u.conv_id, u.turn) AS pair_id,
         u.conv_id AS pos, u.text AS deu, a.text AS nds
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""
DOC_LINES = """
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents"""
TEST_LINES = """
  SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM benchmark"""


def unigram_round0(trusted: str, cands: str, window: int, q: float = 0.25) -> str:
    return f"""
WITH tr AS (SELECT {tok_nds('text')} AS toks FROM ({trusted})),
     cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(toks) AS tok FROM tr) GROUP BY tok),
     m AS (SELECT sum(c) + count(*) + 1 AS den FROM cnt),
     win AS (SELECT doc_id, {tok_nds('text')} AS toks FROM ({cands})
             QUALIFY row_number() OVER (ORDER BY doc_id) <= {window}),
     ex AS (SELECT doc_id, unnest(toks) AS tok FROM win),
     sc AS (SELECT ex.doc_id, round(avg(-ln((coalesce(cnt.c, 0) + 1) / m.den)), 6) AS loss
            FROM ex LEFT JOIN cnt ON ex.tok = cnt.tok CROSS JOIN m GROUP BY ex.doc_id),
     thr AS (SELECT quantile_cont(loss, {q}) AS t FROM sc)
SELECT sc.doc_id AS pair_id, sc.loss FROM sc, thr WHERE sc.loss <= thr.t"""


def hash_rank(hash_expr: str) -> str:
    return f"('0x' || substr({hash_expr}, 1, 15))::BIGINT, {hash_expr}"


TRUSTED_CONV = f"""
  SELECT conv_id FROM (
    SELECT conv_id, row_number() OVER (ORDER BY {hash_rank("md5('1234:trusted:' || conv_id)")}, conv_id) AS rn,
           count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL))
  WHERE rn <= ceil(0.25e0 * n)"""
TRUSTED_COND = f"pos IN (SELECT conv_id FROM ({TRUSTED_CONV}))"
CANDIDATE_COND = f"pos NOT IN (SELECT conv_id FROM ({TRUSTED_CONV}))"


PAIR_TOKENS = f"""
  SELECT *, {tok_de('deu')} AS src, {tok_nds('nds')} AS tokens FROM ({PAIRS})"""
EVENT_STATS = """
  WITH ev AS (SELECT event_type AS run_id,
                     date_diff('day', (SELECT min(ts::DATE) FROM events), ts::DATE)::INTEGER AS round, value
              FROM events),
       d AS (SELECT run_id, round, count(*) AS n, avg(value) AS test_loss FROM ev GROUP BY ALL)
  SELECT *, (sum(n) OVER (PARTITION BY run_id ORDER BY round
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS total_samples FROM d"""
NEW_SAMPLES = f"""
  SELECT *, total_samples - lag(total_samples) OVER (PARTITION BY run_id ORDER BY round) AS new_samples
  FROM ({EVENT_STATS})"""


def ibm1_cells(name: str, where: str) -> str:
    return f"""
     {name}_seq AS (SELECT pair_id, ['<sos>'] || src || ['<eos>'] AS s, tokens || ['<eos>'] AS t
                    FROM p WHERE {where}),
     {name}_se AS (SELECT pair_id, l, e, count(*)::DOUBLE AS ce
                   FROM (SELECT pair_id, len(s) AS l, unnest(s) AS e FROM {name}_seq) GROUP BY ALL),
     {name}_tf AS (SELECT pair_id, f, count(*)::DOUBLE AS cf
                   FROM (SELECT pair_id, unnest(t) AS f FROM {name}_seq) GROUP BY ALL),
     {name} AS (SELECT a.pair_id, l, e, f, ce, cf FROM {name}_se a JOIN {name}_tf b ON a.pair_id = b.pair_id)"""


IBM1 = f"""
WITH p AS ({PAIR_TOKENS}),
     {ibm1_cells('cells', TRUSTED_COND)},
     x1 AS (SELECT e, f, cf * ce / sum(ce) OVER (PARTITION BY pair_id, f) AS x FROM cells),
     c1 AS (SELECT e, f, sum(x) AS c FROM x1 WHERE x > 0 GROUP BY e, f),
     t1 AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM c1),
     w2 AS (SELECT cells.pair_id, cells.e, cells.f, cf, ce * coalesce(t1.t, 0) AS w
            FROM cells LEFT JOIN t1 ON cells.e = t1.e AND cells.f = t1.f),
     x2 AS (SELECT e, f, cf * w / sum(w) OVER (PARTITION BY pair_id, f) AS x FROM w2),
     c2 AS (SELECT e, f, sum(x) AS c FROM x2 WHERE x > 0 GROUP BY e, f),
     t2 AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM c2),
     v AS (SELECT count(DISTINCT f) AS v FROM cells_tf),
     best AS (SELECT e, f AS best FROM t2 WHERE f <> '<eos>'
              QUALIFY row_number() OVER (PARTITION BY e ORDER BY round(t, 12) DESC, f ASC) = 1)"""


def translate_sql(table: str, key: str, toks: str) -> str:
    return f"""
     tx_ex AS (SELECT {key} AS k, generate_subscripts({toks}, 1) AS p, unnest({toks}) AS e FROM {table}),
     tx_w AS (SELECT tx_ex.k, tx_ex.p, coalesce(best.best, tx_ex.e) AS w FROM tx_ex LEFT JOIN best ON tx_ex.e = best.e),
     tx_l AS (SELECT k, list(w ORDER BY p) AS l FROM tx_w GROUP BY k),
     tx AS (SELECT t.{key} AS k, coalesce(tx_l.l, []::VARCHAR[]) AS hyp
            FROM {table} t LEFT JOIN tx_l ON t.{key} = tx_l.k)"""


def bleu_sql(src: str) -> str:
    """``src`` has columns (k, hyp VARCHAR[], ref VARCHAR[])."""
    def grams(col):
        return f"""
        SELECT k, n, g, count(*) AS c FROM (
          SELECT k, n, unnest(list_transform(range(1, len({col}) - n + 2),
                                             lambda i: array_to_string({col}[i:i + n - 1], chr(1)))) AS g
          FROM ({src}) s, range(1, 5) r(n) WHERE len({col}) >= n) GROUP BY ALL"""
    return f"""
WITH hg AS ({grams('hyp')}), rg AS ({grams('ref')}),
     pn AS (SELECT hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS m, sum(hg.c) AS t
            FROM hg LEFT JOIN rg ON hg.k = rg.k AND hg.n = rg.n AND hg.g = rg.g GROUP BY hg.n),
     w AS (SELECT coalesce(max(CASE WHEN n = 1 THEN m END), 0)::BIGINT AS m1,
                  coalesce(max(CASE WHEN n = 2 THEN m END), 0)::BIGINT AS m2,
                  coalesce(max(CASE WHEN n = 3 THEN m END), 0)::BIGINT AS m3,
                  coalesce(max(CASE WHEN n = 4 THEN m END), 0)::BIGINT AS m4,
                  coalesce(max(CASE WHEN n = 1 THEN t END), 0)::BIGINT AS t1,
                  coalesce(max(CASE WHEN n = 2 THEN t END), 0)::BIGINT AS t2,
                  coalesce(max(CASE WHEN n = 3 THEN t END), 0)::BIGINT AS t3,
                  coalesce(max(CASE WHEN n = 4 THEN t END), 0)::BIGINT AS t4 FROM pn),
     l AS (SELECT sum(len(hyp))::BIGINT AS hyp_len, sum(len(ref))::BIGINT AS ref_len FROM ({src})),
     b AS (SELECT *, CASE WHEN hyp_len > ref_len THEN 1.0e0 WHEN hyp_len = 0 THEN 0.0e0
                          ELSE exp(1 - ref_len / hyp_len) END AS bp FROM w, l)
SELECT round(CASE WHEN m1 = 0 OR m2 = 0 OR m3 = 0 OR m4 = 0 THEN 0.0e0
                  ELSE bp * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4) END, 6) AS bleu,
       round(bp, 6) AS bp, hyp_len, ref_len, m1, m2, m3, m4, t1, t2, t3, t4 FROM b"""


CAND_TRANSLATIONS = f"""{IBM1},
     cand AS (SELECT * FROM p WHERE {CANDIDATE_COND}),
     {translate_sql('cand', 'pair_id', 'src')}
SELECT cand.pair_id AS k, cand.nds, tx.hyp, cand.tokens AS ref FROM cand JOIN tx ON cand.pair_id = tx.k"""


WORDS = f"""
  SELECT '▁' || x AS word, count(*) AS freq
  FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '{_q(WHITESPACE)}'), lambda y: length(y) > 0)) AS x
        FROM ({TRUSTED_DOCS})) GROUP BY 1"""
SPELLING = f"""
     tr AS (SELECT {tok_nds('text')} AS toks FROM ({TRUSTED_DOCS})),
     cnt AS (SELECT tok AS token, count(*) AS freq FROM (SELECT unnest(toks) AS tok FROM tr) GROUP BY tok),
     pref AS (SELECT lower(token) AS k, token AS preferred FROM cnt
              QUALIFY row_number() OVER (PARTITION BY lower(token) ORDER BY freq DESC, token) = 1),
     dict AS (SELECT c.token AS variant, p.preferred FROM cnt c JOIN pref p ON lower(c.token) = p.k
              WHERE c.token <> p.preferred),
     ca AS (SELECT doc_id, {tok_nds('text')} AS toks FROM ({CANDIDATE_DOCS})),
     ex AS (SELECT doc_id, generate_subscripts(toks, 1) AS p, unnest(toks) AS token FROM ca),
     j AS (SELECT ex.doc_id, ex.p, coalesce(d.preferred, ex.token) AS w, (d.preferred IS NOT NULL)::INT AS chg
           FROM ex LEFT JOIN dict d ON ex.token = d.variant),
     agg AS (SELECT doc_id, list(w ORDER BY p) AS l, count(*) AS n_tokens, sum(chg)::BIGINT AS n_changed
             FROM j GROUP BY doc_id),
     norm AS (SELECT ca.doc_id, coalesce(agg.n_tokens, 0) AS n_tokens, coalesce(agg.n_changed, 0) AS n_changed,
                     coalesce(array_to_string(agg.l, ' '), '') AS text FROM ca LEFT JOIN agg ON ca.doc_id = agg.doc_id)"""


def _score_cte(name: str, train: str, rows: str) -> str:
    """Unigram add-one loss of ``rows`` (source, pair_id, text) under a model of ``train``."""
    return f"""
     {name}_cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest({tok_nds('text')}) AS tok FROM {train}) GROUP BY tok),
     {name}_den AS (SELECT sum(c) + count(*) + 1 AS den FROM {name}_cnt),
     {name}_ex AS (SELECT source, pair_id, unnest({tok_nds('text')}) AS tok FROM {rows}),
     {name}_tok AS (SELECT e.source, e.pair_id, sum(-ln((coalesce(c.c, 0) + 1) / d.den)) AS s, count(*) AS n
                    FROM {name}_ex e LEFT JOIN {name}_cnt c ON e.tok = c.tok CROSS JOIN {name}_den d
                    GROUP BY e.source, e.pair_id),
     {name} AS (SELECT r.source, r.pair_id, t.s, t.n, round(t.s / t.n, 6) AS loss
                FROM {rows} r LEFT JOIN {name}_tok t ON r.source = t.source AND r.pair_id = t.pair_id)"""


def _pair_cells(name: str, rows: str) -> str:
    return f"""
     {name}_seq AS (SELECT source, pair_id, ['<sos>'] || src || ['<eos>'] AS s, tokens || ['<eos>'] AS t FROM {rows}),
     {name}_se AS (SELECT source, pair_id, l, e, count(*)::DOUBLE AS ce
                   FROM (SELECT source, pair_id, len(s) AS l, unnest(s) AS e FROM {name}_seq) GROUP BY ALL),
     {name}_tf AS (SELECT source, pair_id, f, count(*)::DOUBLE AS cf
                   FROM (SELECT source, pair_id, unnest(t) AS f FROM {name}_seq) GROUP BY ALL),
     {name}_cells AS (SELECT a.source, a.pair_id, l, e, f, ce, cf FROM {name}_se a JOIN {name}_tf b
                      ON a.source = b.source AND a.pair_id = b.pair_id)"""


def _ibm1_fit(name: str, train: str, iterations: int = 2) -> str:
    """EM steps on ``train``: defines ``{name}_t1`` .. ``{name}_t<iterations>`` and ``{name}_v``."""
    parts = [f"""{_pair_cells(name, train)},
     {name}_x1 AS (SELECT e, f, cf * ce / sum(ce) OVER (PARTITION BY source, pair_id, f) AS x FROM {name}_cells),
     {name}_c1 AS (SELECT e, f, sum(x) AS c FROM {name}_x1 WHERE x > 0 GROUP BY e, f),
     {name}_t1 AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM {name}_c1)"""]
    for i in range(2, iterations + 1):
        parts.append(f"""
     {name}_w{i} AS (SELECT c.source, c.pair_id, c.e, c.f, c.cf, c.ce * coalesce(p.t, 0) AS w
                   FROM {name}_cells c LEFT JOIN {name}_t{i - 1} p ON c.e = p.e AND c.f = p.f),
     {name}_x{i} AS (SELECT e, f, cf * w / sum(w) OVER (PARTITION BY source, pair_id, f) AS x FROM {name}_w{i}),
     {name}_c{i} AS (SELECT e, f, sum(x) AS c FROM {name}_x{i} WHERE x > 0 GROUP BY e, f),
     {name}_t{i} AS (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS t FROM {name}_c{i})""")
    parts.append(f"""
     {name}_v AS (SELECT count(DISTINCT f) AS v FROM {name}_tf)""")
    return ",".join(parts)


def _ibm1_score(name: str, model: str, rows: str, table: str = "t2") -> str:
    return f"""{_pair_cells(name, rows)},
     {name}_pf AS (SELECT c.source, c.pair_id, c.f, c.cf, c.l, sum(c.ce * coalesce(m.t, 0)) AS s
                   FROM {name}_cells c LEFT JOIN {model}_{table} m ON c.e = m.e AND c.f = m.f
                   GROUP BY c.source, c.pair_id, c.f, c.cf, c.l),
     {name}_sc AS (SELECT source, pair_id, sum(cf) AS n, sum(cf * -ln(0.9e0 * s / l + 0.1e0 / v.v)) AS s
                   FROM {name}_pf, {model}_v v GROUP BY source, pair_id),
     {name} AS (SELECT source, pair_id, s, n, round(s / n, 6) AS loss FROM {name}_sc)"""


NO_LEAK = "NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text IS NOT DISTINCT FROM d.text)"
NO_PAIR_LEAK = "NOT EXISTS (SELECT 1 FROM test t WHERE t.deu IS NOT DISTINCT FROM pt.deu AND t.nds IS NOT DISTINCT FROM pt.nds)"
DOC_INPUTS = f"""
     pool0 AS (SELECT 'documents' AS source, doc_id AS pair_id, doc_id AS pos, text FROM ({TRUSTED_DOCS}) d WHERE {NO_LEAK}),
     cand0 AS (SELECT 'documents' AS source, doc_id AS pair_id, doc_id AS pos, text FROM ({CANDIDATE_DOCS}) d WHERE {NO_LEAK}),
     test AS (SELECT 'benchmark' AS source, item_id AS pair_id, text FROM benchmark)"""
PAIR_INPUTS = f"""
     tl AS ({TEST_LINES}),
     test AS (SELECT 'benchmark' AS source, printf('%d:%06d', a.item_id, a.line_no) AS pair_id, a.line AS deu, b.line AS nds,
                     {tok_de('a.line')} AS src, {tok_nds('b.line')} AS tokens
              FROM tl a JOIN tl b ON a.item_id = b.item_id AND b.line_no = a.line_no + 1),
     pt AS ({PAIR_TOKENS}),
     pool0 AS (SELECT source, pair_id, pos, src, tokens FROM pt WHERE {TRUSTED_COND} AND {NO_PAIR_LEAK}),
     cand0 AS (SELECT source, pair_id, pos, src, tokens FROM pt WHERE {CANDIDATE_COND} AND {NO_PAIR_LEAK})"""


def best_iteration_sql(iterations: int = 3) -> str:
    """AGG7: validation loss after each EM step on the train split; first minimum wins."""
    h = "md5('1234:' || source || ':' || pair_id)"
    scores = ",".join(_ibm1_score(f"va{i}", "m", "valid", f"t{i}") for i in range(1, iterations + 1))
    hist = " UNION ALL ".join(f"SELECT {i} AS iteration, (SELECT sum(s) / sum(n) FROM va{i}) AS l"
                              for i in range(1, iterations + 1))
    return (f"WITH {PAIR_INPUTS},\n"
            f"     split AS (SELECT *, row_number() OVER (ORDER BY {hash_rank(h)}, source, pair_id) AS rn,\n"
            f"                      count(*) OVER () AS n FROM pool0),\n"
            f"     train AS (SELECT source, pair_id, src, tokens FROM split WHERE rn > ceil(0.1e0 * n)),\n"
            f"     valid AS (SELECT source, pair_id, src, tokens FROM split WHERE rn <= ceil(0.1e0 * n)),\n"
            f"     {_ibm1_fit('m', 'train', iterations)},\n"
            f"     {scores},\n"
            f"     hist AS ({hist}),\n"
            f"     best AS (SELECT min(iteration) AS it FROM hist WHERE l = (SELECT min(l) FROM hist))\n"
            f"SELECT iteration, round(l, 6) AS valid_loss, iteration = (SELECT it FROM best) AS is_best FROM hist")


def _batched(name: str, rows: str, length: str) -> str:
    """Batches of 64 rows of similar length."""
    return f"""
     {name} AS (SELECT source, pair_id, (row_number() OVER (ORDER BY coalesce({length}, 0), source, pair_id) - 1) // 64 AS b FROM {rows})"""


def _batch_loss(scored: str, batches: str) -> str:
    """AGG6: mean over batches of the batches' token-weighted means."""
    return (f"(SELECT round(avg(s / n), 6) FROM (SELECT sum(s) AS s, sum(n) AS n FROM {scored} JOIN {batches} USING (source, pair_id) "
            f"WHERE n > 0 GROUP BY b))")


def selection_sql(rounds: int, strategy: str, kind: str = "docs", iterations: int = 2) -> str:
    """Chained selection rounds; a pair model is the EM iteration with the smallest validation loss, the first of ties."""
    cols = "source, pair_id, pos, text" if kind == "docs" else "source, pair_id, pos, src, tokens"
    length = f"len({tok_nds('text')})" if kind == "docs" else "len(src)"
    ctes = [DOC_INPUTS if kind == "docs" else PAIR_INPUTS, _batched("tb", "test", length)]
    outs = []
    for i in range(rounds):
        size = 500 * 2 ** i + 1
        h = f"md5('1234:{i}:' || source || ':' || pair_id)"
        if kind == "docs":
            scores = f"""{_score_cte(f'sc{i}', f'train{i}', f'win{i}')},
     {_score_cte(f'va{i}', f'train{i}', f'valid{i}')},
     {_score_cte(f'te{i}', f'train{i}', 'test')}"""
        else:
            tried = ",".join(_ibm1_score(f"va{i}_{k}", f"m{i}", f"valid{i}", f"t{k}") for k in range(1, iterations + 1))
            hist = " UNION ALL ".join(f"SELECT {k} AS k, {_batch_loss(f'va{i}_{k}', f'vb{i}')} AS l" for k in range(1, iterations + 1))
            best = " UNION ALL ".join(f"SELECT * FROM m{i}_t{k} WHERE (SELECT k FROM it{i}) = {k}" for k in range(1, iterations + 1))
            scores = f"""{_ibm1_fit(f'm{i}', f'train{i}', iterations)},
     {tried},
     hist{i} AS ({hist}),
     it{i} AS (SELECT min(k) AS k FROM hist{i} WHERE l = (SELECT min(l) FROM hist{i})),
     m{i}_best AS ({best}),
     {_ibm1_score(f'sc{i}', f'm{i}', f'win{i}', 'best')},
     {_ibm1_score(f'va{i}', f'm{i}', f'valid{i}', 'best')},
     {_ibm1_score(f'te{i}', f'm{i}', 'test', 'best')}"""
        ctes.append(f"""
     split{i} AS (SELECT *, row_number() OVER (ORDER BY {hash_rank(h)}, source, pair_id) AS rn,
                         count(*) OVER () AS n FROM pool{i}),
     train{i} AS (SELECT {cols} FROM split{i} WHERE rn > ceil(0.1e0 * n)),
     valid{i} AS (SELECT {cols} FROM split{i} WHERE rn <= ceil(0.1e0 * n)),
     {_batched(f"vb{i}", f"valid{i}", length)},
     win{i} AS (SELECT * FROM cand{i} QUALIFY row_number() OVER (ORDER BY pos, source, pair_id) <= {size}),
     {scores},
     q{i} AS (SELECT quantile_cont(loss, 0.25) AS q FROM sc{i})""")
        if strategy == "loss":
            ctes.append(f"""
     acc{i} AS (SELECT s.source, s.pair_id, s.loss FROM sc{i} s, q{i} WHERE s.loss <= q{i}.q)""")
        else:
            hp = f"md5('1234:pick{i}:' || source || ':' || pair_id)"
            ctes.append(f"""
     acc{i} AS (SELECT source, pair_id, loss FROM sc{i}
                QUALIFY row_number() OVER (ORDER BY {hash_rank(hp)}, source, pair_id)
                        <= (SELECT floor(0.25e0 * count(*)) FROM sc{i}))""")
        ctes.append(f"""
     pool{i + 1} AS (SELECT {cols} FROM pool{i}
                     UNION ALL SELECT w.* FROM win{i} w
                     WHERE EXISTS (SELECT 1 FROM acc{i} a WHERE a.source = w.source AND a.pair_id = w.pair_id)),
     cand{i + 1} AS (SELECT * FROM cand{i} c
                     WHERE NOT EXISTS (SELECT 1 FROM acc{i} a WHERE a.source = c.source AND a.pair_id = c.pair_id)),
     stats{i} AS (SELECT {i} AS round, (SELECT count(*) FROM win{i}) AS n_window,
                         (SELECT count(*) FROM acc{i}) AS n_accepted,
                         ((ceil((SELECT count(*) FROM train{i}) / 64) + ceil((SELECT count(*) FROM valid{i}) / 64))
                           * 64)::BIGINT AS total_samples,
                         {'round((SELECT q FROM q' + str(i) + '), 6)' if strategy == 'loss' else 'NULL::DOUBLE'} AS quantile,
                         {_batch_loss(f'va{i}', f'vb{i}')} AS best_valid_loss,
                         {_batch_loss(f'te{i}', 'tb')} AS test_loss,
                         round((SELECT sum(round(loss * 1e6)::BIGINT) / count(loss) / 1e6 FROM sc{i}), 6)
                           AS residual_loss,
                         round(exp({_batch_loss(f'va{i}', f'vb{i}')}), 6) AS valid_ppl,
                         round(exp({_batch_loss(f'te{i}', 'tb')}), 6) AS test_ppl)""")
        outs.append(i)
    acc = " UNION ALL ".join(f"SELECT {i} AS round, pair_id, loss FROM acc{i}" for i in outs)
    stats = " UNION ALL ".join(f"SELECT * FROM stats{i}" for i in outs)
    return "WITH " + ",".join(ctes) + f"\n, accepted AS ({acc}), round_stats AS ({stats})\n"


def user_scorer_sql(rounds: int) -> str:
    """The selection loop where a text's loss is the mean length of its tokens; no test set."""
    ctes = [f"""
     cand0 AS (SELECT 'documents' AS source, doc_id AS pair_id, doc_id AS pos, text FROM ({CANDIDATE_DOCS}))"""]
    for i in range(rounds):
        ctes.append(f"""
     win{i} AS (SELECT * FROM cand{i} QUALIFY row_number() OVER (ORDER BY pos, source, pair_id) <= {500 * 2 ** i + 1}),
     sc{i} AS (SELECT pair_id, round(s / n, 6) AS loss FROM (SELECT pair_id, len(t) AS n, list_sum(list_transform(t, lambda x: length(x)))::DOUBLE AS s
               FROM (SELECT pair_id, {tok_nds('text')} AS t FROM win{i})) WHERE n > 0),
     acc{i} AS (SELECT pair_id, loss FROM sc{i} WHERE loss <= (SELECT quantile_cont(loss, 0.25) FROM sc{i})),
     cand{i + 1} AS (SELECT * FROM cand{i} WHERE pair_id NOT IN (SELECT pair_id FROM acc{i}))""")
    return "WITH " + ",".join(ctes) + "\n" + " UNION ALL ".join(f"SELECT {i} AS round, pair_id, loss FROM acc{i}" for i in range(rounds))


def random_bleu_sql() -> str:
    """One round of the random baseline on pairs, with BLEU of its model's word-by-word translations of the test pairs."""
    hyps = f"""SELECT test.pair_id AS k, tx.hyp, test.tokens AS ref FROM test JOIN tx ON test.pair_id = tx.k"""
    return f"""{selection_sql(1, 'random', 'pairs')},
     best AS (SELECT e, f AS best FROM m0_best WHERE f <> '<eos>'
              QUALIFY row_number() OVER (PARTITION BY e ORDER BY round(t, 12) DESC, f ASC) = 1),
     {translate_sql('test', 'pair_id', 'src')}
SELECT round, n_window, n_accepted, total_samples, best_valid_loss, test_loss, (SELECT bleu FROM ({bleu_sql(hyps)})) AS test_bleu FROM round_stats"""


SQL: dict[str, str] = {
    "select_round0_docs": unigram_round0(TRUSTED_DOCS, CANDIDATE_DOCS, 501),
    "tokenize_nds_docs": f"""
SELECT doc_id, len(t)::INTEGER AS n_tok, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tok_nds('text')} AS t FROM documents)""",
    "tokenize_de_docs": f"""
SELECT doc_id, len(t)::INTEGER AS n_tok, array_to_string(t, ' ') AS tokens, array_to_string(tl, ' ') AS tokens_lower
FROM (SELECT doc_id, {tok_de('text')} AS t, {tok_de('lower(text)')} AS tl FROM documents)""",
    "length_filter_requests": f"""
SELECT printf('%d:%06d', conv_id, turn) AS sent_id, ({word_count('text')})::INTEGER AS n_parts
FROM conversations WHERE role = 'user' AND {word_count('text')} BETWEEN 1 AND 30""",
    "vocab_trusted": f"""
WITH tr AS (SELECT {tok_nds('text')} AS toks FROM ({TRUSTED_DOCS})),
     cnt AS (SELECT tok AS token, count(*) AS freq FROM (SELECT unnest(toks) AS tok FROM tr)
             WHERE tok NOT IN ('<unk>', '<pad>', '<sos>', '<eos>') GROUP BY tok)
SELECT token, NULL::BIGINT AS freq, id FROM (VALUES ('<unk>', 0), ('<pad>', 1), ('<sos>', 2), ('<eos>', 3)) s(token, id)
UNION ALL
SELECT token, freq, (3 + row_number() OVER (ORDER BY freq DESC, token ASC))::INTEGER AS id FROM cnt""",
    "conversation_pairs": PAIRS,
    "leak_matches": f"""
SELECT d.doc_id, count(*) AS n_matches
FROM ({DOC_LINES}) d JOIN (SELECT line FROM ({TEST_LINES})) t ON d.line = t.line
GROUP BY d.doc_id""",
    "leak_free_lines": f"""
SELECT d.doc_id, d.line_no::INTEGER AS line_no FROM ({DOC_LINES}) d
WHERE NOT EXISTS (SELECT 1 FROM ({TEST_LINES}) t WHERE t.line IS NOT DISTINCT FROM d.line)""",
    "split_trusted_docs": f"""
WITH t AS (SELECT doc_id, md5('1234:documents:' || doc_id) AS h FROM ({TRUSTED_DOCS})),
     r AS (SELECT doc_id, row_number() OVER (ORDER BY {hash_rank('h')}, doc_id) AS rn,
                  count(*) OVER () AS n FROM t)
SELECT doc_id AS pair_id, CASE WHEN rn <= ceil(0.1e0 * n) THEN 'valid' ELSE 'train' END AS split FROM r""",
    "split_sizes_docs": f"""
WITH n AS (SELECT count(*) AS n FROM ({TRUSTED_DOCS})),
     s AS (SELECT ceil(0.1e0 * n)::BIGINT AS n_valid, n - ceil(0.1e0 * n)::BIGINT AS n_train FROM n)
SELECT n_train, n_valid, ((ceil(n_train / 64) + ceil(n_valid / 64)) * 64)::BIGINT AS total_samples FROM s""",
    "sample_requests": f"""
WITH s AS (SELECT printf('%d:%06d', conv_id, turn) AS sent_id, text AS deu FROM conversations
           WHERE role = 'user' AND {word_count('text')} BETWEEN 1 AND 30),
     h AS (SELECT *, md5('42:' || sent_id) AS h FROM s)
SELECT sent_id, deu FROM h QUALIFY row_number() OVER (ORDER BY {hash_rank('h')}, sent_id) <= 50""",
    "random_round0_docs": f"""
WITH w AS (SELECT doc_id FROM ({CANDIDATE_DOCS}) QUALIFY row_number() OVER (ORDER BY doc_id) <= 501),
     h AS (SELECT doc_id, md5('1234:pick0:documents:' || doc_id) AS h FROM w)
SELECT doc_id AS pair_id FROM h
QUALIFY row_number() OVER (ORDER BY {hash_rank('h')}, doc_id) <= (SELECT floor(0.25e0 * count(*)) FROM w)""",
    "window_quantile_docs": f"""
WITH tr AS (SELECT {tok_nds('text')} AS toks FROM ({TRUSTED_DOCS})),
     cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(toks) AS tok FROM tr) GROUP BY tok),
     m AS (SELECT sum(c) + count(*) + 1 AS den FROM cnt),
     win AS (SELECT doc_id, {tok_nds('text')} AS toks FROM ({CANDIDATE_DOCS})
             QUALIFY row_number() OVER (ORDER BY doc_id) <= 501),
     ex AS (SELECT doc_id, unnest(toks) AS tok FROM win),
     sc AS (SELECT ex.doc_id, round(avg(-ln((coalesce(cnt.c, 0) + 1) / m.den)), 6) AS loss
            FROM ex LEFT JOIN cnt ON ex.tok = cnt.tok CROSS JOIN m GROUP BY ex.doc_id),
     allw AS (SELECT win.doc_id, sc.loss FROM win LEFT JOIN sc ON win.doc_id = sc.doc_id)
SELECT count(*) AS n_window, round(sum(round(loss * 1e6)::BIGINT) / count(loss) / 1e6, 6) AS residual_loss,
       max(doc_id) AS last_pair_id,
       round(quantile_cont(loss, 0.25), 6) AS quantile FROM allw""",
    "pair_batches": f"""
WITH p AS ({PAIR_TOKENS}),
     r AS (SELECT pair_id, len(src)::INTEGER AS batch_len,
                  (row_number() OVER (ORDER BY len(src), source, pair_id) - 1) // 64 AS batch_id FROM p)
SELECT pair_id, batch_id, batch_len, max(batch_len) OVER (PARTITION BY batch_id) + 2 AS width FROM r""",
    "batch_loss_pairs": f"""
WITH p AS ({PAIR_TOKENS}),
     tr AS (SELECT * FROM p WHERE {TRUSTED_COND}),
     cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(tokens) AS tok FROM tr) GROUP BY tok),
     m AS (SELECT sum(c) + count(*) + 1 AS den FROM cnt),
     ca AS (SELECT * FROM p WHERE {CANDIDATE_COND}),
     b AS (SELECT pair_id, (row_number() OVER (ORDER BY len(src), source, pair_id) - 1) // 64 AS batch_id FROM ca),
     ex AS (SELECT pair_id, unnest(tokens) AS tok FROM ca),
     sc AS (SELECT ex.pair_id, sum(-ln((coalesce(cnt.c, 0) + 1) / m.den)) AS s, count(*) AS n
            FROM ex LEFT JOIN cnt ON ex.tok = cnt.tok CROSS JOIN m GROUP BY ex.pair_id),
     pb AS (SELECT batch_id, sum(s) AS s, sum(n) AS n FROM sc JOIN b ON sc.pair_id = b.pair_id GROUP BY batch_id)
SELECT count(*) AS n_batches, round(avg(s / n), 6) AS split_loss, round(sum(s) / sum(n), 6) AS token_loss FROM pb""",
    "bigram_scores_pairs": f"""
WITH p AS ({PAIR_TOKENS}),
     seqs AS (SELECT pair_id, {TRUSTED_COND} AS trusted, ['<sos>'] || tokens || ['<eos>'] AS s FROM p),
     idx AS (SELECT pair_id, trusted, s, unnest(range(1, len(s))) AS i FROM seqs),
     bi AS (SELECT pair_id, trusted, s[i] AS prev, s[i + 1] AS token FROM idx),
     pc AS (SELECT prev, token, count(*) AS c FROM bi WHERE trusted GROUP BY prev, token),
     hc AS (SELECT prev, sum(c) AS h FROM pc GROUP BY prev),
     v AS (SELECT count(DISTINCT token) AS v FROM pc),
     sc AS (SELECT bi.pair_id, count(*) AS n_tok,
                   sum(-ln((coalesce(pc.c, 0) + 1) / (coalesce(hc.h, 0) + v.v + 1))) AS s
            FROM bi LEFT JOIN pc ON bi.prev = pc.prev AND bi.token = pc.token
                    LEFT JOIN hc ON bi.prev = hc.prev CROSS JOIN v
            WHERE NOT bi.trusted GROUP BY bi.pair_id)
SELECT pair_id, n_tok, round(s / n_tok, 6) AS loss FROM sc""",
    "run_new_samples_events": f"""
SELECT run_id, round, total_samples, new_samples FROM ({NEW_SAMPLES})""",
    "run_shares_events": f"""
WITH ns AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round) AS rn,
                   count(*) OVER (PARTITION BY run_id) AS cnt FROM ({NEW_SAMPLES}))
SELECT run_id,
       round_even(100 * sum(CASE WHEN rn <= 6 THEN new_samples END) / (SELECT count(*) FROM events), 0) AS pct_first,
       round_even(100 * sum(CASE WHEN rn < cnt THEN new_samples END) / (SELECT count(*) FROM events), 0)
         AS pct_all_but_last
FROM ns GROUP BY run_id""",
    "run_compare_events": f"""
WITH st AS ({EVENT_STATS}),
     m AS (SELECT round, test_loss AS m_loss, total_samples AS m_samples FROM st WHERE run_id = 'click'),
     b AS (SELECT round, test_loss AS b_loss FROM st WHERE run_id = 'view')
SELECT coalesce(m.round, b.round) AS round, round(m_loss - b_loss, 6) AS loss_delta,
       round(100 * (m_loss - b_loss) / b_loss, 6) AS loss_delta_pct, m_samples AS samples
FROM m FULL OUTER JOIN b ON m.round = b.round""",
    "ibm1_scores_pairs": f"""{IBM1},
     {ibm1_cells('sc_cells', CANDIDATE_COND)},
     pf AS (SELECT c.pair_id, c.f, c.cf, c.l, sum(c.ce * coalesce(t2.t, 0)) AS s
            FROM sc_cells c LEFT JOIN t2 ON c.e = t2.e AND c.f = t2.f GROUP BY c.pair_id, c.f, c.cf, c.l),
     sc AS (SELECT pair_id, sum(cf)::BIGINT AS n_tok, sum(cf * -ln(0.9e0 * s / l + 0.1e0 / v.v)) AS nll
            FROM pf, v GROUP BY pair_id)
SELECT pair_id, n_tok, round(nll / n_tok, 6) AS loss FROM sc""",
    "ibm1_best_pairs": f"""{IBM1}
SELECT e, best FROM best""",
    "stream_translate_requests": f"""{IBM1},
     rq AS (SELECT printf('%d:%06d', conv_id, turn) AS sent_id, {tok_de('text')} AS toks FROM conversations WHERE role = 'user'),
     {translate_sql('rq', 'sent_id', 'toks')}
SELECT k AS sent_id, array_to_string(hyp, ' ') AS ai_nds FROM tx""",
    "translate_requests": f"""{IBM1},
     rq AS (SELECT printf('%d:%06d', conv_id, turn) AS sent_id, {tok_de('text')} AS toks FROM conversations WHERE role = 'user'),
     {translate_sql('rq', 'sent_id', 'toks')}
SELECT k AS sent_id, array_to_string(hyp, ' ') AS ai_nds FROM tx""",
    "bleu_tokens_pairs": bleu_sql(f"SELECT k, hyp, ref FROM ({CAND_TRANSLATIONS})"),
    "bleu_chars_pairs": bleu_sql(
        "SELECT k, list_filter(string_split(array_to_string(hyp, ' '), ''), lambda x: length(x) > 0) AS hyp, "
        f"list_filter(string_split(nds, ''), lambda x: length(x) > 0) AS ref FROM ({CAND_TRANSLATIONS})"),
    "bpe_pair_counts_trusted": f"""
WITH w AS ({WORDS}),
     c AS (SELECT freq, list_filter(string_split(word, ''), lambda y: length(y) > 0) AS s FROM w),
     pr AS (SELECT freq, s[i] AS a, s[i + 1] AS b FROM (SELECT freq, s, unnest(range(1, len(s))) AS i FROM c))
SELECT a, b, sum(freq)::BIGINT AS n FROM pr GROUP BY a, b""",
    "subword_roundtrip_requests": f"""
WITH chars AS (SELECT DISTINCT unnest(list_filter(string_split(word, ''), lambda y: length(y) > 0)) AS ch
               FROM ({WORDS})),
     rq AS (SELECT printf('%d:%06d', conv_id, turn) AS sent_id, text FROM conversations WHERE role = 'user'),
     rc AS (SELECT sent_id, unnest(list_filter(string_split(
                     regexp_replace(text, '{_q(WHITESPACE)}', '', 'g'), ''), lambda y: length(y) > 0)) AS ch FROM rq),
     bad AS (SELECT DISTINCT sent_id FROM rc WHERE ch NOT IN (SELECT ch FROM chars))
SELECT sent_id, sent_id NOT IN (SELECT sent_id FROM bad) AS roundtrip_ok FROM rq""",
    "spelling_normalise_candidates": f"""
WITH {SPELLING}
SELECT doc_id, n_tokens, n_changed, text FROM norm""",
    "spelling_share_candidates": f"""
WITH {SPELLING}
SELECT sum(n_tokens)::BIGINT AS n_tokens, sum(n_changed)::BIGINT AS n_changed,
       round(sum(n_changed) / sum(n_tokens), 6) AS share_changed FROM norm""",
    "autocorrect_requests": f"""
WITH {SPELLING},
     rq AS (SELECT DISTINCT unnest({tok_nds('text')}) AS t FROM conversations WHERE role = 'user'),
     unk AS (SELECT t, string_split(t, '') AS tc FROM rq WHERE t NOT IN (SELECT token FROM cnt)),
     voc AS (SELECT token AS w, freq AS wf, string_split(token, '') AS wc FROM cnt),
     cand AS (SELECT t, tc, w, wf, wc FROM unk JOIN voc ON tc[1] = wc[1]
              UNION SELECT t, tc, w, wf, wc FROM unk JOIN voc ON tc[-1] = wc[-1]
              UNION SELECT t, tc, w, wf, wc FROM unk JOIN voc ON len(tc) = 1 AND len(wc) = 1),
     m AS (SELECT * FROM cand WHERE
             (len(tc) = len(wc) AND len(list_filter(range(1, len(tc) + 1), lambda i: tc[i] <> wc[i])) <= 1)
          OR (len(tc) = len(wc) + 1 AND len(list_filter(range(1, len(tc) + 1),
                lambda i: array_to_string(tc[1:i - 1] || tc[i + 1:len(tc)], '') = w)) > 0)
          OR (len(wc) = len(tc) + 1 AND len(list_filter(range(1, len(wc) + 1),
                lambda i: array_to_string(wc[1:i - 1] || wc[i + 1:len(wc)], '') = t)) > 0))
SELECT t AS token, w AS correction, wf AS freq FROM m
QUALIFY row_number() OVER (PARTITION BY t ORDER BY wf DESC, w) = 1""",
    "selection_rounds_docs": selection_sql(2, "loss") + "SELECT round, pair_id, loss FROM accepted",
    "loss_summary_docs": selection_sql(2, "loss") + """
SELECT c.pair_id, s0.loss AS r0, s1.loss AS r1 FROM cand0 c
LEFT JOIN sc0 s0 ON c.pair_id = s0.pair_id LEFT JOIN sc1 s1 ON c.pair_id = s1.pair_id""",
    "leak_probe_docs": f"""
WITH tl AS ({TEST_LINES}),
     pr AS (SELECT 1234 AS seed, line FROM tl
            QUALIFY row_number() OVER (ORDER BY {hash_rank("md5('1234:' || item_id || ':' || line_no)")}, item_id, line_no) = 1
            UNION ALL
            SELECT 42 AS seed, line FROM tl
            QUALIFY row_number() OVER (ORDER BY {hash_rank("md5('42:' || item_id || ':' || line_no)")}, item_id, line_no) = 1)
SELECT pr.seed, d.doc_id FROM pr JOIN documents d ON contains(d.text, pr.line)""",
    "csv_roundtrip_pairs": f"SELECT pair_id, deu, nds FROM ({PAIRS})",
    "tsv_positional_pairs": f"SELECT deu AS src, nds AS trg FROM ({PAIRS})",
    "text_export_trusted": f"SELECT unnest(string_split(text, chr(10))) AS line FROM ({TRUSTED_DOCS})",
    "shuffle_reindex_pairs": f"""
SELECT row_number() OVER (ORDER BY {hash_rank("md5('1234:' || source || ':' || pair_id)")}, source, pair_id) - 1
         AS idx, pair_id FROM ({PAIRS})""",
    "head_candidates_docs": f"SELECT doc_id AS pair_id FROM ({CANDIDATE_DOCS}) ORDER BY doc_id LIMIT 5",
    "window_example_docs": f"""
SELECT doc_id AS pair_id, len({tok_nds('text')})::INTEGER AS n_tok FROM ({CANDIDATE_DOCS}) ORDER BY doc_id LIMIT 1 OFFSET 8""",
    "length_limit_pairs": f"SELECT pair_id FROM ({PAIR_TOKENS}) WHERE len(src) + 2 <= 100 AND len(tokens) + 1 <= 100",
    "numericalize_pairs": f"""
WITH p AS ({PAIR_TOKENS}),
     cnt AS (SELECT tok AS token, count(*) AS freq FROM (SELECT unnest(tokens) AS tok FROM p WHERE {TRUSTED_COND})
             WHERE tok NOT IN ('<unk>', '<pad>', '<sos>', '<eos>') GROUP BY tok),
     voc AS (SELECT token, 3 + row_number() OVER (ORDER BY freq DESC, token ASC) AS id FROM cnt),
     ca AS (SELECT pair_id, tokens FROM p WHERE {CANDIDATE_COND}),
     ex AS (SELECT pair_id, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS token FROM ca),
     j AS (SELECT ex.pair_id, ex.i, coalesce(voc.id, 0) AS id, coalesce(voc.token, '<unk>') AS back
           FROM ex LEFT JOIN voc ON ex.token = voc.token)
SELECT ca.pair_id, coalesce(string_agg(id::VARCHAR, ' ' ORDER BY i), '') AS ids, coalesce(sum((id = 0)::INT), 0)::INTEGER AS n_unk,
       coalesce(string_agg(back, ' ' ORDER BY i), '') AS back FROM ca LEFT JOIN j ON j.pair_id = ca.pair_id GROUP BY ca.pair_id""",
    "selection_stats_docs": selection_sql(2, "loss") + "SELECT * FROM round_stats",
    "random_rounds_docs": selection_sql(2, "random") + "SELECT round, pair_id FROM accepted",
    "selection_full_docs": selection_sql(14, "loss") + "SELECT round, pair_id, loss FROM accepted",
    "selection_full_stats_docs": selection_sql(14, "loss") + "SELECT * FROM round_stats",
    "selection_rounds_pairs": selection_sql(2, "loss", "pairs") + "SELECT round, pair_id, loss FROM accepted",
    "selection_stats_pairs": selection_sql(2, "loss", "pairs") + "SELECT * FROM round_stats",
    "ibm1_best_iteration_pairs": best_iteration_sql(3),
    "unigram_roundtrip_requests": "SELECT printf('%d:%06d', conv_id, turn) AS sent_id, true AS roundtrip_ok FROM conversations WHERE role = 'user'",
    "subword_ends_requests": """
SELECT printf('%d:%06d', conv_id, turn) AS sent_id, 1 AS first_id, 2 AS last_id, 2 AS n_added, 0 AS n_added_again
FROM conversations WHERE role = 'user'""",
    "foreign_tokens_docs": f"""
SELECT doc_id, len(t)::INTEGER AS n_tok, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {tok_nds('text')} AS t FROM documents)""",
    "user_scorer_rounds_docs": user_scorer_sql(2),
    "padded_batches_pairs": f"""
WITH p AS ({PAIR_TOKENS}),
     cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(src) AS tok FROM p WHERE {TRUSTED_COND})
             WHERE tok NOT IN ('<unk>', '<pad>', '<sos>', '<eos>') GROUP BY tok),
     v AS (SELECT tok, 3 + row_number() OVER (ORDER BY c DESC, tok) AS id FROM cnt
           UNION ALL SELECT * FROM (VALUES ('<unk>', 0), ('<pad>', 1), ('<sos>', 2), ('<eos>', 3)) s(tok, id)),
     ex AS (SELECT source, pair_id, generate_subscripts(s, 1) AS i, unnest(s) AS tok
            FROM (SELECT source, pair_id, ['<sos>'] || src || ['<eos>'] AS s FROM p)),
     ids AS (SELECT source, pair_id, list(coalesce(v.id, 0) ORDER BY i) AS ids FROM ex LEFT JOIN v USING (tok) GROUP BY source, pair_id),
     b AS (SELECT pair_id, ids, (row_number() OVER (ORDER BY len(ids), source, pair_id) - 1) // 64 AS batch_id FROM ids),
     w AS (SELECT pair_id, batch_id, ids, max(len(ids)) OVER (PARTITION BY batch_id) AS w FROM b)
SELECT pair_id, batch_id, array_to_string(list_transform(range(w), lambda i: coalesce(ids[i + 1], 1)), ' ') AS padded,
       array_to_string(list_transform(range(w), lambda i: CASE WHEN i < len(ids) AND ids[i + 1] <> 1 THEN 1 ELSE 0 END), ' ') AS mask FROM w""",
    "tsv_pairs": f"SELECT pair_id, deu, nds FROM ({PAIRS})",
    "sides_by_position_pairs": f"SELECT deu, nds FROM ({PAIRS})",
    "snapshot_docs": f"SELECT 'a' AS run_id, 0 AS round, doc_id AS pair_id, text FROM ({TRUSTED_DOCS})",
    "elapsed_events": """
SELECT user_id, sum(floor(e / 60))::BIGINT AS mins, sum(floor(e - 60 * floor(e / 60)))::BIGINT AS secs
FROM (SELECT user_id, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id) AS e FROM events) GROUP BY user_id""",
    "random_bleu_pairs": random_bleu_sql(),
    "run_compare_selection_docs": f"""
WITH m AS (SELECT * FROM ({selection_sql(2, 'loss')} SELECT round, test_loss, total_samples FROM round_stats)),
     b AS (SELECT * FROM ({selection_sql(2, 'random')} SELECT round, test_loss FROM round_stats))
SELECT coalesce(m.round, b.round) AS round, round(m.test_loss - b.test_loss, 6) AS loss_delta,
       round(100 * (m.test_loss - b.test_loss) / b.test_loss, 6) AS loss_delta_pct, m.total_samples AS samples
FROM m FULL OUTER JOIN b ON m.round = b.round""",
}
SQL["translations_sink_requests"] = ("SELECT t.sent_id, c.text AS deu, t.ai_nds FROM (" + SQL["translate_requests"] + ") t JOIN conversations c "
                                     "ON printf('%d:%06d', c.conv_id, c.turn) = t.sent_id AND c.role = 'user'")
SQL["saved_vocab_trusted"] = SQL["vocab_trusted"]
