from corpusforge.operators import normalise


def lev1(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    s, t = (a, b) if len(a) < len(b) else (b, a)
    return any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def test_case_variants_and_normalise(spark):
    counts = spark.createDataFrame([("Hus", 5), ("hus", 2), ("HUS", 2), ("dat", 3)], "token string, freq long")
    d = {r["variant"]: r["preferred"] for r in normalise.case_variants(counts).collect()}
    assert d == {"hus": "Hus", "HUS": "Hus"}
    docs = spark.createDataFrame([(1, ["dat", "hus", "is", "HUS"]), (2, [])], "k long, t array<string>")
    out = {r["k"]: r for r in normalise.normalise_tokens(docs, ["k"], "t", normalise.case_variants(counts)).collect()}
    assert out[1]["normalised"] == ["dat", "Hus", "is", "Hus"] and out[1]["n_changed"] == 2
    assert out[2]["normalised"] == [] and out[2]["n_tokens"] == 0


def test_autocorrect_matches_brute_force(spark):
    vocab = [("hett", 9), ("het", 4), ("huus", 3), ("hus", 7), ("ö", 2), ("a", 5), ("ab", 1), ("ba", 1)]
    tokens = ["hbtt", "hettt", "hus", "hs", "o", "b", "aba", "xyz", "huss"]
    v = spark.createDataFrame(vocab, "token string, freq long")
    t = spark.createDataFrame([(x,) for x in tokens], "token string")
    got = {r["token"]: (r["correction"], r["freq"]) for r in normalise.autocorrect(t, v).collect()}
    want = {}
    vd = dict(vocab)
    for x in tokens:
        if x in vd:
            continue
        c = [(w, f) for w, f in vocab if lev1(x, w)]
        if c:
            want[x] = sorted(c, key=lambda wf: (-wf[1], wf[0]))[0]
    assert got == want


def test_tokens_are_made_once_for_their_counts(spark):
    from corpusforge.functions import text as T
    from corpusforge.operators import vocab

    docs = spark.createDataFrame([("Een twee, een",), (None,), ("",)], "text string")
    counts = vocab.token_counts(docs.select(T.tokenize_nds("text").alias("t")), "t")
    assert {r["token"]: r["freq"] for r in counts.collect()} == {"Een": 1, "twee": 1, ",": 1, "een": 1}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    lists = spark.createDataFrame([(["a", None, "a"],), ([],), (None,)], "t array<string>")
    assert {r["token"]: r["freq"] for r in vocab.token_counts(lists, "t").collect()} == {"a": 2, None: 1}


def test_changed_words_are_counted_in_place_and_by_join(spark):
    from corpusforge.operators import normalise

    rows = [(1, ["A", "b", None, "a", "A"]), (2, []), (3, None), (4, [None, "x"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    dictionary = spark.createDataFrame([("A", "a"), ("q", "Q")], "variant string, preferred string")
    want = {1: (["a", "b", "a", "a"], 4, 2), 2: ([], 0, 0), 3: ([], 0, 0), 4: (["x"], 1, 0)}
    for limit in (None, "0"):
        if limit:
            spark.conf.set("corpusforge.broadcast.maxBytes", limit)
        try:
            out = normalise.normalise_tokens(df, ["k"], "t", dictionary)
            assert {r["k"]: (r["normalised"], r["n_tokens"], r["n_changed"]) for r in out.collect()} == want
            assert limit or "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("corpusforge.broadcast.maxBytes")
