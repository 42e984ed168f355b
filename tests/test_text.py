from pyspark.sql import functions as F

from corpusforge.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("r")).first()["r"]


def test_tokenize_nds_fixture(spark):
    assert one(spark, T.tokenize_nds, "'tis (foo) a-b 100%") == ["'tis", "(foo", ")", "a", "-b", "100", "%"]
    assert one(spark, T.tokenize_nds, "Hallo Welt.") == ["Hallo", "Welt", "."]
    assert one(spark, T.tokenize_nds, "") == []


def test_tokenize_nds_lower(spark):
    assert one(spark, lambda c: T.tokenize_nds(c, lower=True), "Se Wüllt.") == ["se", "wüllt", "."]


def test_tokenize_de_fixture(spark):
    got = one(spark, T.tokenize_de, 'Er hat\'s gesagt: "Übermorgen 3,5 km!" (e-mail)')
    assert got == ["Er", "hat's", "gesagt", ":", '"', "Übermorgen", "3", ",", "5", "km", "!", '"', "(",
                   "e-mail", ")"]


def test_word_count_fixture(spark):
    assert one(spark, T.word_count, "Hallo Welt.") == 3
    assert one(spark, T.word_count, "") == 1
    assert one(spark, T.word_count, "e-mail ist gut, ja?") == 5


def test_arrays(spark):
    df = spark.createDataFrame([(["a", "b"],)], "t array<string>")
    r = df.select(T.add_specials("t").alias("s"), T.drop_last("t").alias("l"), T.drop_first("t").alias("f"),
                  T.pad_to("t", F.lit(4), "<pad>").alias("p"), T.join_tokens("t").alias("j")).first()
    assert r["s"] == ["<sos>", "a", "b", "<eos>"]
    assert r["l"] == ["a"] and r["f"] == ["b"]
    assert r["p"] == ["a", "b", "<pad>", "<pad>"]
    assert r["j"] == "a b"
    ids = spark.createDataFrame([([5, 6],), ([1, 5, 2],)], "i array<int>")
    got = [x["o"] for x in ids.select(T.add_specials_if_missing("i").alias("o")).collect()]
    assert got == [[1, 5, 6, 2], [1, 5, 2]]


def test_elapsed(spark):
    r = spark.createDataFrame([(125.9,)], "e double").select(
        T.elapsed_minutes("e").alias("m"), T.elapsed_seconds("e").alias("s")).first()
    assert (r["m"], r["s"]) == (2, 5)
