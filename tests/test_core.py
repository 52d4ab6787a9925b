"""Engine operators on hand-made rows."""

import math

from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import vectors as V
from topicloom.operators import topics, words


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, emb_hd array<double>, topic_idx int")


def test_vocab_needs_three_documents(spark):
    df = docs(spark, [(i, "alpha beta" if i < 2 else "alpha x1 the", [1.0], 0) for i in range(3)])
    assert [r.word for r in words.corpus_vocab(df, low=0.0, high=1.0).collect()] == ["alpha"]


def test_tfidf_by_hand(spark):
    df = docs(spark, [(0, "aa aa bb", [1.0], 0), (1, "aa cc", [1.0], 1), (2, "dd", [1.0], -1)])
    vocab = spark.createDataFrame([("aa",), ("bb",), ("cc",), ("dd",)], "word string")
    got = {(r.topic_idx, r.word): r.score for r in words.topwords_tfidf(words.word_topic_counts(df, vocab)).collect()}
    assert set(got) == {(0, "aa"), (0, "bb"), (1, "aa"), (1, "cc")}
    assert math.isclose(got[0, "aa"], 2 / 3 * math.log(2), abs_tol=1e-8) and math.isclose(got[0, "bb"], 1 / 3 * math.log(3), abs_tol=1e-8)


def test_combined_topic_is_last(spark):
    df = docs(spark, [(i, "a", [1.0], i - 1) for i in range(5)])
    got = {r.doc_id: r.topic_idx for r in topics.combine_topics(df, [0, 2]).collect()}
    assert got == {0: -1, 1: 2, 2: 0, 3: 2, 4: 1}


def test_add_topic_keeps_ties(spark):
    df = docs(spark, [(0, "a", [1.0, 0.0], 0), (1, "a", [1.0, 0.0], 0), (2, "a", [0.0, 1.0], 1)])
    got = {r.doc_id: r.topic_idx for r in topics.add_topic(df, F.array(F.lit(0.0), F.lit(1.0))).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_text_and_vector_functions(spark):
    r = spark.sql("SELECT 'abcde' t, 'The topic index is: -4' m, array(3.0D, 4.0D) v, array(0.0D, 0.0D) z").select(
        T.chunks(F.col("t"), 2).alias("c"), T.first_integer(F.col("m")).alias("i"), T.first_integer(F.col("t")).alias("none"),
        V.normalised(F.col("v")).alias("n"), V.cosine(F.col("v"), F.col("z")).alias("cos"),
    ).first()
    assert r.c == ["ab", "cd", "e"] and r.i == -4 and r.none is None and r.n == [0.6, 0.8] and r.cos is None
