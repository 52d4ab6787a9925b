"""Tokens found piece by piece against the rules on whole texts, and vocabulary counts by parts against counts by document."""

import random

from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import treebank
from topicloom.operators import words

ODD = list(".,:;\"'`()[]{}<>@#$%&?!-_\t\n\r\f \x85\x0b /é²ſKİ") + [" "] * 14 + list("AaBZs0d9mMtx") + ["cannot", "GOTTA", "lemme", "d'ye", "more'n", "'tis", "n't", "'ll", "'s ", "..", "--", "''", "J. R. R. ", "üb", ".) A", "kǅ "]
STOPS = [". ", "A", ".", " ", ")", '"', "'", "b", ",", ":", "Z. ", "\n"]


def texts(seed=5, n=2000):
    r = random.Random(seed)
    return ["".join(r.choice(ODD if k % 2 else STOPS) for _ in range(r.choice((1, 2, 4, 9, 20, 60)))) for k in range(n)]


def test_pieces_give_the_tokens_of_the_rules(spark):
    df = spark.createDataFrame(list(enumerate([None, "", " ", *texts()])), "k long, text string")
    want = {r.k: r.t for r in df.select("k", T.tokens(F.col("text")).alias("t")).collect()}
    assert {r.k: r.tokens for r in treebank.tokenised(df, "k").collect()} == want


def test_most_texts_need_no_rules_in_the_jvm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text <> ''")
    parts = treebank.vocabulary_parts(docs.withColumn("again", F.lit(False)))
    assert parts.filter("word is null").count() == 0


def test_counts_by_parts_equal_counts_by_document(spark, monkeypatch):
    monkeypatch.setattr(treebank, "MOST", 50)
    rows = [(k % 700 if k % 9 else None, x) for k, x in enumerate([*texts(6), "The Cat cat", "cat İcat", "CAT ſcat x1 Ünder"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").filter("text <> ''")
    for ids in (docs, docs.withColumn("doc_id", F.monotonically_increasing_id())):
        ids = spark.createDataFrame(ids.collect(), docs.schema)
        for filters in ({}, {"stop_words": ["cat"], "numbers": False, "short": False}):
            tokens = ids.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
            got, want = words.vocabulary_counts(ids, **filters), words.vocabulary_counts(tokens, **filters)
            assert got.schema.names == want.schema.names
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_piece_is_looked_up_once_however_often_it_occurs(monkeypatch):
    looked, at = [], treebank.Treebank._at
    monkeypatch.setattr(treebank.Treebank, "_at", lambda self, piece, *rest: looked.append(piece) or at(self, piece, *rest))
    monkeypatch.setattr(treebank.Treebank, "tokens", lambda self, text: 1 / 0)
    counts = treebank.WordCounts()
    for _ in range(3):
        assert counts.add(["Head (cat) dog.) cat--dog Cat, J. R. R. Tolkien cannot tail"] * 200) == []
    found = {w: (n, d) for w, n, d in zip(*counts.taken())}
    assert found == {w: (600 * k, 600) for w, k in {"head": 1, "cat": 3, "dog.": 1, "dog": 1, "tolkien": 1, "tail": 1}.items()}
    middle = [p for p in looked if p not in ("Head", "tail", "J.", "R.")]
    assert len(middle) == len(set(middle))


def test_counts_go_on_over_batches_and_texts_that_are_left(monkeypatch):
    monkeypatch.setattr(treebank, "MOST", 4)
    part, whole = treebank.WordCounts(), treebank.WordCounts(stop_words=False, short=False)
    assert part.add(["cat dog cat", None, "a\0b Ünder Über, ÉCOLE ÑÑÑ cat", "cat kǅlan dog", "", " "]) == [1, 3]
    assert part.add(["one-two " + "x,cat," * 30 + " Cat. The. End", "z"] * 2) == []
    assert {w: (n, d) for w, n, d in zip(*part.taken()) if n} == {"cat": (65, 4), "dog": (1, 1), "ünder": (1, 1), "über": (1, 1), "école": (1, 1), "a\0b": (1, 1), "one-two": (2, 2), "end": (2, 2)}
    assert whole.add(["The the THE a"]) == []
    assert {w: (n, d) for w, n, d in zip(*whole.taken())} == {"the": (3, 1), "a": (1, 1)}


def lookups(monkeypatch, texts):
    """The pieces that are looked up one by one."""
    looked, at = [], treebank.Treebank._at
    with monkeypatch.context() as m:
        m.setattr(treebank.Treebank, "_at", lambda self, piece, *rest: looked.append(piece) or at(self, piece, *rest))
        assert treebank.WordCounts().add(texts) == []
    return looked


def letters(k):
    return "".join(chr(97 + int(c)) for c in f"{k:05d}")


def test_corpus_vocab_of_ever_new_words(spark, monkeypatch):
    texts = [f"Start {letters(k)}, Shared {letters(k // 4)}xx. Then {letters(k)} (again) stop" for k in range(400)]
    assert set(lookups(monkeypatch, texts)) == {"Start", "(again)", "stop"}
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)] + [(28, "shared aaaahxx twice twice")], "doc_id long, text string")
    got = {r.word: (r.n_total, r.doc_freq) for r in words.corpus_vocab(docs, low=0, high=1).collect()}
    assert got == {"start": (400, 400), "shared": (401, 400), "stop": (400, 400)} | {f"{letters(k)}xx": (4 + (k == 7), 4) for k in range(100)}
    few = words.corpus_vocab(docs, low=0, high=0.9, min_docs=1)
    assert {(r.n_total, r.doc_freq): r.n for r in few.groupBy("n_total", "doc_freq").agg(F.count(F.lit(1)).alias("n")).collect()} == {(2, 1): 401, (4, 4): 99}


def test_missing_vectors_of_accented_words(spark, monkeypatch):
    texts = [f"Zu {letters(k)}é, Ö{letters(k // 4)}! Ñ{letters(k // 8)}; {letters(k)}ſ. Weg" for k in range(400)]
    assert sum("Ö" in p or "Ñ" in p or "é" in p for p in lookups(monkeypatch, texts)) == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = words.corpus_vocab(docs, low=0, high=1)
    found = words.missing_vectors(vocab, vocab.filter("word like 'ñ%'"))
    assert sorted(r.word for r in found.collect()) == sorted(["weg", *(f"ö{letters(k)}" for k in range(100))])
