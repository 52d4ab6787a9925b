"""Vocabulary, word counts of topics, and their most telling words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.functions.text import is_vocabulary_word
from topicloom.functions.treebank import tokenised, vocabulary_parts
from topicloom.functions.vectors import cosine, dot
from topicloom.sources.work import written


def words_of(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per token. The outer explode keeps Catalyst from testing the size of the tokens first, which may tokenise twice more."""
    return tokenised(docs, *keep).select(*keep, F.explode_outer("tokens").alias("token")).filter("token is not null")


def token_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, [topic_idx,] token, n), written once: the corpus is tokenised here and nowhere else."""
    keep = [c for c in ("doc_id", "topic_idx") if c in docs.columns]
    return written(words_of(docs, *keep).groupBy(*keep, "token").agg(F.count(F.lit(1)).alias("n")), "token-counts")


def _counted(docs: DataFrame) -> DataFrame:
    """Token counts, of documents or as given."""
    return docs if "token" in docs.columns else token_counts(docs)


def vocabulary_counts(docs: DataFrame, **filters) -> DataFrame:
    """(word, n_total, doc_freq) of every lower-cased word that passes the filters, written once.

    Documents are counted where they are read, so only each part's sums are shuffled. Rows that share a doc_id count as one document.
    """
    if "token" in docs.columns:
        counts = _vocabulary(docs, **filters)
    else:
        # few ids or none, so the texts are joined only where there are any
        repeated = written(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_id")), "repeated-ids")
        if repeated.isEmpty():
            marked = docs.withColumn("again", F.lit(False))
        else:
            marked = docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").withColumn("again", F.lit(True))
            marked = marked.unionByName(docs.join(repeated, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").withColumn("again", F.lit(False)))
        parts = written(vocabulary_parts(marked, **filters), "vocabulary-parts")
        rest = words_of(parts.filter("word is null"), "doc_id").groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
        both = parts.filter("word is not null").select("word", "n_total", "doc_freq").unionByName(_vocabulary(rest, **filters))
        counts = both.groupBy("word").agg(F.sum("n_total").alias("n_total"), F.sum("doc_freq").alias("doc_freq"))
    return written(counts, "vocabulary-counts")


def _vocabulary(counts: DataFrame, **filters) -> DataFrame:
    """(word, n_total, doc_freq) from (doc_id, token, n)."""
    found = counts.filter(is_vocabulary_word(F.col("token"), **filters))
    per_doc = found.groupBy(F.lower("token").alias("word"), "doc_id").agg(F.sum("n").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("doc_freq"))


def quantile_bounds(counts: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(least, most, words, all_tokens): the counts at two quantiles of the distinct words, one rounded down and one up.

    Found on the distinct counts, of which there are few even where words are many.
    """
    sizes = counts.groupBy("n_total").agg(F.count(F.lit(1)).alias("w"))
    every = Window.orderBy("n_total").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select("n_total", (F.sum("w").over(Window.orderBy("n_total")) - 1).alias("last"), F.sum("w").over(every).alias("words"), F.sum(F.col("w") * F.col("n_total")).over(every).alias("all_tokens"))
    return ranked.groupBy("words", "all_tokens").agg(
        F.min(F.when(F.col("last") >= F.floor(low * (F.col("words") - 1)), F.col("n_total"))).alias("least"),
        F.min(F.when(F.col("last") >= F.ceil(high * (F.col("words") - 1)), F.col("n_total"))).alias("most"),
    )


def corpus_vocab(docs: DataFrame, min_docs: int = 3, low: float = 0.1, high: float = 0.9, **filters) -> DataFrame:
    """(word, n_total, doc_freq, freq): words in at least ``min_docs`` documents whose frequency lies between two quantiles of the distinct words."""
    counts = vocabulary_counts(docs, **filters)
    bounds = quantile_bounds(counts, low, high)  # one row
    kept = counts.crossJoin(F.broadcast(bounds)).filter(F.col("n_total").between(F.col("least"), F.col("most")) & (F.col("doc_freq") >= min_docs))
    return kept.select("word", "n_total", "doc_freq", (F.col("n_total") / F.col("all_tokens")).alias("freq"))


def most_common_words(docs: DataFrame, n: int = 10, **filters) -> DataFrame:
    """(rank, word, n_total) of the n commonest words before the quantile filter."""
    top = vocabulary_counts(docs, **filters).orderBy(F.col("n_total").desc(), "word").limit(n)
    return top.select((F.row_number().over(Window.orderBy(F.col("n_total").desc(), "word")) - 1).alias("rank"), "word", "n_total")


def words_per_topic(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(topic_idx, doc_id, pos, word): lower-cased vocabulary words of each topic with repeats, in order of document and place.

    One row a word, so that no topic's words have to fit into one task.
    """
    found = tokenised(docs, "topic_idx", "doc_id").select("topic_idx", "doc_id", F.posexplode_outer("tokens").alias("pos", "token")).filter("token is not null")
    return found.withColumn("word", F.lower("token")).join(vocab.select("word"), "word", "left_semi").select("topic_idx", "doc_id", "pos", "word")


def bag_of_words(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word, n): lower-cased counts over the vocabulary."""
    counts = _counted(docs).groupBy("doc_id", F.lower("token").alias("word")).agg(F.sum("n").alias("n"))
    return counts.join(vocab.select("word"), "word", "left_semi").select("doc_id", "word", "n")


def word_topic_counts(docs: DataFrame, vocab: DataFrame, lower: bool = False) -> DataFrame:
    """(topic_idx, word, n) of vocabulary words; raw-case tokens count only where they equal a word, unless ``lower``."""
    found = _counted(docs).withColumn("word", F.lower("token") if lower else F.col("token"))
    counts = found.groupBy("topic_idx", "word").agg(F.sum("n").alias("n"))
    return counts.join(vocab.select("word"), "word", "left_semi").select("topic_idx", "word", "n")


def topwords_tfidf(counts: DataFrame, n: int | None = None) -> DataFrame:
    """(topic_idx, rank, word, score): class TF-IDF, outliers left out."""
    own = written(counts.filter("topic_idx >= 0"), "topic-words")
    per_topic = own.groupBy("topic_idx").agg(F.sum("n").alias("total"))
    per_word = own.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    topics = per_topic.agg(F.count(F.lit(1)).alias("k"))  # one row
    scored = own.join(per_topic, "topic_idx").join(per_word, "word").crossJoin(F.broadcast(topics))
    scored = scored.select("topic_idx", "word", F.round(F.col("n") / F.col("total") * F.log(1 + F.col("k") / F.col("df")), 9).alias("score"))
    return _ranked(scored, "score", n)


def word_similarities(word_vectors: DataFrame, centroids: DataFrame, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(word, topic_idx, cosine) of every word and centroid; both sides may first be put through a reducer."""
    pairs = word_vectors.select("word", F.col(vec).alias("v")).crossJoin(centroids.select("topic_idx", F.col(centre).alias("c")))
    return pairs.select("word", "topic_idx", F.round(cosine(F.col("v"), F.col("c")), 9).alias("cosine"))


def missing_vectors(words: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """Words without a vector."""
    return words.select("word").distinct().join(word_vectors.select("word"), "word", "left_anti")


def topwords_cosine(counts: DataFrame, word_vectors: DataFrame, centroids: DataFrame, n: int | None = None, vec: str = "emb_hd", centre: str = "centroid_hd", strict: bool = False) -> DataFrame:
    """(topic_idx, rank, word, score, cosine, top_cosine): words by cosine to the topic's centroid times count.

    ``cosine`` is the word's own; ``top_cosine`` the one at its rank when the topic's words are sorted by cosine alone.
    Words without a vector have no score; with ``strict`` they are an error.
    """
    if strict and not missing_vectors(counts, word_vectors).isEmpty():
        raise KeyError("vocabulary words without a vector")
    joined = counts.filter("topic_idx >= 0").join(word_vectors.select("word", F.col(vec).alias("v")), "word").join(centroids.select("topic_idx", F.col(centre).alias("c")), "topic_idx")
    scored = joined.withColumn("cosine", F.round(cosine(F.col("v"), F.col("c")), 9))
    scored = scored.select("topic_idx", "word", F.round(F.col("cosine") * F.col("n"), 7).alias("score"), "cosine")
    ranked = _ranked(scored, "score", n)
    alone = _ranked(scored, "cosine", n).select("topic_idx", "rank", F.col("cosine").alias("top_cosine"))
    return ranked.join(alone, ["topic_idx", "rank"])


def subtopic_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(part, word): the old topic's words that occur in each part's documents, as pieces between single spaces; docs: part, text."""
    pieces = docs.select("part", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).distinct()
    return pieces.join(words.select("word").distinct(), "word", "left_semi").select("part", "word")


def frobenius_similarity(docs: DataFrame, centre, vec: str = "emb_hd") -> DataFrame:
    """(doc_id, similarity): dot product over the norm of the whole matrix and of the centroid, so not a cosine."""
    whole = docs.agg(F.sqrt(F.sum(dot(F.col(vec), F.col(vec)))).alias("whole"))  # one row
    own = docs.crossJoin(F.broadcast(whole))
    return own.select("doc_id", F.round(dot(F.col(vec), centre) / F.nullif(F.col("whole") * F.sqrt(dot(centre, centre)), F.lit(0.0)), 9).alias("similarity"))


def most_similar_docs(docs: DataFrame, centre, n: int, vec: str = "emb_hd") -> DataFrame:
    """(rank, doc_id, similarity) of the n documents of the whole corpus that are most similar in that sense."""
    top = frobenius_similarity(docs, centre, vec).orderBy(F.col("similarity").desc(), "doc_id").limit(n)
    return top.select((F.row_number().over(Window.orderBy(F.col("similarity").desc(), "doc_id")) - 1).alias("rank"), "doc_id", "similarity")


def _ranked(scored: DataFrame, by: str, n: int | None) -> DataFrame:
    order = Window.partitionBy("topic_idx").orderBy(F.col(by).desc(), "word")
    out = scored.withColumn("rank", F.row_number().over(order) - 1)
    return out if n is None else out.filter(F.col("rank") < n)
