"""From documents with vectors and topics to a whole topic set; every builder of topics is this one plan with other arguments."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.operators import cluster, topics, words
from topicloom.sources.tables import load_model, save_model
from topicloom.sources.work import written

METHODS = ("tfidf", "cosine_similarity")
N_TOPWORDS = 2000


@dataclass(frozen=True)
class TopicSet:
    """One version of the topics; edits give a new one.

    base: doc_id, text, emb_hd, emb_ld. assignment: doc_id, topic_idx (-1: outlier), doc_pos, similarity.
    topics: topic_idx, topic_name, topic_description, centroid_hd, centroid_ld, n_docs.
    top_words: topic_idx, method, rank, word, score. word_vectors: word, emb_hd, emb_ld.
    """

    base: DataFrame
    assignment: DataFrame
    topics: DataFrame
    vocab: DataFrame
    top_words: DataFrame
    word_vectors: DataFrame
    reducer: cluster.Reducer

    def docs(self) -> DataFrame:
        return self.base.join(self.assignment, "doc_id")

    def indices(self) -> list[int]:
        return sorted(r.topic_idx for r in self.topics.select("topic_idx").collect())

    def words(self, topic: int, n: int, method: str = "cosine_similarity") -> list[str]:
        """A topic's first n words by a method, by any other where it has none of that."""
        own = self.top_words.filter((F.col("topic_idx") == topic) & (F.col("rank") < n)).select("method", "rank", "word").collect()
        found = [r for r in own if r.method == method] or own
        return [r.word for r in sorted(found, key=lambda r: (r.method, r["rank"]))]

    def named(self, names: dict[int, tuple[str | None, str | None]]) -> TopicSet:
        """With names and descriptions of some topics."""
        if not names:
            return self
        new = self.topics.sparkSession.createDataFrame([(k, *v) for k, v in names.items()], "topic_idx int, name string, description string")
        out = self.topics.join(F.broadcast(new), "topic_idx", "left").withColumn("topic_name", F.coalesce("name", "topic_name")).withColumn("topic_description", F.coalesce("description", "topic_description"))
        return replace(self, topics=written(out.drop("name", "description"), "topics"))

    def save(self, path: str) -> None:
        save_model({"documents": self.docs(), "topics": self.topics, "vocabulary": self.vocab, "top_words": self.top_words, "word_vectors": self.word_vectors}, path)
        self.reducer.model.write().overwrite().save(f"{path}/reducer")

    @staticmethod
    def load(spark, path: str) -> TopicSet:
        from pyspark.ml.feature import PCAModel

        t = load_model(spark, path, ["documents", "topics", "vocabulary", "top_words", "word_vectors"])
        base, assignment = t["documents"].select("doc_id", "text", "emb_hd", "emb_ld"), t["documents"].select("doc_id", "topic_idx", "doc_pos", "similarity")
        return TopicSet(base, assignment, t["topics"], t["vocabulary"], t["top_words"], t["word_vectors"], cluster.Reducer(PCAModel.load(f"{path}/reducer")))


def centroid_table(docs: DataFrame, reducer: cluster.Reducer) -> DataFrame:
    """Topics' centroids: the mean vector, its projection, and how many documents; no names yet."""
    means = topics.centroids(docs).join(topics.topic_sizes(docs.filter("topic_idx >= 0")), "topic_idx")
    low = reducer.transform(means, "centroid_hd", "centroid_ld")
    return low.select("topic_idx", F.lit(None).cast("string").alias("topic_name"), F.lit(None).cast("string").alias("topic_description"), "centroid_hd", "centroid_ld", "n_docs")


def top_word_table(counts: DataFrame, word_vectors: DataFrame, centres: DataFrame, methods: tuple[str, ...], n: int, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(topic_idx, method, rank, word, score) by each method."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    parts = []
    if "tfidf" in methods:
        parts.append(words.topwords_tfidf(counts, n).withColumn("method", F.lit("tfidf")))
    if "cosine_similarity" in methods:
        parts.append(words.topwords_cosine(counts, word_vectors, centres, n, vec, centre).withColumn("method", F.lit("cosine_similarity")))
    tables = [p.select("topic_idx", "method", "rank", "word", "score") for p in parts]
    return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])


def build_topics(docs: DataFrame, reducer: cluster.Reducer, word_vectors: DataFrame, vocab: DataFrame | None = None, methods: tuple[str, ...] = METHODS, n_topwords: int = N_TOPWORDS, tokens: DataFrame | None = None) -> TopicSet:
    """The topic set of documents (doc_id, text, emb_hd, emb_ld, topic_idx). Without ``vocab`` it is found in all documents, outliers included."""
    base, assignment = docs.select("doc_id", "text", "emb_hd", "emb_ld"), docs.select("doc_id", "topic_idx")
    tokens = words.token_counts(docs.select("doc_id", "text")) if tokens is None else tokens
    vocab = written(words.corpus_vocab(tokens) if vocab is None else vocab, "vocabulary")
    centres = written(centroid_table(docs, reducer), "topics")
    counts = written(words.word_topic_counts(tokens.join(assignment, "doc_id"), vocab), "topic-counts")
    top = written(top_word_table(counts, word_vectors, centres, methods, n_topwords), "top-words")
    ranked = topics.ranked_documents(docs, centres, "emb_ld", "centroid_ld")
    placed = assignment.join(ranked.drop("topic_idx"), "doc_id", "left").select("doc_id", "topic_idx", "doc_pos", "similarity")
    return TopicSet(base, written(placed, "assignment"), centres, vocab, top, word_vectors, reducer)


def replaced(old: TopicSet, removed: list[int], parts: DataFrame, n_topwords: int = N_TOPWORDS) -> TopicSet:
    """``removed`` topics replaced by one new topic per part (doc_id, part) of their documents, in order of ``part``, after the topics that stay.

    What stays keeps its words and names. New topics get words by cosine from those of the old ones; documents keep their order.
    """
    kept = [k for k in old.indices() if k not in removed]
    values = sorted(r.part for r in parts.select("part").distinct().limit(topics.MOST_POINTS + 1).collect())
    if len(values) > topics.MOST_POINTS:
        raise ValueError(f"more than {topics.MOST_POINTS} parts")
    spark = old.topics.sparkSession
    place = spark.createDataFrame([(k, n) for n, k in enumerate(kept)] + [(-1, -1)], "topic_idx int, new int")
    fresh = spark.createDataFrame([(v, len(kept) + n) for n, v in enumerate(values)], "part int, fresh int")
    own = old.assignment.join(parts.select("doc_id", F.col("part").cast("int").alias("part")), "doc_id", "left").join(F.broadcast(place), "topic_idx", "left").join(F.broadcast(fresh), "part", "left")
    own = own.withColumn("to", F.coalesce("fresh", "new")).filter("to is not null")
    order = Window.partitionBy("to").orderBy("topic_idx", "doc_pos", "doc_id")
    again = F.when(F.col("fresh").isNull(), F.col("doc_pos")).otherwise(F.row_number().over(order) - 1)
    assignment = written(own.select("doc_id", F.col("to").alias("topic_idx"), again.alias("doc_pos"), "similarity"), "assignment")
    docs = old.base.join(assignment.filter(F.col("topic_idx") >= len(kept)).select("doc_id", "topic_idx"), "doc_id")
    stay = lambda df: df.join(F.broadcast(place.filter("new >= 0")), "topic_idx").drop("topic_idx").withColumnRenamed("new", "topic_idx").select(df.columns)
    new = centroid_table(docs, old.reducer)
    centres = written(stay(old.topics).unionByName(new), "topics")
    known = old.top_words.filter(F.col("topic_idx").isin(removed)).select("word").distinct()
    found = words.subtopic_words(docs.select(F.col("topic_idx").alias("part"), "text"), known).withColumnRenamed("part", "topic_idx")
    counts = words.word_topic_counts(docs.select("doc_id", "topic_idx", "text"), known).join(found, ["topic_idx", "word"], "left_semi")
    top = stay(old.top_words).unionByName(top_word_table(counts, old.word_vectors, centres, ("cosine_similarity",), n_topwords))
    return replace(old, assignment=assignment, topics=centres, top_words=written(top, "top-words"))


# ---- export ------------------------------------------------------------------


def word_lists(top_words: DataFrame, n: int) -> DataFrame:
    """(topic_idx, method, words, scores): each topic's first n words as lists."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "word", "score")))
    lists = top_words.filter(F.col("rank") < n).groupBy("topic_idx", "method").agg(pairs.alias("x"))
    return lists.select("topic_idx", "method", F.col("x.word").alias("words"), F.col("x.score").alias("scores"))


def topic_json(topic_table: DataFrame) -> DataFrame:
    """(topic_idx, json): index, name and description of each topic."""
    return topic_table.select("topic_idx", F.to_json(F.struct("topic_idx", "topic_name", "topic_description")).alias("json"))


def topics_json(topic_table: DataFrame) -> DataFrame:
    """One row: an object of all topics, keyed by index. For topic tables, which fit into one row."""
    one = F.struct(F.col("topic_idx").cast("string").alias("key"), F.struct("topic_name", "topic_description").alias("value"))
    return topic_table.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(one)))).alias("json"))


def topic_information(topic_table: DataFrame, top_words: DataFrame, indices: list[int], n: int = 500, tokens=None, budget: int = 16_000) -> DataFrame:
    """(topic_idx, information): a block of text for each of some topics, cut to an equal share of the budget."""
    from topicloom.functions.tokens import SpaceTokens

    lists = word_lists(top_words.filter(F.col("topic_idx").isin(indices)), n).groupBy("topic_idx").agg(F.max_by("words", F.when(F.col("method") == "cosine_similarity", 1).otherwise(0)).alias("words"))
    own = topic_table.filter(F.col("topic_idx").isin(indices)).join(lists, "topic_idx", "left")
    head = F.concat(F.lit("Topic "), F.col("topic_idx").cast("string"), F.lit(": "), F.coalesce("topic_name", F.lit("")))
    body = F.concat_ws("\n", head, F.coalesce("topic_description", F.lit("")), F.concat(F.lit("Documents: "), F.col("n_docs").cast("string")), F.concat(F.lit("Words: "), F.coalesce(F.array_join("words", ", "), F.lit(""))))
    return own.select("topic_idx", (tokens or SpaceTokens()).cut(body, budget // max(len(indices), 1)).alias("information"))
