"""The topic model: one call from a corpus to named topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.tokens import TokenCounter
from topicloom.operators import build, cluster, words
from topicloom.operators.describe import Enhancer
from topicloom.prompting import TopicPrompting
from topicloom.sources import embedding, tables
from topicloom.sources.work import written


class TopicModel:
    """Parameters of a fit, and after it the topics with their searching and editing.

    ``make_embedder`` builds the embedder in each worker and on the driver. Vectors that are given or saved are not computed again;
    with word vectors given, their words are the vocabulary and no filter runs.
    """

    def __init__(
        self, n_topics: int | None = None, make_embedder: Callable = embedding.HashEmbedder, enhancer: Enhancer | None = None,
        document_embeddings: DataFrame | None = None, vocab_embeddings: DataFrame | None = None, embeddings_path: str | None = None,
        dims: int = cluster.DIMS, min_cluster_size: int = cluster.MIN_SIZE, n_topwords: int = build.N_TOPWORDS, n_topwords_description: int = 500,
        methods: tuple[str, ...] = build.METHODS, tokens: TokenCounter | None = None, clusterer: Callable | None = None, **vocabulary,
    ):
        if unknown := set(methods) - set(build.METHODS):
            raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
        if not methods or n_topwords_description > n_topwords:
            raise ValueError("needs a method, and no more words for descriptions than top words")
        self.n_topics, self.make_embedder, self.enhancer = n_topics, make_embedder, enhancer or Enhancer()
        self.document_embeddings, self.vocab_embeddings, self.embeddings_path = document_embeddings, vocab_embeddings, embeddings_path
        self.dims, self.min_cluster_size, self.n_topwords, self.n_topwords_description = dims, min_cluster_size, n_topwords, n_topwords_description
        self.methods, self.tokens, self.vocabulary = tuple(methods), tokens, vocabulary
        self.clusterer = clusterer or (lambda docs: cluster.cluster_and_reduce(docs, self.n_topics, self.dims, self.min_cluster_size))
        self.topic_prompting: TopicPrompting | None = None

    def __repr__(self) -> str:
        return f"TopicModel(n_topics={self.n_topics}, dims={self.dims}, min_cluster_size={self.min_cluster_size}, methods={self.methods}, n_topwords={self.n_topwords}, enhancer={self.enhancer!r}, fitted={self.topic_prompting is not None})"

    @property
    def topic_set(self) -> build.TopicSet:
        if self.topic_prompting is None:
            raise ValueError("the model isn't fitted")
        return self.topic_prompting.topic_set

    def compute_embeddings(self, docs: DataFrame) -> DataFrame:
        """(doc_id, emb_hd) of the corpus; written once, as remote vectors cost money."""
        return written(embedding.document_embeddings(docs, self.make_embedder, self.tokens), "doc-vectors")

    def fit(self, docs: DataFrame, describe: bool = True) -> TopicModel:
        """From documents (doc_id, text) to topics: vectors, clusters, vocabulary, top words, names. Empty documents are left out."""
        docs = tables.corpus(docs)
        saved = tables.load_embeddings(docs.sparkSession, self.embeddings_path) if self.embeddings_path else None
        if saved is not None:
            self.document_embeddings, self.vocab_embeddings = saved
        if self.document_embeddings is None:
            self.document_embeddings = self.compute_embeddings(docs)
        with_vectors = docs.join(self.document_embeddings.select("doc_id", F.col("emb_hd").cast("array<double>").alias("emb_hd")).filter("emb_hd is not null"), "doc_id")
        clustered, reducer = self.clusterer(with_vectors)
        clustered = written(clustered.select("doc_id", "text", "emb_hd", "emb_ld", "topic_idx"), "clustered")
        tokens = words.token_counts(clustered.select("doc_id", "text"))
        if self.vocab_embeddings is None:
            vocab = written(words.corpus_vocab(tokens, **self.vocabulary), "vocabulary")
            self.vocab_embeddings = written(embedding.vocabulary_embeddings(vocab, self.make_embedder), "word-vectors")
        else:
            vocab = self.vocab_embeddings.select("word")
        topic_set = build.build_topics(clustered, reducer, self.vocab_embeddings, vocab, self.methods, self.n_topwords, tokens)
        if describe:
            topic_set = self.enhancer.describe_topics(topic_set, self.n_topwords_description)
        self.topic_prompting = TopicPrompting(topic_set, self.make_embedder(), self.enhancer, self.n_topwords)
        return self

    def save_embeddings(self, path: str) -> None:
        tables.save_embeddings(self.document_embeddings, self.vocab_embeddings, path)

    def save(self, path: str) -> None:
        self.topic_set.save(path)

    def load(self, spark, path: str) -> TopicModel:
        """The topics of a saved model."""
        self.topic_prompting = TopicPrompting(build.TopicSet.load(spark, path), self.make_embedder(), self.enhancer, self.n_topwords)
        return self

    def repr_topics(self, n_words: int = 10) -> str:
        blocks = []
        for t in self.topic_prompting.get_topic_lis():
            first = ", ".join(self.topic_set.words(t["topic_idx"], n_words))
            blocks.append(f"Topic {t['topic_idx']}: {t['topic_name']}\n{t['topic_description']}\n{t['n_docs']} documents; {first}")
        return ("\n" + "-" * 150 + "\n").join(blocks)

    def print_topics(self) -> None:
        print(self.repr_topics())

    def visualize_clusters(self) -> DataFrame:
        """Coordinates, start of the text and topic name of every document that isn't an outlier."""
        points = cluster.plot_coordinates(self.topic_set.docs().filter("topic_idx >= 0"))
        return points.join(self.topic_set.topics.select("topic_idx", "topic_name"), "topic_idx")

    def prompt(self, query: str) -> tuple[str | None, object]:
        """The chat model's answer to a request about the topics, and its tool's result."""
        messages, result = self.topic_prompting.general_prompt(query)
        return messages[-1]["content"], result

    def pprompt(self, query: str, return_function_result: bool = True) -> object:
        """Prints the answer."""
        answer, result = self.prompt(query)
        print(answer)
        return result if return_function_result else None
