"""Every query of the engine's own operators, and its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions import vectors as V
from topicloom.functions.tokens import SpaceTokens
from topicloom.functions.treebank import tokenised
from topicloom.functions.vectors import mean_vectors
from topicloom.operators import build, cluster, topics, words
from topicloom.sources import embedding
from topicloom.sources.tables import assigned, corpus, read_table

DIMS = 64


def keyword_vector(seed: int):
    """A fixed unit-free query vector for the search and editing queries."""
    return F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.cos(i * (seed + 1)))


def _sql_keyword(seed: int) -> str:
    return f"list_transform(range({DIMS}), lambda i: cos(i * {seed + 1}))"


def word_vectors(vocab):
    """A fixed vector for each word, from its length and three of its letters; no table holds vectors of words."""
    code = lambda c: F.ascii(c)
    seed = F.length("word") * 31 + code(F.col("word")) + code(F.substring("word", 2, 1)) * 7 + code(F.substring("word", -1, 1)) * 13
    return vocab.select("word", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.cos(seed * (i + 1) / 97.0)).alias("emb_hd"))


def corpus_vocab(spark, d):
    return words.corpus_vocab(corpus(read_table(spark, d, "documents"))).withColumn("freq", F.round("freq", 9))


def vocab_quantile_bounds(spark, d):
    return words.quantile_bounds(words.vocabulary_counts(corpus(read_table(spark, d, "documents"))))


def most_common_words(spark, d):
    return words.most_common_words(corpus(read_table(spark, d, "documents")))


def _tokens(spark, d):
    return words.token_counts(assigned(spark, d))


def _counts(spark, d, lower=False):
    tokens = _tokens(spark, d)
    return words.word_topic_counts(tokens, words.corpus_vocab(tokens), lower)


def word_topic_counts(spark, d):
    return _counts(spark, d)


def word_topic_lower(spark, d):
    return _counts(spark, d, lower=True)


def words_per_topic(spark, d):
    docs = assigned(spark, d)
    return words.words_per_topic(docs, words.corpus_vocab(docs))


def bag_of_words(spark, d):
    tokens = _tokens(spark, d)
    return words.bag_of_words(tokens, words.corpus_vocab(tokens))


def tfidf_topwords(spark, d):
    return words.topwords_tfidf(_counts(spark, d), 10)


def centroid_topwords(spark, d):
    docs = assigned(spark, d)
    tokens = words.token_counts(docs)
    vocab = words.corpus_vocab(tokens)
    found = words.topwords_cosine(words.word_topic_counts(tokens, vocab), word_vectors(vocab), topics.centroids(docs), 10)
    return found.select("topic_idx", "rank", "word", F.round("score", 4).alias("score"), F.round("cosine", 6).alias("cosine"), F.round("top_cosine", 6).alias("top_cosine"))


def word_similarities(spark, d):
    docs = assigned(spark, d)
    found = words.word_similarities(word_vectors(words.corpus_vocab(docs)), topics.centroids(docs))
    return found.select("word", "topic_idx", F.round("cosine", 6).alias("cosine"))


def missing_vectors(spark, d):
    """Vocabulary words that begin with a vowel, if only the others have vectors."""
    vocab = words.corpus_vocab(corpus(read_table(spark, d, "documents")))
    return words.missing_vectors(vocab, word_vectors(vocab.filter(~F.col("word").rlike("^[aeiou]"))))


def frobenius_similarity(spark, d):
    return words.frobenius_similarity(assigned(spark, d), keyword_vector(0)).withColumn("similarity", F.round("similarity", 7))


def most_similar_docs(spark, d):
    return words.most_similar_docs(assigned(spark, d), keyword_vector(1), 25).withColumn("similarity", F.round("similarity", 7))


def global_centroid(spark, d):
    return topics.global_centroid(assigned(spark, d)).select(F.posexplode("centroid_hd").alias("pos", "x")).withColumn("x", F.round("x", 7))


def vocabulary_tokens(spark, d):
    """The Treebank tokens that pass all filters, with their places."""
    docs = tokenised(corpus(read_table(spark, d, "documents")), "doc_id").select("doc_id", F.posexplode_outer("tokens").alias("pos", "token"))
    return docs.filter(T.is_vocabulary_word(F.col("token"))).select("doc_id", "pos", "token")


def token_totals(spark, d):
    return embedding.token_total(corpus(read_table(spark, d, "documents")))


def split_long_documents(spark, d):
    docs = corpus(read_table(spark, d, "documents"))
    return docs.select("doc_id", F.posexplode(T.split_long(F.col("text"), SpaceTokens().count(F.col("text")), 300)).alias("chunk", "piece"))


def literal_chunks(spark, d):
    return corpus(read_table(spark, d, "documents")).select("doc_id", F.posexplode(T.literal_chunks(F.col("text"), 2000)).alias("chunk", "piece"))


def token_cut(spark, d):
    return corpus(read_table(spark, d, "documents")).select("doc_id", SpaceTokens().cut(F.col("text"), 40).alias("head"))


def chunk_mean(spark, d):
    """Mean of three vectors at a time, as of the chunks of a document."""
    v = read_table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("doc_id"), F.col("embedding"))
    return mean_vectors(v, ["doc_id"], "embedding", "m").select("doc_id", F.posexplode("m").alias("pos", "x")).withColumn("x", F.round("x", 7))


def topword_token_budget(spark, d):
    """Each topic's top words as far as 40 characters go."""
    from pyspark.sql.window import Window

    used = F.sum(F.length("word") + 1).over(Window.partitionBy("topic_idx").orderBy("rank"))
    return tfidf_topwords(spark, d).withColumn("used", used).filter("used <= 40").select("topic_idx", "rank", "word", "used")


def first_documents(spark, d):
    """Sampling in order: the first five documents of each topic."""
    return ranked_documents(spark, d).filter("doc_pos < 5").select("topic_idx", "doc_pos", "doc_id")


def _topic_table(spark, d):
    sizes = topics.topic_sizes(assigned(spark, d).filter("topic_idx >= 0"))
    return sizes.select("topic_idx", F.concat(F.lit("t"), "topic_idx").alias("topic_name"), F.lit("about").alias("topic_description"), "n_docs")


def topic_json(spark, d):
    return build.topic_json(_topic_table(spark, d))


def topics_json(spark, d):
    return build.topics_json(_topic_table(spark, d))


def topic_information(spark, d):
    return build.topic_information(_topic_table(spark, d), tfidf_topwords(spark, d).withColumn("method", F.lit("tfidf")), [0, 2, 5], 5, budget=60)


def split_words(spark, d):
    """Words of topic 0 that occur in either half of its documents."""
    docs = assigned(spark, d)
    parts = docs.filter("topic_idx = 0").select(F.pmod("doc_id", F.lit(2)).cast("int").alias("part"), "text")
    return words.subtopic_words(parts, words.corpus_vocab(docs))


def split_topic_single_keyword(spark, d):
    points = spark.range(2).select(F.col("id").cast("int").alias("keyword_idx"), F.when(F.col("id") == 0, keyword_vector(3)).otherwise(keyword_vector(5)).alias("emb_kw"))
    return topics.split_by_keywords(assigned(spark, d), 3, points)


def split_topic_assignments(spark, d):
    """Topic 1 in three parts, one of them noise."""
    docs = assigned(spark, d)
    parts = docs.filter("topic_idx = 1").select("doc_id", (F.pmod("doc_id", F.lit(3)) - 1).cast("int").alias("part"))
    return topics.split_by_assignment(docs, 1, parts).select("doc_id", "topic_idx", "is_noise")


def delete_topic_orphans(spark, d):
    return topics.delete_topics(assigned(spark, d), [1], only_orphans=True).select("doc_id", "topic_idx")


def compact_labels(spark, d):
    """Indices made consecutive after topics 2 and 4 became outliers."""
    own = assigned(spark, d).select("doc_id", F.when(F.col("topic_idx").isin(2, 4), F.lit(-1)).otherwise(F.col("topic_idx")).alias("topic_idx"))
    return topics.reindexed(own).select("doc_id", "topic_idx")


def reduced_vectors(spark, d):
    low, _ = cluster.reduced(assigned(spark, d))
    return low.select("doc_id", F.posexplode("emb_ld").alias("pos", "x"))


def density_clusters(spark, d):
    return cluster.cluster_and_reduce(assigned(spark, d).drop("topic_idx"))[0].select("doc_id", "topic_idx")


def fixed_clusters(spark, d):
    return cluster.cluster_and_reduce(assigned(spark, d).drop("topic_idx"), k=5)[0].select("doc_id", "topic_idx")


def kmeans_split(spark, d):
    return cluster.kmeans_parts(assigned(spark, d).filter("topic_idx = 0"), 2, "emb_hd")


def plot_points(spark, d):
    return cluster.plot_coordinates(assigned(spark, d).filter("topic_idx >= 0")).drop("hover")


def plot_hover(spark, d):
    return assigned(spark, d).filter("topic_idx >= 0").select("doc_id", "topic_idx", F.substring("text", 1, 200).alias("hover"))


def embedded_documents(spark, d):
    docs = corpus(read_table(spark, d, "documents"))
    return embedding.document_embeddings(docs, embedding.HashEmbedder, most=500).select("doc_id", F.size("emb_hd").alias("dims"))


def topic_centroids(spark, d):
    return topics.centroids(assigned(spark, d)).select("topic_idx", F.posexplode("centroid_hd").alias("pos", "x")).withColumn("x", F.round("x", 7))


def ranked_documents(spark, d):
    return topics.ranked_documents(assigned(spark, d)).withColumn("similarity", F.round("similarity", 6))


def knn_search(spark, d):
    return topics.knn_search(assigned(spark, d), keyword_vector(0), 0, budget=4000).withColumn("similarity", F.round("similarity", 6))


def combine_topics(spark, d):
    return topics.combine_topics(assigned(spark, d), [0, 2]).select("doc_id", "topic_idx")


def delete_topic(spark, d):
    return topics.delete_topics(assigned(spark, d), [1]).select("doc_id", "topic_idx")


def split_topic_keywords(spark, d):
    points = spark.range(3).select(F.col("id").cast("int").alias("keyword_idx"))
    points = points.withColumn("emb_kw", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.cos(i * (F.col("keyword_idx") + 1))))
    return topics.split_by_keywords(assigned(spark, d), 0, points)


def add_topic(spark, d):
    return topics.add_topic(assigned(spark, d), keyword_vector(0)).select("doc_id", "topic_idx")


def topic_sizes(spark, d):
    return topics.topic_sizes(assigned(spark, d))


def first_words(spark, d):
    return corpus(read_table(spark, d, "documents")).select("doc_id", T.first_words(F.col("text")).alias("head"))


def document_chunks(spark, d):
    return corpus(read_table(spark, d, "documents")).select("doc_id", F.posexplode(T.chunks(F.col("text"), 2000)).alias("chunk", "piece"))


def normalised_vectors(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", F.posexplode(V.normalised(F.col("embedding"))).alias("pos", "x"))
    return v.withColumn("x", F.round("x", 7))


def conversation_sizes(spark, d):
    return tokenised(read_table(spark, d, "conversations"), "conv_id").groupBy("conv_id").agg(F.sum(F.size("tokens")).alias("n_tokens"))


def cluster_split(spark, d):
    return cluster.clustered(assigned(spark, d).filter("topic_idx = 0"), 3)


QUERIES = {
    f.__name__: f
    for f in (
        corpus_vocab, word_topic_counts, tfidf_topwords, topic_centroids, ranked_documents, knn_search, combine_topics, delete_topic,
        split_topic_keywords, add_topic, topic_sizes, first_words, document_chunks, normalised_vectors, conversation_sizes, cluster_split,
        vocab_quantile_bounds, most_common_words, word_topic_lower, words_per_topic, bag_of_words, centroid_topwords, word_similarities,
        missing_vectors, frobenius_similarity, most_similar_docs, global_centroid, vocabulary_tokens, token_totals, split_long_documents,
        literal_chunks, token_cut, chunk_mean, topword_token_budget, first_documents, topic_json, topics_json, topic_information, split_words,
        split_topic_single_keyword, split_topic_assignments, delete_topic_orphans, compact_labels, reduced_vectors, density_clusters,
        fixed_clusters, kmeans_split, plot_points, plot_hover, embedded_documents,
    )
}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
_TOKENS = T.tokens_sql("text")
_DOCS = "docs AS (SELECT doc_id, text, embedding::DOUBLE[] emb, label topic_idx FROM documents JOIN embeddings ON vec_id = doc_id WHERE text <> '')"


def _vocab(source: str) -> str:
    return rf"""
tok AS MATERIALIZED (SELECT doc_id, unnest({_TOKENS}) token FROM {source}),
found AS (SELECT doc_id, lower(token) word FROM tok WHERE regexp_matches(token, '[a-zA-Z]') AND regexp_matches(token, '^\p{{L}}')
  AND NOT regexp_matches(token, '\p{{Nd}}') AND length(token) BETWEEN 3 AND 20 AND lower(token) NOT IN ({_STOP})),
wc AS MATERIALIZED (SELECT word, count(*) n_total, count(DISTINCT doc_id) doc_freq FROM found GROUP BY word),
pos AS (SELECT n_total, row_number() OVER (ORDER BY n_total) - 1 p, count(*) OVER () k, sum(n_total) OVER () all_tokens FROM wc),
bounds AS (SELECT max(all_tokens) all_tokens, max(n_total) FILTER (p = floor(0.1 * (k - 1))) least, max(n_total) FILTER (p = ceil(0.9 * (k - 1))) most FROM pos),
vocab AS (SELECT word, n_total, doc_freq, n_total / all_tokens freq FROM wc, bounds WHERE n_total BETWEEN least AND most AND doc_freq >= 3)"""


_ALL = f"d AS (SELECT doc_id, text FROM documents WHERE text <> ''), {_vocab('d')}"
_TOPIC_VOCAB = f"{_DOCS}, {_vocab('docs')}"
_COUNTS = f"""{_TOPIC_VOCAB},
cnt AS (SELECT topic_idx, token word, count(*) n FROM tok JOIN docs USING (doc_id) WHERE token IN (SELECT word FROM vocab) GROUP BY ALL)"""
_VECTOR = f"list_transform(range({DIMS}), lambda i: cos((length(word) * 31 + unicode(word) + unicode(substr(word, 2, 1)) * 7 + unicode(right(word, 1)) * 13) * (i + 1) / 97.0))"
_MEANS = f"""
flat AS (SELECT topic_idx, unnest(range({DIMS})) pos, unnest(emb) x FROM docs WHERE topic_idx >= 0),
means AS (SELECT topic_idx, pos, avg(x) x FROM flat GROUP BY ALL),
cent AS (SELECT topic_idx, list(x ORDER BY pos) c FROM means GROUP BY topic_idx),
own AS (SELECT doc_id, docs.topic_idx, emb, round(list_cosine_similarity(emb, c), 9) similarity FROM docs JOIN cent USING (topic_idx))"""
_CENTRES = f"{_DOCS}, {_MEANS}"
_TFIDF = """c AS (SELECT * FROM cnt WHERE topic_idx >= 0),
s AS (SELECT topic_idx, word, round(n / sum(n) OVER (PARTITION BY topic_idx) * ln(1 + (SELECT count(DISTINCT topic_idx) FROM c) / count(*) OVER (PARTITION BY word)), 9) score FROM c),
tfidf AS (SELECT topic_idx, word, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY topic_idx ORDER BY score DESC, word) - 1)::INT rank FROM s) WHERE rank < 10)"""
_TABLE = f"{_DOCS}, topic AS (SELECT topic_idx, 't' || topic_idx topic_name, 'about' topic_description, count(*) n_docs FROM docs WHERE topic_idx >= 0 GROUP BY topic_idx)"
_FROBENIUS = "list_inner_product(emb, {q}) / ((SELECT sqrt(sum(list_inner_product(emb, emb))) FROM docs) * sqrt(list_inner_product({q}, {q})))"


def _compact(source: str) -> str:
    return f"""SELECT doc_id, CASE WHEN topic_idx < 0 THEN -1 ELSE (SELECT count(DISTINCT o.topic_idx) FROM {source} o WHERE o.topic_idx >= 0 AND o.topic_idx < {source}.topic_idx) END::INT topic_idx FROM {source}"""


ORACLES = {
    "corpus_vocab": f"WITH {_ALL} SELECT word, n_total::BIGINT n_total, doc_freq, round(freq, 9) freq FROM vocab",
    "word_topic_counts": f"WITH {_COUNTS} SELECT topic_idx, word, n FROM cnt",
    "tfidf_topwords": f"WITH {_COUNTS}, {_TFIDF} SELECT topic_idx, word, score, rank FROM tfidf",
    "topic_centroids": f"WITH {_CENTRES} SELECT topic_idx, pos::INT pos, round(x, 7) x FROM means",
    "ranked_documents": f"WITH {_CENTRES} SELECT topic_idx, doc_id, (row_number() OVER (PARTITION BY topic_idx ORDER BY similarity DESC, doc_id) - 1)::INT doc_pos, round(similarity, 6) similarity FROM own",
    "knn_search": f"""WITH {_DOCS}, near AS (SELECT doc_id, round(list_cosine_similarity(emb, {_sql_keyword(0)}), 9) s, least(len(string_split(text, ' ')), 1000)::INT n_tokens FROM docs WHERE topic_idx = 0),
top AS (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) - 1 r FROM near),
used AS (SELECT *, sum(n_tokens) OVER (ORDER BY r)::BIGINT used FROM top WHERE r < 20)
SELECT r::INT rank, doc_id, round(s, 6) similarity, n_tokens, used FROM used WHERE used <= 4000""",
    "combine_topics": f"WITH {_DOCS}, m AS (SELECT doc_id, CASE WHEN topic_idx IN (0, 2) THEN 2147483647 ELSE topic_idx END topic_idx FROM docs) {_compact('m')}",
    "delete_topic": f"""WITH {_CENTRES}, near AS (SELECT doc_id, cent.topic_idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(emb, c), 9) DESC, cent.topic_idx) r
FROM docs, cent WHERE docs.topic_idx >= 0 AND cent.topic_idx <> 1), m AS (SELECT doc_id, topic_idx FROM near WHERE r = 1) {_compact('m')}""",
    "split_topic_keywords": f"""WITH {_DOCS}, kw AS (SELECT i::INT keyword_idx, list_transform(range({DIMS}), lambda j: cos(j * (i + 1))) v FROM range(3) t(i)),
near AS (SELECT doc_id, keyword_idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(emb, v), 9) DESC, keyword_idx) r FROM docs, kw WHERE topic_idx = 0)
SELECT doc_id, keyword_idx FROM near WHERE r = 1""",
    "add_topic": f"WITH {_CENTRES}, m AS (SELECT doc_id, CASE WHEN round(list_cosine_similarity(emb, {_sql_keyword(0)}), 9) > similarity THEN 2147483647 ELSE topic_idx END topic_idx FROM own) {_compact('m')}",
    "topic_sizes": f"WITH {_DOCS} SELECT topic_idx, count(*) n_docs FROM docs GROUP BY topic_idx",
    "first_words": "SELECT doc_id, array_to_string(string_split(text, ' ')[1:100], ' ') head FROM documents WHERE text <> ''",
    "document_chunks": "SELECT doc_id, i::INT chunk, substring(text, (i * 2000 + 1)::INT, 2000) piece FROM (SELECT doc_id, text, unnest(range((length(text) + 1999) // 2000)) i FROM documents WHERE text <> '')",
    "normalised_vectors": f"SELECT vec_id, pos::INT pos, round(x / n, 7) x FROM (SELECT vec_id, unnest(range({DIMS})) pos, unnest(embedding::DOUBLE[]) x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) n FROM embeddings)",
    "conversation_sizes": f"SELECT conv_id, sum(len({_TOKENS}))::BIGINT n_tokens FROM conversations GROUP BY conv_id",
    "vocab_quantile_bounds": f"WITH {_ALL} SELECT (SELECT count(*) FROM wc) words, all_tokens::BIGINT all_tokens, least, most FROM bounds",
    "most_common_words": f"WITH {_ALL} SELECT (row_number() OVER (ORDER BY n_total DESC, word) - 1)::INT rank, word, n_total FROM wc ORDER BY rank LIMIT 10",
    "word_topic_lower": f"WITH {_TOPIC_VOCAB} SELECT topic_idx, lower(token) word, count(*) n FROM tok JOIN docs USING (doc_id) WHERE lower(token) IN (SELECT word FROM vocab) GROUP BY ALL",
    "words_per_topic": f"""WITH {_TOPIC_VOCAB}, t AS (SELECT topic_idx, doc_id, ts, unnest(range(len(ts))) pos FROM (SELECT topic_idx, doc_id, {_TOKENS} ts FROM docs))
SELECT topic_idx, doc_id, pos::INT pos, lower(ts[pos + 1]) word FROM t WHERE lower(ts[pos + 1]) IN (SELECT word FROM vocab)""",
    "bag_of_words": f"WITH {_TOPIC_VOCAB} SELECT doc_id, lower(token) word, count(*) n FROM tok WHERE lower(token) IN (SELECT word FROM vocab) GROUP BY ALL",
    "centroid_topwords": f"""WITH {_COUNTS}, {_MEANS}, v AS (SELECT word, {_VECTOR} v FROM vocab),
sc AS (SELECT cnt.topic_idx, word, round(round(list_cosine_similarity(v, c), 9) * n, 7) score, round(list_cosine_similarity(v, c), 9) cosine FROM cnt JOIN v USING (word) JOIN cent USING (topic_idx)),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_idx ORDER BY score DESC, word) - 1 rank, row_number() OVER (PARTITION BY topic_idx ORDER BY cosine DESC, word) - 1 alone FROM sc)
SELECT r.topic_idx, r.rank::INT rank, r.word, round(r.score, 4) score, round(r.cosine, 6) cosine, round(o.cosine, 6) top_cosine FROM r JOIN r o ON r.topic_idx = o.topic_idx AND r.rank = o.alone WHERE r.rank < 10""",
    "word_similarities": f"WITH {_TOPIC_VOCAB}, {_MEANS} SELECT word, topic_idx, round(round(list_cosine_similarity({_VECTOR}, c), 9), 6) cosine FROM vocab, cent",
    "missing_vectors": f"WITH {_ALL} SELECT word FROM vocab WHERE regexp_matches(word, '^[aeiou]')",
    "frobenius_similarity": f"WITH {_DOCS} SELECT doc_id, round(round({_FROBENIUS.format(q=_sql_keyword(0))}, 9), 7) similarity FROM docs",
    "most_similar_docs": f"""WITH {_DOCS}, f AS (SELECT doc_id, round({_FROBENIUS.format(q=_sql_keyword(1))}, 9) s FROM docs)
SELECT (row_number() OVER (ORDER BY s DESC, doc_id) - 1)::INT rank, doc_id, round(s, 7) similarity FROM f ORDER BY rank LIMIT 25""",
    "global_centroid": f"WITH {_DOCS} SELECT pos::INT pos, round(avg(x), 7) x FROM (SELECT unnest(range({DIMS})) pos, unnest(emb) x FROM docs) GROUP BY pos",
    "vocabulary_tokens": f"""WITH t AS (SELECT doc_id, ts, unnest(range(len(ts))) pos FROM (SELECT doc_id, {_TOKENS} ts FROM documents WHERE text <> '')), k AS (SELECT doc_id, pos::INT pos, ts[pos + 1] token FROM t)
SELECT doc_id, pos, token FROM k WHERE regexp_matches(token, '[a-zA-Z]') AND regexp_matches(token, '^\\p{{L}}') AND NOT regexp_matches(token, '\\p{{Nd}}') AND length(token) BETWEEN 3 AND 20 AND lower(token) NOT IN ({_STOP})""",
    "token_totals": "SELECT sum(len(string_split(text, ' ')))::BIGINT n_tokens FROM documents WHERE text <> ''",
    "split_long_documents": """WITH d AS (SELECT doc_id, text, CASE WHEN len(string_split(text, ' ')) > 300 THEN 300 ELSE length(text) END w FROM documents WHERE text <> '')
SELECT doc_id, i::INT chunk, substring(text, (i * w + 1)::INT, w::INT) piece FROM (SELECT doc_id, text, w, unnest(range((length(text) + w - 1) // w)) i FROM d)""",
    "literal_chunks": """WITH d AS (SELECT doc_id, text, length(text) // 2000 n FROM documents WHERE text <> ''), p AS (SELECT doc_id, text, n, unnest(range(greatest(n, 1) + 1)) i FROM d)
SELECT doc_id, i::INT chunk, CASE WHEN i < greatest(n, 1) THEN substring(text, (i * 2000 + 1)::INT, 2000) ELSE substring(text, (n * 2000 + 1)::INT, 2000) END piece FROM p""",
    "token_cut": "SELECT doc_id, array_to_string(string_split(text, ' ')[1:40], ' ') head FROM documents WHERE text <> ''",
    "chunk_mean": f"SELECT doc_id, pos::INT pos, round(avg(x), 7) x FROM (SELECT vec_id // 3 doc_id, unnest(range({DIMS})) pos, unnest(embedding::DOUBLE[]) x FROM embeddings) GROUP BY doc_id, pos",
    "topword_token_budget": f"WITH {_COUNTS}, {_TFIDF}, u AS (SELECT topic_idx, rank, word, sum(length(word) + 1) OVER (PARTITION BY topic_idx ORDER BY rank)::BIGINT used FROM tfidf) SELECT * FROM u WHERE used <= 40",
    "first_documents": f"WITH {_CENTRES}, r AS (SELECT topic_idx, doc_id, (row_number() OVER (PARTITION BY topic_idx ORDER BY similarity DESC, doc_id) - 1)::INT doc_pos FROM own) SELECT topic_idx, doc_pos, doc_id FROM r WHERE doc_pos < 5",
    "topic_json": f"""WITH {_TABLE} SELECT topic_idx, '{{"topic_idx":' || topic_idx || ',"topic_name":"' || topic_name || '","topic_description":"' || topic_description || '"}}' json FROM topic""",
    "topics_json": f"""WITH {_TABLE} SELECT '{{' || string_agg('"' || topic_idx || '":{{"topic_name":"' || topic_name || '","topic_description":"' || topic_description || '"}}', ',' ORDER BY topic_idx::VARCHAR) || '}}' json FROM topic""",
    "topic_information": f"""WITH {_COUNTS}, {_TFIDF}, topic AS (SELECT topic_idx, count(*) n_docs FROM docs WHERE topic_idx >= 0 GROUP BY topic_idx),
w AS (SELECT topic_idx, string_agg(word, ', ' ORDER BY rank) ws FROM tfidf WHERE rank < 5 GROUP BY topic_idx)
SELECT topic_idx, array_to_string(string_split('Topic ' || topic_idx || ': t' || topic_idx || chr(10) || 'about' || chr(10) || 'Documents: ' || n_docs || chr(10) || 'Words: ' || coalesce(ws, ''), ' ')[1:20], ' ') information
FROM topic LEFT JOIN w USING (topic_idx) WHERE topic_idx IN (0, 2, 5)""",
    "split_words": f"""WITH {_TOPIC_VOCAB}
SELECT DISTINCT part, word FROM (SELECT (doc_id % 2)::INT part, unnest(string_split(text, ' ')) word FROM docs WHERE topic_idx = 0) WHERE word IN (SELECT word FROM vocab)""",
    "split_topic_single_keyword": f"""WITH {_DOCS}, kw AS (SELECT 0 keyword_idx, {_sql_keyword(3)} v UNION ALL SELECT 1, {_sql_keyword(5)}),
near AS (SELECT doc_id, keyword_idx::INT keyword_idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(emb, v), 9) DESC, keyword_idx) r FROM docs, kw WHERE topic_idx = 3)
SELECT doc_id, keyword_idx FROM near WHERE r = 1""",
    "split_topic_assignments": f"""WITH {_DOCS}, m AS (SELECT doc_id, topic_idx = 1 AND doc_id % 3 = 0 is_noise, CASE WHEN topic_idx = 1 THEN 1000 + doc_id % 3 ELSE topic_idx END topic_idx FROM docs),
x AS ({_compact("m")}) SELECT doc_id, x.topic_idx, is_noise FROM x JOIN m USING (doc_id)""",
    "delete_topic_orphans": f"""WITH {_CENTRES}, near AS (SELECT doc_id, cent.topic_idx, row_number() OVER (PARTITION BY doc_id ORDER BY round(list_cosine_similarity(emb, c), 9) DESC, cent.topic_idx) r
FROM docs, cent WHERE docs.topic_idx = 1 AND cent.topic_idx <> 1), m AS (SELECT doc_id, topic_idx FROM near WHERE r = 1 UNION ALL SELECT doc_id, topic_idx FROM docs WHERE topic_idx >= 0 AND topic_idx <> 1) {_compact('m')}""",
    "compact_labels": f"WITH {_DOCS}, m AS (SELECT doc_id, CASE WHEN topic_idx IN (2, 4) THEN -1 ELSE topic_idx END topic_idx FROM docs) {_compact('m')}",
    "plot_hover": f"WITH {_DOCS} SELECT doc_id, topic_idx, substring(text, 1, 200) hover FROM docs WHERE topic_idx >= 0",
}
