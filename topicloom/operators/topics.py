"""Topics: centroids, ranking of documents, search, and editing of the assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.functions.vectors import cosine, mean_vectors


#: More points than this are joined, not sent to every row as an array.
MOST_POINTS = 4096


def centroids(docs: DataFrame, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(topic_idx, centroid), without outliers."""
    return mean_vectors(docs.filter("topic_idx >= 0"), ["topic_idx"], vec, centre)


def global_centroid(docs: DataFrame, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """One row: the mean vector of all documents."""
    return mean_vectors(docs, [], vec, centre)


def similarities(docs: DataFrame, centres: DataFrame, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """Cosine of each document to its own topic's centroid."""
    return docs.join(centres, "topic_idx").withColumn("similarity", F.round(cosine(F.col(vec), F.col(centre)), 9))


def ranked_documents(docs: DataFrame, centres: DataFrame | None = None, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(topic_idx, doc_id, doc_pos, similarity): place of each document in its topic."""
    order = Window.partitionBy("topic_idx").orderBy(F.col("similarity").desc(), "doc_id")
    own = similarities(docs, centroids(docs, vec, centre) if centres is None else centres, vec, centre)
    return own.select("topic_idx", "doc_id", (F.row_number().over(order) - 1).alias("doc_pos"), "similarity")


def knn_search(docs: DataFrame, query: Column, topic: int, k: int = 20, tokens: Column | None = None, per_doc: int = 1000, budget: int = 15_000) -> DataFrame:
    """The k nearest documents of a topic, cut where their tokens pass the budget."""
    size = tokens if tokens is not None else F.size(F.split("text", " "))
    near = docs.filter(F.col("topic_idx") == topic).select("doc_id", F.round(cosine(F.col("emb_hd"), query), 9).alias("similarity"), F.least(size, F.lit(per_doc)).alias("n_tokens"))
    top = near.orderBy(F.col("similarity").desc(), "doc_id").limit(k)
    order = Window.orderBy(F.col("similarity").desc(), "doc_id")
    placed = top.withColumn("rank", F.row_number().over(order) - 1).withColumn("used", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.filter(F.col("used") <= budget).select("rank", "doc_id", "similarity", "n_tokens", "used")


def reindexed(assignment: DataFrame) -> DataFrame:
    """Topic indices made consecutive from 0; outliers stay -1. Only the distinct topics are sorted."""
    own = assignment.select("topic_idx").filter("topic_idx >= 0").distinct()
    new = own.withColumn("new", F.row_number().over(Window.orderBy("topic_idx")) - 1)
    return assignment.join(F.broadcast(new), "topic_idx", "left").withColumn("topic_idx", F.coalesce("new", F.lit(-1))).drop("new")


def combine_topics(assignment: DataFrame, topics: list[int]) -> DataFrame:
    """One topic in place of several; it comes last."""
    merged = F.when(F.col("topic_idx").isin(topics), F.lit(2**31 - 1)).otherwise(F.col("topic_idx"))
    return reindexed(assignment.withColumn("topic_idx", merged))


def nearest(docs: DataFrame, points: DataFrame, vec: str, centre: str, name: str) -> DataFrame:
    """Each row with the nearest of a few points (a topic's centroids or a caller's keywords); ties go to the lowest index.

    Up to ``MOST_POINTS`` points go to every row as one array: no shuffle, and rows of one id stay apart. More are joined.
    """
    index = F.col(name).cast("int")
    if points.count() > MOST_POINTS:
        near = docs.crossJoin(points).withColumn("sim", F.round(cosine(F.col(vec), F.col(centre)), 9))
        return near.groupBy("doc_id").agg(F.max_by(index, F.struct("sim", -index)).alias(name))
    every = points.agg(F.collect_list(F.struct((-index).alias("i"), F.col(centre).alias("p"))).alias("_points"))
    best = F.array_max(F.transform("_points", lambda x: F.struct(F.round(cosine(F.col(vec), x["p"]), 9).alias("sim"), x["i"].alias("i"))))
    return docs.crossJoin(F.broadcast(every)).select("doc_id", (-best["i"]).alias(name))


def delete_topics(docs: DataFrame, topics: list[int], centres: DataFrame | None = None, vec: str = "emb_hd", centre: str = "centroid_hd", only_orphans: bool = False) -> DataFrame:
    """(doc_id, topic_idx): every document that isn't an outlier goes to the nearest centroid that is left; with ``only_orphans`` only those of the deleted topics."""
    left = (centroids(docs, vec, centre) if centres is None else centres).filter(~F.col("topic_idx").isin(topics))
    inner = docs.filter("topic_idx >= 0")
    if not only_orphans:
        return reindexed(nearest(inner.select("doc_id", vec), left, vec, centre, "topic_idx"))
    gone = F.col("topic_idx").isin(topics)
    moved = nearest(inner.filter(gone).select("doc_id", vec), left, vec, centre, "topic_idx")
    return reindexed(inner.filter(~gone).select("doc_id", "topic_idx").unionByName(moved))


def split_by_keywords(docs: DataFrame, topic: int, keywords: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, keyword_idx) of a topic's documents; keywords: keyword_idx, emb_kw. With ``strict`` one keyword for all documents is an error."""
    out = nearest(docs.filter(F.col("topic_idx") == topic).select("doc_id", "emb_hd"), keywords, "emb_hd", "emb_kw", "keyword_idx")
    if strict and out.select("keyword_idx").distinct().count() < 2:
        raise ValueError("all documents of the topic are nearest to one keyword")
    return out


def split_by_assignment(docs: DataFrame, topic: int, parts: DataFrame) -> DataFrame:
    """(doc_id, topic_idx, is_noise): a topic in parts (doc_id, part), which come last in order of ``part``; a part -1 becomes a topic as well."""
    own = docs.select("doc_id", "topic_idx").join(parts.select("doc_id", "part"), "doc_id", "left")
    mine = F.col("topic_idx") == topic
    rank = parts.select("part").distinct().withColumn("new", F.row_number().over(Window.orderBy("part")) + (2**31 - 2 - MOST_POINTS))
    placed = own.join(F.broadcast(rank.limit(MOST_POINTS)), "part", "left")
    return reindexed(placed.select("doc_id", F.when(mine & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("topic_idx")).alias("topic_idx"), (mine & (F.col("part") == -1)).alias("is_noise")))


def add_topic(docs: DataFrame, keyword: Column, centres: DataFrame | None = None, vec: str = "emb_hd", centre: str = "centroid_hd") -> DataFrame:
    """(doc_id, topic_idx): documents strictly closer to the keyword than to their own centroid form a new last topic."""
    own = similarities(docs, centroids(docs, vec, centre) if centres is None else centres, vec, centre)
    closer = F.round(cosine(F.col(vec), keyword), 9) > F.col("similarity")
    return reindexed(own.select("doc_id", F.when(closer, F.lit(2**31 - 1)).otherwise(F.col("topic_idx")).alias("topic_idx")))


def topic_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("topic_idx").agg(F.count(F.lit(1)).alias("n_docs"))


