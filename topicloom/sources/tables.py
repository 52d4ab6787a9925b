"""Sources and sinks of the normalised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.sources.work import exists


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) without empty documents; vectors stay aligned because they are joined by id."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text <> ''")


def csv_corpus(spark: SparkSession, path: str, column: int, rows: int | None = None) -> DataFrame:
    """Corpus from one column (from 0) of a CSV file without a header; ids are places in the file, ``rows`` keeps the first ones.

    A file with quoted line breaks is read by one task, so places follow its order.
    """
    found = spark.read.csv(path, header=False, multiLine=True, escape='"')
    placed = found.withColumn("doc_id", F.monotonically_increasing_id())
    return corpus(placed if rows is None else placed.orderBy("doc_id").limit(rows), text_col=found.columns[column])


def assigned(spark: SparkSession, base: str) -> DataFrame:
    """Documents with a vector: doc_id, text, emb_hd, topic_idx (-1: outlier)."""
    vectors = read_table(spark, base, "embeddings").selectExpr("vec_id doc_id", "embedding emb_hd", "label topic_idx")
    return corpus(read_table(spark, base, "documents")).join(vectors, "doc_id")


#: The tables of a saved model and the columns each must have.
MODEL_TABLES = {
    "documents": ["doc_id", "text", "emb_hd", "emb_ld", "topic_idx", "doc_pos", "similarity"],
    "topics": ["topic_idx", "topic_name", "topic_description", "centroid_hd", "centroid_ld", "n_docs"],
    "vocabulary": ["word"],
    "top_words": ["topic_idx", "method", "rank", "word", "score"],
}


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Saved tables; one that lacks columns of a model's table is an error."""
    out = {}
    for name in names:
        out[name] = spark.read.parquet(f"{path}/{name}")
        if lacks := set(MODEL_TABLES.get(name, ())) - set(out[name].columns):
            raise ValueError(f"{name} lacks {', '.join(sorted(lacks))}")
    return out


def save_embeddings(doc_vectors: DataFrame, word_vectors: DataFrame, path: str) -> None:
    """Vectors of documents (doc_id, emb_hd) and words (word, emb_hd) for later runs."""
    if doc_vectors is None or word_vectors is None:
        raise ValueError("both sets of vectors must be there")
    save_model({"doc_vectors": doc_vectors, "word_vectors": word_vectors}, path)


def load_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Saved vectors, None where none were saved."""
    if not all(exists(spark, f"{path}/{name}/_SUCCESS") for name in ("doc_vectors", "word_vectors")):
        return None
    return tuple(load_model(spark, path, ["doc_vectors", "word_vectors"]).values())
