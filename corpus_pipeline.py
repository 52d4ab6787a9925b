"""From raw documents to packed sequences; each stage is one operator of the ``llm`` subpackage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import exact_dedup, langid, minhash, packing, substring_dedup
from topicloom.llm.queries import tokenizer_path
from topicloom.llm.shared import materialise, with_row_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and those without a letter. Every other one is given a language and stays, whatever its score.

    Rows of null or repeated ids are judged each; an empty table gives an empty one; other columns stay.
    """
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the smallest doc_id; a null doc_id only if the text has no other. Empty tables and other columns pass."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a 5-word-shingle similarity of 0.80 or more one row stays, of the smallest doc_id; null ones come last."""
    return minhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier elsewhere; documents of which no word is left go, n_chars is counted anew.

    Every row is a document of its own, whether its doc_id is null or repeated; null ones come last.
    """
    rows = with_row_key(docs, "doc_id", "_row")
    left = substring_dedup.substring_dedup(rows, id_col="_row", with_text=True).filter("n_words > n_removed").select(F.col("doc_id").alias("_row"), "kept_text")
    out = rows.join(left, "_row").withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("substrings", substrings), ("packed", packed)]

#: Tokenizers and the recurrent network can't be expressed in SQL; tests/llm compares their operators with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
