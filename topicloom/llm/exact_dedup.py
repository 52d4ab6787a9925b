"""Exact dedup: skew-safe combining of equal normalised texts, DataFrame functions only.

Three stages, each comparing whole contents and not only digests:

1. *local*: each task combines its own equal texts (map-side aggregation);
2. *salted*: the task winners of a digest meet in up to ``salts`` groups, so that
   no group of copies lands in one task;
3. *global*: the at most ``salts`` winners of each digest are combined.

Defined cases: a null text counts as empty; texts equal after white-space runs
become one space are copies; of copies the smallest id stays; rows with a null
id stay only if their group has no other id; rows that repeat the kept id are
all marked kept; an empty table gives an empty result. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import SPACES, by_hash, lookup, materialise

SALTS = 16


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, digest) of each row."""
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    src = docs.select(F.col(id_col).cast("long").alias("id"), norm.alias("norm"))
    return src.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id, group_size."""
    rows = keyed(docs, id_col, text_col).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.repartition("digest").groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def digests(groups: DataFrame) -> DataFrame:
    """One row per digest: digest, contents, keep_id, group_size."""
    totals = [F.count(F.lit(1)).alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    return materialise(groups.groupBy("digest").agg(*totals), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows meet their group, dealt by salts, on the digest alone where that digest stands for one
    content, which the third stage has found by comparing contents; a digest of
    several contents (never seen for SHA-256) is joined on the content as well.
    """
    groups = text_groups(docs, id_col, text_col, salts)
    by_digest = digests(groups)
    rows = keyed(docs, id_col, text_col)
    hashed = materialise(rows.select("id", "digest"), "exact-digests")  # texts are hashed once, not for each side of the lookup
    found = lookup(hashed, "digest", by_digest.filter("contents = 1").drop("contents"), by_hash("id", salts))
    several = by_digest.filter("contents > 1").select("digest")
    if not several.isEmpty():
        own = groups.join(several, "digest", "left_semi")
        found = found.unionByName(rows.join(own, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group, of smallest id, or of null id where the group has no other.

    Rows are chosen by id and content, so an id may be null or stand for several
    texts. Of rows that repeat both, each task keeps one before they meet.
    """
    groups = text_groups(docs, id_col, text_col)
    by_digest = digests(groups)
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")
    rows = docs.withColumn("_id", F.col(id_col).cast("long")).withColumn("_digest", F.unhex(F.sha2(norm, 256)))
    rows = rows.withColumn("_null", F.col("_id").isNull()).withColumn("_id", F.coalesce("_id", F.lit(0)))
    winner = [F.coalesce("keep_id", F.lit(0)).alias("_id"), F.col("keep_id").isNull().alias("_null"), F.col("digest").alias("_digest")]
    keys = ["_id", "_null", "_digest"]
    stay = by_digest.filter("contents = 1").select(*winner)
    several = by_digest.filter("contents > 1").select("digest")
    if several.isEmpty():
        return rows.dropDuplicates(keys).join(stay, keys, "left_semi").select(docs.columns)
    own = groups.join(several, "digest", "left_semi").select(*winner, F.col("norm").alias("_norm"))
    more = rows.withColumn("_norm", norm).dropDuplicates([*keys, "_norm"]).join(own, [*keys, "_norm"], "left_semi")
    return rows.dropDuplicates(keys).join(stay, keys, "left_semi").select(docs.columns).unionByName(more.select(docs.columns))
