"""What the training-data operators share: the work folder, and vectorised hashing of words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a single-machine session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="topicloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a work folder through Hadoop's file system, whatever store it is in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one job in the shared folder; all but those to ``keep`` are removed at its end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.count = spark, work_path(spark, name), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: cuts the lineage and survives lost executors."""
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The job's result as a table outside the workspace; the workspace goes."""
        out = materialise(df, name)
        delete(self.spark, self.base)
        return out


def lookup(rows: DataFrame, key: str, table: DataFrame, salt, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``, where a few keys may hold most rows.

    ``salt`` deals the rows of a key to groups. A key's row of ``table`` is sent
    once to each of the key's groups, so a hot key never meets in one task.
    """
    salted = rows.withColumn("_salt", salt)
    found = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(found, [key, "_salt"], how).drop("_salt")


def by_hash(col: str, groups: int = 16):
    """Group of a value, as a salt for :func:`lookup`."""
    return F.pmod(F.xxhash64(col), F.lit(groups)).cast("int")


def proper_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether every id is present, a long below the largest one, and no other row's."""
    key = F.col(id_col).cast("long")
    bad = docs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("k").isNull() | (F.col("k") == 2**63 - 1) | (F.col("n") > 1))
    return bad.isEmpty()


def with_row_key(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """``docs`` with a column ``key``: a long, present and distinct in every row, in the order of the ids; null ids come last.

    Where the ids are like that themselves they are the keys. Else the rows are
    sorted by id, at random among equal ids, and written with their place.
    """
    own = docs.withColumn(key, F.col(id_col).cast("long"))
    if proper_ids(docs, id_col):
        return own
    rows = own.withColumn("_tie", F.rand(1)).orderBy(F.col(key).asc_nulls_last(), "_tie").drop("_tie")
    return materialise(rows.withColumn(key, F.monotonically_increasing_id()), "row-keys")


def row_parts(df: DataFrame, rows: int) -> int:
    """Number of partitions or groups with about so many rows each."""
    return max(1, -(-df.count() // rows))


# ---- vectorised word hashing -------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_RADIX = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    np.multiply.accumulate(out, out=out)
    return out


class Words:
    """Word bounds and 64-bit hashes of many texts at once.

    Texts are UTF-8 byte strings; a word is a run of bytes outside ``SPACES``
    (multi-byte characters hold none of these bytes). ``first[i]:first[i + 1]``
    are the words of text i; ``start`` and ``end`` are offsets into ``data``.
    """

    def __init__(self, texts: list[bytes], hashes: bool = True):
        data = b" ".join(texts) + b" "
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.begin = begins
        self.first = np.searchsorted(self.start, begins)
        if hashes:
            self.hash = self._hashes(raw)

    def _hashes(self, raw: np.ndarray) -> np.ndarray:
        """Sum of byte keys times powers of an odd radix, counted from the word's start, then mixed with the length."""
        n = len(self.start)
        out = np.zeros(n, np.uint64)
        length = self.end - self.start
        if not n:
            return out
        short = int(min(length.max(), 48))
        powers = _powers(_RADIX, short)
        alive, at = np.arange(n), self.start
        for k in range(short):
            if k:
                keep = length[alive] > k
                alive = alive[keep]
            out[alive] += _BYTE[raw[at[alive] + k]] * powers[k]
        for i in np.flatnonzero(length > short):  # rest of the few long words
            tail = raw[self.start[i] + short : self.end[i]]
            key = _BYTE[tail] * _powers(_RADIX, len(tail) + short)[short:]
            out[i] += key.sum(dtype=np.uint64)
        return mix(out ^ (length.astype(np.uint64) * _ODD))


def grams(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all n-grams of one word sequence."""
    if len(word_hash) < n:
        return np.zeros(0, np.uint64)
    powers = _powers(_RADIX, n)
    out = np.zeros(len(word_hash) - n + 1, np.uint64)
    for k in range(n):
        out += word_hash[k : k + len(out)] * powers[k]
    return mix(out)


def bounded_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python hold so many rows and bytes at most, so long texts don't pile up.

    Sets the caller's session, as plans read these settings when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


class Windows:
    """Hashes of all windows of ``size`` words of a batch of texts; windows never cross texts.

    ``at`` are the windows' first words (indices into the batch's words), ``of``
    the text of each, ``hash`` their hashes.
    """

    def __init__(self, words: Words, size: int):
        n = len(words.hash)
        counts = np.diff(words.first)
        self.text_of = np.repeat(np.arange(len(counts)), counts)
        ends = np.repeat(words.first[1:], counts)
        self.all = grams(words.hash, size)
        fits = np.arange(len(self.all)) + size <= ends[: len(self.all)] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(fits)
        self.of = self.text_of[self.at]
        self.hash = self.all[self.at]
        self.bounds = np.searchsorted(self.of, np.arange(len(counts) + 1))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
