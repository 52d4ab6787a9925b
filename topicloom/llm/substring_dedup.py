"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. A word goes if some window that covers
it has a word sequence which starts earlier: in a document of smaller id, or
earlier in the same document. Windows are judged on the input.

Fingerprints. Of the ``GRAM``-word hashes inside a window the smallest is its
fingerprint. Equal windows have equal fingerprints, and consecutive windows
mostly share theirs, so about one fingerprint in seven words stands for all
windows (winnowing), and nothing is lost.

Index. Documents come in batches. Each batch becomes one immutable run, sorted
by fingerprint, with the number of its documents that hold it. Before it is
added it is merge-joined with the runs of earlier batches; fingerprints that two
documents share are kept aside. When there are more than ``FANOUT`` runs the
oldest are compacted into one. Runs are bucketed by fingerprint, so neither the
merge-join nor the compaction shuffles them again.

An index in a ``folder`` outlives the job. ``FingerprintIndex(spark, folder)``
opens it again, and ``dedup_batch`` judges new documents against all it holds,
which come before every new one, whatever the ids. It keeps the texts, as a
window of an old document is only looked at when a new one shares its
fingerprint. A batch counts as indexed once its result is written; a job that
dies before leaves the index as it was.

Verification. Documents with shared fingerprints send exactly those windows whose
fingerprint is shared: a 64-bit rolling hash, and 64 bits of a keyed BLAKE2b
digest of the window's words themselves, under a random key of the index; both
must agree. Repeats inside one document need no exchange: windows of equal hash
are compared word for word. The smallest id of each window is found in two steps,
salted by document, so that a window of very many documents is not gathered in
one task. Documents that repeat another word for word lose all words without
sending windows; they meet it on a digest of the text, in salted parts.

Defined cases: a null text has no words; texts of fewer words than a window lose
none; rows with null ids come after all others, and rows with equal ids count as
one document, which do not remove each other's words; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import secrets
import uuid
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.shared import Windows, Words, bounded_batches, by_hash, delete, grams, lookup, signed, sliding_min, work_path

WINDOW, GRAM = 20, 8
BATCHES, FANOUT, SALTS = 3, 2, 8
FIRST, LAST = -(2**63), 2**63 - 1
LOG = "doc long, n_words long, digest binary, prints array<long>"
TEXTS = "doc long, text string"
COPIES = "doc long, digest binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _texts(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _digest(text: bytes) -> bytes:
    """Of the word sequence of a text."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _check(words: bytes, key: bytes) -> bytes:
    """Of the words of a window, joined by one space."""
    return hashlib.blake2b(words, digest_size=8, key=key).digest()


def _prints(words: Words, windows: Windows, window: int, gram: int) -> np.ndarray:
    """The fingerprint of each window of the batch."""
    return sliding_min(grams(words.hash, gram), window - gram + 1)[windows.at]


def _log_rows(window: int, gram: int):
    """Per document: id, number of words, digest of the word sequence, distinct fingerprints."""

    def batches(it):
        for batch in it:
            texts = _texts(batch.column(1))
            words = Words(texts)
            windows = Windows(words, window)
            prints = signed(_prints(words, windows, window, gram))
            parts = [np.unique(prints[a:b]) for a, b in zip(windows.bounds, windows.bounds[1:], strict=False)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            digests = [_digest(t) for t in texts]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(digests, pa.binary()), lists], ["doc", "n_words", "digest", "prints"])

    return batches


class FingerprintIndex:
    """Sorted runs of (fingerprint, number of documents), bucketed alike, and what is needed to look at indexed documents again.

    In a ``folder`` that all executors share the index is kept: window, gram and
    buckets are then those it was made with. Without one it lives for one job.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.stored, self.fanout = spark, folder is not None, fanout
        self.base = folder.rstrip("/") if folder else work_path(spark, "fingerprints")
        self.name = f"prints_{uuid.uuid4().hex}"
        self.window, self.gram, self.key = window, gram, secrets.token_bytes(16)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.runs: list[str] = []  # tables of fingerprints
        self.shared: list[str] = []  # tables of fingerprints that the open batches share
        self.open: list[dict] = []  # batches that are not judged yet
        self.judged: list[dict] = []  # groups of batches that were judged together
        self.replaced: list[str] = []  # runs that the last state still names
        if self.stored:
            self._load()

    # -- state

    def _load(self) -> None:
        """Take the newest state of the folder, if it holds one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/states")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return
        last = self.spark.read.schema("version long, state string").json(f"{self.base}/states").orderBy(F.desc("version")).first()
        if last is None:
            return
        state = json.loads(last.state)
        self.version, self.key = last.version, bytes.fromhex(state["key"])
        self.window, self.gram, self.buckets, self.judged = state["window"], state["gram"], state["buckets"], state["judged"]
        for path in state["runs"]:
            name = f"{self.name}_{path.rsplit('-', 1)[1]}"
            self.spark.sql(f"CREATE TABLE {name} (print BIGINT, n BIGINT) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.runs.append(name)

    def _save(self) -> None:
        """One more state; what it no longer names can go."""
        self.version += 1
        state = {"key": self.key.hex(), "window": self.window, "gram": self.gram, "buckets": self.buckets, "judged": self.judged, "runs": [self._path(r) for r in self.runs]}
        row = self.spark.createDataFrame([(self.version, json.dumps(state))], "version long, state string")
        row.coalesce(1).write.mode("append").json(f"{self.base}/states")
        for name in self.replaced:
            self._drop(name)
        self.replaced = []

    def _table(self, df: DataFrame, name: str) -> str:
        """Path of a new table of the index."""
        path = f"{self.base}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    # -- runs

    def _write(self, rows: DataFrame) -> str:
        made = uuid.uuid4().hex
        name = f"{self.name}_{made}"
        rows.write.format("parquet").option("path", f"{self.base}/run-{made}").bucketBy(self.buckets, "print").sortBy("print").saveAsTable(name)
        return name

    def _path(self, name: str) -> str:
        return f"{self.base}/run-{name.removeprefix(self.name + '_')}"

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self._path(name))

    def append(self, log: DataFrame) -> None:
        """Add the fingerprints of one batch: build its run, merge-join it with the history, compact if there are many runs."""
        prints = log.select(F.explode("prints").alias("print"))
        counted = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
        run = self._write(counted)
        new = self.spark.table(run)
        shared = F.col("n") > 1
        for k, old in enumerate(self.runs):
            new = new.join(self.spark.table(old).select("print", F.lit(True).alias(f"old{k}")), "print", "left")
            shared = shared | F.col(f"old{k}").isNotNull()
        self.shared.append(self._write(new.filter(shared).select("print")))
        self.runs.append(run)
        if len(self.runs) > self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge the runs but the newest into one."""
        old, new = self.runs[:-1], self.runs[-1]
        merged = self.spark.table(old[0])
        for run in old[1:]:
            other = self.spark.table(run).withColumnRenamed("n", "m")
            merged = merged.join(other, "print", "full").select("print", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        self.runs = [self._write(merged), new]
        if self.stored:
            self.replaced += old  # until a state without them is saved
        else:
            for run in old:
                self._drop(run)

    def repeated(self) -> DataFrame:
        """Distinct fingerprints of the open batches that at least two documents hold."""
        # read as plain files: a union of bucketed tables must not pass for a partitioned whole
        return self.spark.read.schema("print long").parquet(*[self._path(name) for name in self.shared]).distinct()

    # -- documents

    def add(self, rows: DataFrame) -> None:
        """Add a batch of documents (doc, text), to be judged by the next call of :meth:`judge`."""
        text = None
        if self.stored:
            text = self._table(rows, "texts")
            rows = self._read(text, TEXTS)
        log = self._table(rows.mapInArrow(_log_rows(self.window, self.gram), LOG), "log")
        self.append(self._read(log, LOG))
        self.open.append({"log": log, "text": text, "rows": rows})

    def _old(self, group: dict, repeated: DataFrame) -> DataFrame:
        """Windows of an indexed group of batches whose fingerprint a new document holds."""
        log = reduce(DataFrame.unionByName, [self._read(p, LOG) for p in group["logs"]])
        rows = reduce(DataFrame.unionByName, [self._read(p, TEXTS) for p in group["texts"]])
        return self._windows(rows, self._shared(log, repeated, self._read(group["copies"], COPIES)))

    def _shared(self, log: DataFrame, repeated: DataFrame, copies: DataFrame) -> DataFrame:
        """Per document that isn't a copy: its shared fingerprints."""
        prints = log.select("doc", "digest", F.explode("prints").alias("print")).join(repeated, "print", "left_semi")
        return prints.join(copies, ["doc", "digest"], "left_anti").groupBy("doc").agg(F.collect_set("print").alias("shared"))

    def _windows(self, rows: DataFrame, shared: DataFrame) -> DataFrame:
        found = rows.join(shared, "doc").select("doc", "text", "shared")
        return found.mapInArrow(_window_rows(self.window, self.gram, self.key), "hash long, check long, doc long")

    def judge(self, with_text: bool = False) -> DataFrame:
        """The result for each row of the open batches, which are history from then on."""
        log = reduce(DataFrame.unionByName, [self._read(b["log"], LOG) for b in self.open])
        rows = reduce(DataFrame.unionByName, [b["rows"] for b in self.open])
        long = log.filter(F.col("n_words") >= self.window)
        first = long.groupBy("digest").agg(F.min("doc").alias("first"))
        if self.judged:
            known = reduce(DataFrame.unionByName, [self._read(p, LOG) for g in self.judged for p in g["logs"]]).select("digest").distinct()
            first = first.join(known.withColumn("known", F.lit(True)), "digest", "left").select("digest", "first", "known")
        else:
            first = first.withColumn("known", F.lit(None).cast("boolean"))
        copies = lookup(long.select("doc", "digest"), "digest", first, by_hash("doc")).filter(F.col("known") | (F.col("doc") > F.col("first")))
        copied = self._table(copies.select("doc", "digest").distinct(), "copies")
        copies = self._read(copied, COPIES)
        repeated = self.repeated()
        shared = self._read(self._table(self._shared(log, repeated, copies), "shared"), "doc long, shared array<long>")
        candidates = self._windows(rows, shared)
        for group in self.judged:
            candidates = candidates.unionByName(self._old(group, repeated).withColumn("doc", F.lit(FIRST)))
        if not self.stored:  # an index of one job: what follows needs its texts, copies and shared fingerprints only
            for name in [*self.runs, *self.shared]:
                self._drop(name)
            for batch in self.open:
                delete(self.spark, batch["log"])
        candidates = candidates.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        salted = candidates.withColumn("least", F.min("doc").over(Window.partitionBy("hash", "check", "salt")))
        later = salted.filter("doc > least").select("doc", "hash", "check")
        winners = salted.filter("doc = least").withColumn("first", F.min("doc").over(Window.partitionBy("hash", "check")))
        later = later.unionByName(winners.filter("doc > first").select("doc", "hash", "check"))
        elsewhere = later.groupBy("doc").agg(F.collect_list(F.struct("hash", "check")).alias("w"))
        elsewhere = elsewhere.select("doc", F.lit(None).cast("array<binary>").alias("copies"), F.col("w.hash").alias("hash"), F.col("w.check").alias("check"))
        none = F.lit(None).cast("array<long>")
        whole = copies.groupBy("doc").agg(F.collect_set("digest").alias("copies")).select("doc", "copies", none.alias("hash"), none.alias("check"))
        both = elsewhere.unionByName(whole).groupBy("doc").agg(*[F.first(c, True).alias(c) for c in ("copies", "hash", "check")])
        out = rows.join(both, "doc", "left").select("doc", "text", "copies", "hash", "check").mapInArrow(_kept_rows(self.window, with_text, self.key), RESULT + ", kept_text string" * with_text)
        out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))
        if self.stored:
            out = self.spark.read.schema(out.schema).parquet(self._table(out, "result"))
            self.judged.append({"logs": [b["log"] for b in self.open], "texts": [b["text"] for b in self.open], "copies": copied})
            self.replaced += self.shared
            self._save()
        self.open, self.shared = [], []
        return out

    def drop(self) -> None:
        for name in [*self.runs, *self.shared, *self.replaced]:
            self._drop(name)
        delete(self.spark, self.base)


def _window_rows(window: int, gram: int, key: bytes):
    """(hash, check, doc) of a document's distinct windows whose fingerprint is shared. Columns: id, text, shared fingerprints."""

    def batches(it):
        for batch in it:
            words = Words([b" ".join(t.split()) for t in _texts(batch.column(1))])
            windows = Windows(words, window)
            prints = signed(_prints(words, windows, window, gram))
            hashes, shared = signed(windows.hash), batch.column(2)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for k, (a, b) in enumerate(zip(windows.bounds, windows.bounds[1:], strict=False)):
                own = np.flatnonzero(np.isin(prints[a:b], shared[k].values.to_numpy())) + a
                _, first = np.unique(hashes[own], return_index=True)
                out.append(own[first])
            pick = np.concatenate([*out, np.zeros(0, np.int64)]).astype(np.int64)
            for at in range(0, len(pick), 200_000):
                part = pick[at : at + 200_000]
                begin, end = words.start[windows.at[part]].tolist(), words.end[windows.at[part] + window - 1].tolist()
                check = np.frombuffer(b"".join([_check(words.data[i:j], key) for i, j in zip(begin, end, strict=True)]), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(hashes[part]), pa.array(check), pa.array(ids[windows.of[part]])], ["hash", "check", "doc"])

    return batches


def _repeats(hashes: np.ndarray, words_of) -> np.ndarray:
    """Which windows of one document have the words of an earlier one; ``words_of`` gives the words of a window."""
    again = np.zeros(len(hashes), bool)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    if len(first) == len(hashes):
        return again
    first = first[group]
    for i in np.flatnonzero(first != np.arange(len(hashes))).tolist():
        own = words_of(i)
        again[i] = own == words_of(first[i]) or any(own == words_of(j) for j in np.flatnonzero(hashes[:i] == hashes[i]))
    return again


def _kept_rows(window: int, with_text: bool, key: bytes):
    """The result of each document. Columns: id, text, digests of it that are copies, hashes and checks of windows that start earlier elsewhere."""

    def batches(it):
        for batch in it:
            texts = _texts(batch.column(1))
            plain = [b" ".join(t.split()) for t in texts]
            words = Words(plain)
            windows = Windows(words, window)
            hashes = signed(windows.hash)
            n = len(words.hash)
            flagged = np.zeros(n + 1, np.int64)
            copies, other, check = batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            begin, end = (memoryview(x.astype(np.int64)) for x in (words.start[windows.at], words.end[windows.at + window - 1])) if len(windows.at) else ((), ())

            def words_of(i: int, data=words.data, begin=begin, end=end) -> bytes:
                return data[begin[i] : end[i]]

            for k, (a, b) in enumerate(zip(windows.bounds, windows.bounds[1:], strict=False)):
                if a == b:
                    continue
                at = windows.at[a:b]
                if copies[k] and _digest(plain[k]) in copies[k]:
                    flagged[at] = 1
                    continue
                own = hashes[a:b]
                flagged[at[_repeats(own, lambda i, a=a: words_of(a + i))]] = 1
                if other[k].is_valid:
                    found = other[k].values.to_numpy()
                    pairs = set(zip(found.tolist(), check[k].values.to_pylist(), strict=True))
                    for i in np.flatnonzero(np.isin(own, found)).tolist():
                        if (int(own[i]), int.from_bytes(_check(words_of(a + i), key), "little", signed=True)) in pairs:
                            flagged[at[i]] = 1
            total = np.cumsum(flagged[:n])
            removed = total > 0
            removed[window:] = total[window:] > total[:-window]
            counts, gone, shas, kept_texts = [], [], [], []
            for k, text in enumerate(texts):
                cut = removed[words.first[k] : words.first[k + 1]]
                left = b" ".join(compress(plain[k].split(), ~cut)) if cut.any() else plain[k]
                counts.append(len(cut))
                gone.append(np.count_nonzero(cut))
                shas.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept_texts.append(_cut(text, cut).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept_texts, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return batches


def _cut(text: bytes, cut: np.ndarray) -> bytes:
    """The text without the removed words; what stays in one piece keeps its white space."""
    if not cut.any():
        return text
    words = Words([text], hashes=False)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], cut, [True]]).astype(np.int8)))
    return b" ".join(words.data[words.start[i] : words.end[j - 1]] for i, j in zip(edge[0::2], edge[1::2], strict=True))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))


def dedup_batch(index: FingerprintIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of a new batch, judged against the batch and everything indexed, as in :func:`substring_dedup`; then the batch is indexed."""
    bounded_batches(docs.sparkSession)
    index.add(_rows(docs, id_col, text_col))
    return index.judge(with_text)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the text that is left. The index takes the table in batches of ids and goes at the end."""
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    cuts = sorted(set(rows.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01)))
    index = FingerprintIndex(docs.sparkSession, window=window, gram=gram)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = rows
        if low is not None:
            batch = batch.filter(F.col("doc") > int(low))
        if high is not None:
            batch = batch.filter(F.col("doc") <= int(high))
        index.add(batch)
    return index.judge(with_text)
