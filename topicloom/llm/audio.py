"""Media columns: chroma audio fingerprints.

*Frames.* Overlapping windows of the samples are transformed, and their energy is
folded into 12 pitch classes, then normalised.
*Filters.* Over the frames' integral image, each of 16 filters compares two areas
of time by pitch class and quantises the log ratio to 2 bits (Gray coded); 16
filters give one packed 32-bit integer for each frame.
*Alignment.* Exact items of a query and of a recording vote for offsets; the
offset with most votes is judged by the share of unequal bits in the overlap.

Search finds candidates by items over all recordings, for a stated query set.
Recordings of equal fingerprints are one class, and only the smallest id of each
class is searched, so copies are never paired: the result is the classes' members
and the matches between classes. An item held by very many classes is dealt into
salted parts, so it isn't gathered in one task, and none is dropped. A pair is
confirmed on whole fingerprints.

Recordings are 16-bit little-endian mono samples in a binary column. ``rendered``
makes such recordings of vectors, one note per component, for tables that hold
no media.

Defined cases: null samples, or fewer than one filter's width of frames, give an
empty fingerprint, which matches nothing; an odd last byte is left out; silence
has the fingerprint of equal energy; repeated rows are fingerprinted each;
null ids are never queries nor matches, and are members of no class; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import bounded_batches, by_hash, lookup, materialise, row_parts

RATE, WINDOW, HOP = 11_025, 2048, 512
LOW_HZ, HIGH_HZ, WIDTH = 60.0, 3500.0, 16
MAX_BIT_ERROR, MIN_OVERLAP, BLOCK = 0.2, 16, 256
SALTS = 16

# Kind of filter, first pitch class, pitch classes, frames, three cuts of the log ratio.
FILTERS = [
    (kind, low, size, width, (-0.25, 0.0, 0.25))
    for kind, low, size, width in [
        ("time", 0, 3, 8), ("time", 3, 3, 8), ("time", 6, 3, 8), ("time", 9, 3, 8), ("pitch", 0, 4, 8), ("pitch", 4, 4, 8), ("pitch", 8, 4, 8), ("pitch", 0, 12, 16),
        ("time", 0, 6, 16), ("time", 6, 6, 16), ("cross", 0, 6, 16), ("cross", 6, 6, 16), ("cross", 3, 6, 8), ("centre", 0, 4, 15), ("centre", 4, 4, 15), ("centre", 8, 4, 15),
    ]
]
GRAY = np.array([0, 1, 3, 2], np.uint32)


@lru_cache(1)
def _folding() -> np.ndarray:
    """Matrix from spectrum bins to pitch classes."""
    hz = np.arange(WINDOW // 2 + 1) * RATE / WINDOW
    out = np.zeros((len(hz), 12), np.float32)
    used = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    out[used, np.round(12 * np.log2(hz[used] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames (n, 12), each of unit length; blocks of frames bound the memory."""
    n = max(0, (len(samples) - WINDOW) // HOP + 1)
    shape = np.hanning(WINDOW).astype(np.float32)
    out = np.zeros((n, 12), np.float32)
    for at in range(0, n, BLOCK):
        m = min(BLOCK, n - at)
        frames = np.lib.stride_tricks.sliding_window_view(samples[at * HOP : (at + m - 1) * HOP + WINDOW], WINDOW)[::HOP]
        out[at : at + m] = (np.abs(np.fft.rfft(frames * shape, axis=1)) ** 2) @ _folding()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-6, out / np.maximum(length, 1e-6), 0).astype(np.float32)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each position at which every filter fits."""
    n = len(frames) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, low, size, width, cuts in FILTERS:
        high, mid, half = low + size, low + size // 2, width // 2
        if kind == "time":
            a, b = area(0, half, low, high), area(half, width, low, high)
        elif kind == "pitch":
            a, b = area(0, width, low, mid), area(0, width, mid, high)
        elif kind == "cross":
            a = area(0, half, low, mid) + area(half, width, mid, high)
            b = area(0, half, mid, high) + area(half, width, low, mid)
        else:
            third = width // 3
            a = area(third, 2 * third, low, high)
            b = (area(0, third, low, high) + area(2 * third, width, low, high)) / 2
        level = np.searchsorted(cuts, np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)))
        out = (out << np.uint32(2)) | GRAY[level]
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float] | None:
    """(offset of b in a, overlap, bit error) at the offset with most equal items; ties go to the least bit error."""
    order = np.argsort(b, kind="stable")
    own = b[order]
    lo, hi = np.searchsorted(own, a, "left"), np.searchsorted(own, a, "right")
    votes = np.zeros(len(a) + len(b), np.int64)
    for i in np.flatnonzero(hi > lo):
        np.add.at(votes, i - order[lo[i] : hi[i]] + len(b), 1)
    if not votes.any():
        return None
    best = None
    for place in np.flatnonzero(votes == votes.max()):
        offset = int(place) - len(b)
        i, j = max(offset, 0), max(-offset, 0)
        n = min(len(a) - i, len(b) - j)
        error = float(np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum() / (32 * n))
        if best is None or (error, offset) < (best[2], best[0]):
            best = (offset, n, error)
    return best


def _printed(it):
    for batch in it:
        prints = []
        for x in batch.column(1):
            raw = x.as_py() or b""
            prints.append(fingerprint(chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768)).view(np.int32))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prints, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "print"])


def fingerprints(media: DataFrame, id_col: str, samples_col: str) -> DataFrame:
    """(id, print array<int>) of each row."""
    bounded_batches(media.sparkSession)
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(samples_col).cast("binary").alias("samples"))
    return rows.mapInArrow(_printed, "id long, print array<int>")


def _aligned(it):
    names = ["query_id", "match_id", "offset", "overlap", "bit_error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    for batch in it:
        rows = []
        for q, m, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            found = align(b.values.to_numpy().view(np.uint32), a.values.to_numpy().view(np.uint32))
            if found and found[1] >= MIN_OVERLAP and found[2] <= MAX_BIT_ERROR:
                rows.append((q, m, *found))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def search(prints: DataFrame, every: int = 100) -> DataFrame:
    """Pairs (query_id, match_id, offset, overlap, bit_error): queries against all other recordings.

    Queries are the ids divisible by ``every``, or the rows whose column ``asks`` is true where there is one.
    """
    asks = lambda every: F.col("asks") if "asks" in prints.columns else F.col("id") % every == 0
    items = prints.filter("id is not null").select("id", *(c for c in prints.columns if c == "asks"), F.explode(F.array_distinct("print")).alias("item"))
    salted = items.withColumn("salt", by_hash("id", SALTS))
    asked = items.filter(asks(every)).select(F.col("id").alias("q"), "item", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = salted.join(asked, ["item", "salt"]).filter("q <> id").select("q", F.col("id").alias("m")).distinct()
    full = prints.filter("id is not null")
    both = lookup(pairs, "m", full.select(F.col("id").alias("m"), F.col("print").alias("pm")), by_hash("q"))
    both = lookup(both, "q", full.select(F.col("id").alias("q"), F.col("print").alias("pq")), by_hash("m", 64))
    return both.select("q", "m", "pq", "pm").mapInArrow(_aligned, "query_id long, match_id long, offset long, overlap long, bit_error double")


def _rendered(it):
    step = RATE // 16
    t = np.arange(step) / RATE
    for batch in it:
        out = []
        for v in batch.column(1):
            notes = np.array([x or 0.0 for x in (v.as_py() or [])])
            hz = 440 * 2 ** (np.round(np.clip(notes, -1, 1) * 36) / 12)
            out.append((np.sin(2 * np.pi * hz[:, None] * t) * 12_000).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "samples"])


def rendered(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, samples): a melody for each vector, a sixteenth of a second per component."""
    bounded_batches(vectors.sparkSession)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_rendered, "id long, samples binary")


def media_matches(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All matches of each query beside its recording's summary: id, n_items, n_matches, match_id, offset, overlap, bit_error.

    A recording with matches has one row for each, one without has one row. Rows
    of one id share the matches of that id.
    """
    prints = materialise(fingerprints(rendered(vectors, id_col, vec_col), "id", "samples"), "prints")
    found = materialise(search(prints).distinct().withColumnRenamed("query_id", "id"), "matches")
    counts = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    own = prints.select("id", F.size("print").cast("long").alias("n_items")).join(counts, "id", "left")
    own = own.select("id", "n_items", F.coalesce("n", F.lit(0)).alias("n_matches"))
    rows = own.filter("n_matches > 0").join(found, "id")
    return rows.unionByName(own.filter("n_matches = 0"), allowMissingColumns=True)


def class_matches(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100) -> DataFrame:
    """Members and matches of classes of equal fingerprints: kind, id, class_id, n_items, class_size, n_matches, match_class, offset, overlap, bit_error.

    A row of kind ``member`` for each recording: its class, named by the smallest
    id in it, the class's size, and how many other recordings match it, those of
    its own class included; null where no id of the class is divisible by
    ``every``, as such a class is no query. A row of kind ``match`` for each pair
    of a query class and another class. Recordings with null ids or empty
    fingerprints have no class; rows of one id and fingerprint are one recording.
    """
    rows = vectors.repartition(row_parts(vectors, 1000))  # few bytes a row, but much work
    prints = materialise(fingerprints(rendered(rows, id_col, vec_col), "id", "samples"), "prints")
    keyed = prints.withColumn("n_items", F.size("print").cast("long")).withColumn("digest", F.when((F.col("n_items") > 0) & F.col("id").isNotNull(), F.sha2(F.to_json("print"), 256)))
    own = keyed.filter("digest is not null").select("digest", "id", "print").dropDuplicates(["digest", "id"])
    by = by_hash("id", SALTS)
    some = own.groupBy("digest", by.alias("salt")).agg(F.min_by("print", "id").alias("print"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.max((F.col("id") % every == 0).cast("int")).alias("asks"))
    classes = some.groupBy("digest").agg(F.min_by("print", "least").alias("print"), F.min("least").alias("id"), F.sum("n").alias("class_size"), (F.max("asks") == 1).alias("asks"))
    classes = materialise(classes, "classes")
    found = materialise(search(classes.select("id", "print", "asks")).distinct(), "matches")
    sizes = classes.select(F.col("id").alias("match_id"), F.col("class_size").alias("size"))
    others = lookup(found.select("query_id", "match_id"), "match_id", sizes, by_hash("query_id")).groupBy(F.col("query_id").alias("id")).agg(F.sum("size").alias("others"))
    counts = classes.join(others, "id", "left").select("digest", F.col("id").alias("class_id"), "class_size", F.when(F.col("asks"), F.coalesce("others", F.lit(0)) + F.col("class_size") - 1).alias("n_matches"))
    members = lookup(keyed.filter("digest is not null").select("id", "n_items", "digest"), "digest", counts, by_hash("id")).drop("digest")
    members = members.unionByName(keyed.filter("digest is null").select("id", "n_items"), allowMissingColumns=True).withColumn("kind", F.lit("member"))
    matches = found.select(F.lit("match").alias("kind"), F.col("query_id").alias("class_id"), F.col("match_id").alias("match_class"), "offset", "overlap", "bit_error")
    every_row = members.unionByName(matches, allowMissingColumns=True)
    return every_row.select("kind", "id", "class_id", "n_items", "class_size", "n_matches", "match_class", "offset", "overlap", "bit_error")
