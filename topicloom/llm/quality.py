"""Quality classifier by co-training of a text view and a metadata view.

Two logistic models see different columns of a document: the *text* view hashed
words and shape of the text, the *metadata* view source, lang and length. In
each round each model scores every unlabelled document and labels those it is
surest of, and the other model learns from them:

1. *features* of both views are written once, as sparse rows;
2. *scores* of a round are found in the executors, for all unlabelled documents;
3. *choice*: counts by score bin give, for each class, the score beyond which
   lie the surest documents: the round's share of the corpus (``SHARE``, more each
   round) times the share of the class among the labels, and none that the
   calibrated model gives less than ``SURE``. All beyond it are pseudo-labelled;
   earlier pseudo-labels are not kept, so a wrong one can be put right;
4. *learning*: the other model is fitted again, from its last weights, on the
   labelled rows and a hashed sample of about ``TAUGHT`` of those just chosen.

Each view is calibrated on labelled rows it was not fitted on (Platt), and the
calibrated log-odds are combined by weights fitted on the same rows.

Bounds: fitting reads about ``LABELLED`` labelled rows, by a hash of the id. The
driver holds these and ``TAUGHT`` sparse rows a view, never texts, and counts of
at most 2 * ``BINS`` bins. Scoring reads all documents and whole texts.

Defined cases: a null text is empty, null metadata is a value of its own;
documents without an id are never labelled but are scored; an id labelled twice
counts with its smaller quality; rows of one id are chosen together; with no
labels, or labels of one class, every score is the prior; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import Words, bounded_batches, delete, materialise, work_path

LABELLED, TAUGHT = 4000, 4000
BUCKETS, META, SHAPE = 4096, 256, 6
SHARE, SURE, BINS, BIN = (0.1, 0.2, 0.3, 0.4), 0.8, 512, 0.0625
STEPS, RATE, RIDGE, SEED = 200, 0.5, 1e-3, 3
AGAIN = 60  # steps from the last weights
CALIBRATION = 5  # every so many labelled rows are kept for calibration


class Sparse:
    """Rows of (index, value) pairs: row k has those from ``start[k]`` to ``start[k + 1]``."""

    def __init__(self, start: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.start, self.at, self.value, self.width = start, at, value, width
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], len(self))

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * e[self.row], self.width)

    def take(self, rows: np.ndarray) -> Sparse:
        """The rows of a mask or a list of places."""
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        pick = np.repeat(self.start[:-1][rows] - start[:-1], size) + np.arange(start[-1])
        return Sparse(start, self.at[pick], self.value[pick], self.width)

    @staticmethod
    def of(x: np.ndarray | Sparse) -> Sparse:
        if isinstance(x, Sparse):
            return x
        row, at = np.nonzero(x)
        return Sparse(np.searchsorted(row, np.arange(len(x) + 1)), at, x[row, at].astype(float), x.shape[1])

    @staticmethod
    def packed(at: list[bytes], value: list[bytes] | None, width: int) -> Sparse:
        """From rows of 16-bit indices and 32-bit values, which are 1 where they are left out."""
        start = np.concatenate([[0], np.cumsum([len(a) // 2 for a in at], dtype=np.int64)])
        places = np.frombuffer(b"".join(at), np.uint16).astype(np.int64)
        values = np.ones(len(places)) if value is None else np.frombuffer(b"".join(value), np.float32).astype(float)
        return Sparse(start, places, values, width)

    @staticmethod
    def stack(parts: list[Sparse]) -> Sparse:
        ends = np.cumsum([0] + [p.start[-1] for p in parts])
        start = np.concatenate([[0]] + [p.start[1:] + e for p, e in zip(parts, ends, strict=False)])
        return Sparse(start, np.concatenate([p.at for p in parts]), np.concatenate([p.value for p in parts]), parts[0].width)


def text_features(texts: list[str]) -> Sparse:
    """Root counts of hashed words as rows of unit length, then the text's shape; a text without words has none."""
    words = Words([t.encode() for t in texts])
    n = np.diff(words.first)
    of = np.repeat(np.arange(len(texts)), n)
    bucket = (words.hash >> np.uint64(40)).astype(np.int64) % BUCKETS
    cell, count = np.unique(of * BUCKETS + bucket, return_counts=True)
    doc, value = cell // BUCKETS, np.sqrt(count / n[cell // BUCKETS])  # squares add up to 1
    raw = np.frombuffer(words.data, np.uint8)
    begin = words.begin
    span = np.maximum(np.diff(begin) - 1, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[begin[1:] - 1] - total[begin[:-1]]) / span

    upper, digit = share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57))
    other = share((raw < 48) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 128)))
    some = np.maximum(n, 1)
    length = np.bincount(of, words.end - words.start, len(texts)) / some
    shape = np.stack([upper, digit, other, np.minimum(length, 30) / 30, np.bincount(doc, minlength=len(texts)) / some, np.minimum(np.log1p(n), 12) / 12], axis=1)
    full = np.flatnonzero(n)
    rows = np.concatenate([doc, np.repeat(full, SHAPE)])
    order = np.argsort(rows, kind="stable")
    at = np.concatenate([cell % BUCKETS, np.tile(BUCKETS + np.arange(SHAPE), len(full))])[order]
    return Sparse(np.searchsorted(rows[order], np.arange(len(texts) + 1)), at, np.concatenate([value, shape[full].ravel()])[order], BUCKETS + SHAPE)


def meta_features(rows: list[tuple]) -> Sparse:
    """One-hot of hashed source and lang and of the length's magnitude. Rows: source, lang, characters."""
    at = []
    for source, lang, chars in rows:
        size = "none" if chars is None else str(int(np.log2(max(chars, 1)) * 2))
        at += [zlib.crc32(f"{name}={value}".encode()) % META for name, value in (("source", source), ("lang", lang), ("size", size))]
    return Sparse(np.arange(len(rows) + 1) * 3, np.array(at, np.int64), np.ones(len(at)), META)


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: Sparse) -> np.ndarray:
        return x.dot(self.weights) + self.bias

    def odds(self, x: Sparse) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _p(odds: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * odds))


def fit_logistic(x: Sparse, y: np.ndarray, start: Logistic | None = None) -> Logistic:
    """Ridge logistic regression by Adam on all rows."""
    w = np.zeros(x.width + 1) if start is None else np.append(start.weights, start.bias)
    steps, rate = (STEPS, RATE) if start is None else (AGAIN, RATE / 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        err = _p(x.dot(w[:-1]) + w[-1]) - y
        g = np.append(x.back(err) / len(y) + RIDGE * w[:-1], err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Logistic(w[:-1], float(w[-1]))


def _platt(s: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``s``, by Newton's method on softened targets, drawn towards ``start``."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = start.copy()
    for _ in range(30):
        p = _p(s @ ab)
        hess = (s * (p * (1 - p))[:, None]).T @ s + 1e-2 * np.eye(len(ab))
        ab = ab - np.clip(np.linalg.solve(hess, s.T @ (p - target) + 1e-2 * (ab - start)), -2, 2)
    return ab


def calibrate(model: Logistic, x: Sparse, y: np.ndarray) -> None:
    slope, shift = _platt(np.stack([model.raw(x), np.ones(len(y))], axis=1), y, np.array([1.0, 0.0]))
    model.slope, model.shift = max(float(slope), 0.0), float(shift)


@dataclass
class CoTrained:
    prior: float
    views: list[Logistic] = field(default_factory=list)
    taught: list[int] = field(default_factory=list)  # documents with a pseudo-label for each view, in the last round
    weights: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))

    def score(self, xs: list) -> np.ndarray:
        """One row per document: text, metadata, both."""
        xs = [Sparse.of(x) for x in xs]
        base = np.log(self.prior / (1 - self.prior))
        if not self.views:
            return np.full((len(xs[0]), 3), self.prior)
        odds = [m.odds(x) for m, x in zip(self.views, xs, strict=True)]
        return _p(np.stack([*odds, base + np.stack([odds[0] - base, odds[1] - base, np.ones(len(xs[0]))], axis=1) @ self.weights], axis=1))


class Learner:
    """Both views' models and the labelled rows they start from."""

    def __init__(self, xs: list, y: np.ndarray):
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        held = np.arange(len(y)) % CALIBRATION == 0
        self.ready = len(set(y[~held].tolist())) == 2
        self.own = [Sparse.of(x).take(~held) for x in xs]
        self.held = [Sparse.of(x).take(held) for x in xs]
        self.y, self.y_held = y[~held].astype(float), y[held].astype(float)
        self.taught = [0, 0]
        self.models: list[Logistic] = []
        if self.ready:
            self.models = [fit_logistic(x, self.y) for x in self.own]
            self._calibrate()

    def _calibrate(self) -> None:
        for m, x in zip(self.models, self.held, strict=True):
            calibrate(m, x, self.y_held)

    def cuts(self, counts: np.ndarray, share: float) -> tuple[int, int, int]:
        """Of score bins with ``counts`` documents: the least bin of class 1, the greatest of class 0, and how many are in both."""
        total, sure = counts.sum(), int(np.ceil(np.log(SURE / (1 - SURE)) / BIN))
        up = np.cumsum(counts[::-1])[::-1]  # documents from this bin on
        down = np.cumsum(counts)
        hi = max(int((up > share * self.prior * total).sum()), BINS // 2 + sure)
        lo = min(BINS - 1 - int((down > share * (1 - self.prior) * total).sum()), BINS // 2 - sure)
        return hi, lo, int(counts[hi:].sum() + counts[: lo + 1].sum())

    def learn(self, pseudo: list[tuple[Sparse, np.ndarray] | None]) -> None:
        for k, more in enumerate(pseudo):
            if more is not None and len(more[1]):
                self.models[k] = fit_logistic(Sparse.stack([self.own[k], more[0]]), np.concatenate([self.y, more[1]]), self.models[k])
        self._calibrate()

    def result(self) -> CoTrained:
        if not self.ready:
            return CoTrained(self.prior)
        base = np.log(self.prior / (1 - self.prior))
        s = np.stack([*(m.odds(x) - base for m, x in zip(self.models, self.held, strict=True)), np.ones(len(self.y_held))], axis=1)
        p = np.array([1.0, 1.0, 0.0])
        # the prior's log-odds are a constant column of weight 1: fit around it
        fitted = _platt(np.column_stack([s, np.full(len(s), base)]), self.y_held, np.append(p, 1.0))
        weights = np.maximum(fitted[:3], [0.0, 0.0, -np.inf])
        weights[2] += (fitted[3] - 1) * base
        return CoTrained(self.prior, self.models, self.taught, weights)


def bins(odds: np.ndarray) -> np.ndarray:
    """Score bin of each log-odds."""
    return np.clip(np.floor(odds / BIN) + BINS // 2, 0, BINS - 1).astype(np.int32)


def co_train(xs: list, y: np.ndarray, pool: list) -> CoTrained:
    """Co-training on rows in memory: labelled ``xs`` with ``y``, unlabelled ``pool``, each a list of the two views."""
    learner, pool = Learner(xs, y), [Sparse.of(p) for p in pool]
    for share in SHARE if learner.ready else ():
        pseudo: list = [None, None]
        for teacher, k in ((0, 1), (1, 0)):
            at = bins(learner.models[teacher].odds(pool[teacher]))
            hi, lo, learner.taught[k] = learner.cuts(np.bincount(at, minlength=BINS), share)
            chosen = np.flatnonzero((at >= hi) | (at <= lo))
            pseudo[k] = (pool[k].take(chosen), (at[chosen] >= hi).astype(float))
        learner.learn(pseudo)
    return learner.result()


# ---- over tables -------------------------------------------------------------

FEATURES = "id long, text_at binary, text_value binary, meta_at binary"


def _rows(x: Sparse, values: bool = True) -> list[list[bytes]]:
    at, value = x.at.astype(np.uint16), x.value.astype(np.float32)
    ends = list(zip(x.start, x.start[1:], strict=False))
    return [[at[a:b].tobytes() for a, b in ends], *([[value[a:b].tobytes() for a, b in ends]] if values else [])]


def _feature_rows(it):
    """Columns: id, text, source, lang, chars."""
    for batch in it:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            texts = [t or "" for t in part.column(1).to_pylist()]
            meta = list(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True))
            columns = [*_rows(text_features(texts)), *_rows(meta_features(meta), False)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.binary()) for c in columns)], ["id", "text_at", "text_value", "meta_at"])


def _views(batch) -> list[Sparse]:
    """Columns: text_at, text_value, meta_at."""
    at, value, meta = (batch.column(c).to_pylist() for c in ("text_at", "text_value", "meta_at"))
    return [Sparse.packed(at, value, BUCKETS + SHAPE), Sparse.packed(meta, None, META)]


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Both views' features of every row, written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.length("text").cast("long").alias("chars"))
    return materialise(rows.mapInArrow(_feature_rows, FEATURES), "quality-features")


def _binned(models: list[Logistic]):
    def batches(it):
        for batch in it:
            at = [pa.array(bins(m.odds(x))) for m, x in zip(models, _views(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *at], ["id", "bin0", "bin1"])

    return batches


def _sampled(rows: int, of: int):
    """A condition that about ``rows`` of ``of`` ids fulfil, always the same ones."""
    share = min(1.0, rows / max(of, 1))
    return F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(2**40)) < F.lit(int(share * 2**40))


def _collect(feats: DataFrame, ids: DataFrame, most: int) -> list:
    """Features of a few ids with their column ``y``: about ``most`` rows, and twice that at most."""
    return feats.join(F.broadcast(ids.limit(2 * most)), "id").limit(2 * most).select("text_at", "text_value", "meta_at", "y").collect()


def _matrix(rows: list, view: int) -> Sparse:
    if view:
        return Sparse.packed([r.meta_at for r in rows], None, META)
    return Sparse.packed([r.text_at for r in rows], [r.text_value for r in rows], BUCKETS + SHAPE)


def fit(feats: DataFrame, labels: DataFrame, labelled: int = LABELLED, taught: int = TAUGHT, id_col: str = "doc_id") -> CoTrained:
    """Co-training over the table of :func:`features`."""
    spark = feats.sparkSession
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y")).filter("id is not null")
    known = materialise(known, "quality-labels")
    found = feats.select("id").join(known, "id", "left_semi").count()
    rows = sorted(_collect(feats, known.filter(_sampled(labelled, found)), labelled), key=lambda r: (zlib.crc32(r.text_at), r.meta_at, r.y))
    if not rows:
        return CoTrained(0.5)
    learner = Learner([_matrix(rows, 0), _matrix(rows, 1)], np.array([r.y for r in rows]))
    for share in SHARE if learner.ready else ():
        scored = feats.filter("id is not null").mapInArrow(_binned(learner.models), "id long, bin0 int, bin1 int")
        bins_at = work_path(spark, "quality-bins")
        scored.join(known, "id", "left_anti").write.parquet(bins_at)
        scored = spark.read.schema(scored.schema).parquet(bins_at)
        hist = scored.select(F.explode(F.array(*(F.struct(F.lit(k).alias("view"), F.col(f"bin{k}").alias("bin")) for k in (0, 1)))).alias("x")).groupBy("x.view", "x.bin").count().collect()
        pseudo: list = [None, None]
        for teacher, k in ((0, 1), (1, 0)):
            counts = np.zeros(BINS, np.int64)
            for r in hist:
                if r["view"] == teacher:
                    counts[r["bin"]] = r["count"]
            hi, lo, learner.taught[k] = learner.cuts(counts, share)
            own = F.col(f"bin{teacher}")
            chosen = scored.filter((own >= hi) | (own <= lo)).filter(_sampled(taught, learner.taught[k]))
            some = _collect(feats, chosen.select("id", (own >= hi).cast("int").alias("y")).dropDuplicates(["id"]), taught) if learner.taught[k] else []
            pseudo[k] = (_matrix(some, k), np.array([float(r.y) for r in some])) if some else None
        learner.learn(pseudo)
        delete(spark, bins_at)
    return learner.result()


def _scored(model: CoTrained):
    def batches(it):
        for batch in it:
            p = model.score(_views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= 0.5)], ["doc_id", "text_score", "meta_score", "score", "good"])

    return batches


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, text_score, meta_score, score, good (probabilities of quality 1)."""
    bounded_batches(docs.sparkSession)
    feats = features(docs, id_col)
    model = fit(feats, labels, id_col=id_col)
    return feats.mapInArrow(_scored(model), "doc_id long, text_score double, meta_score double, score double, good boolean")
