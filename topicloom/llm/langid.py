"""Language ID: a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one in each direction, read segments of ``SEGMENT``
bytes; every position gets a label distribution from both states. A document's
probabilities are the softmax of its positions' mean log-probabilities, over all
segments of its whole text, sharpened by ``EVIDENCE`` positions at most, so a
long text isn't made certain by its length alone.

Training is plain numpy: backpropagation through time with Adam, on
``PER_LANG`` documents of each language at most (a hashed sample) and
``PIECES`` segments of each. Only text and lang of labelled rows outside the
held-out fifth are read. The fitted weights are a few kilobytes, so they travel
with the task; prediction is a map over the rows.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
null ids count as held out; with no labelled rows every text is ``und``; repeated
rows are judged each; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.shared import bounded_batches

SEGMENT, HIDDEN, PER_LANG, PIECES = 64, 8, 300, 6
STEPS, BATCH, RATE, SEED = 500, 128, 0.02, 5
BLOCK, EVIDENCE = 4096, 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    langs: list[str]
    weights: dict[str, np.ndarray]  # per direction d: E{d} (bytes to gates), U{d} and C{d} (recurrent), and V, b (labels)


def new_weights(langs: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in "fb":
        w[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        w[f"U{d}"] = rng.normal(0, 0.3, (hidden, 2 * hidden))
        w[f"C{d}"] = rng.normal(0, 0.3, (hidden, hidden))
    w["V"], w["b"] = rng.normal(0, 0.3, (2 * hidden, langs)), np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in w.items()}


def run_layer(w: dict, d: str, x: np.ndarray, keep: bool = False):
    """States (T, N, H) of one direction for bytes x (T, N); with ``keep`` also what backpropagation needs."""
    E, U, C = w[f"E{d}"], w[f"U{d}"], w[f"C{d}"]
    n_steps, n = x.shape
    hidden = C.shape[0]
    states, h = np.empty((n_steps, n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    saved = [None] * n_steps
    for t in range(n_steps) if d == "f" else range(n_steps - 1, -1, -1):
        e = E[x[t]]
        gates = sigmoid(e[:, : 2 * hidden] + h @ U)
        z, r = gates[:, :hidden], gates[:, hidden:]
        c = np.tanh(e[:, 2 * hidden :] + (r * h) @ C)
        new = h + z * (c - h)
        if keep:
            saved[t] = (h, z, r, c)
        states[t] = h = new
    return (states, saved) if keep else states


def back_layer(w: dict, d: str, x: np.ndarray, saved: list, grad: np.ndarray, out: dict) -> None:
    """Backpropagation through time of one direction; ``grad`` is the loss's gradient of each state."""
    U, C = w[f"U{d}"], w[f"C{d}"]
    n_steps, n = x.shape
    hidden = C.shape[0]
    carry = np.zeros((n, hidden), np.float32)
    pre = np.empty((n_steps, n, 3 * hidden), np.float32)
    gU, gC = np.zeros_like(U), np.zeros_like(C)
    for t in range(n_steps - 1, -1, -1) if d == "f" else range(n_steps):
        h, z, r, c = saved[t]
        g = grad[t] + carry
        gc = g * z * (1 - c * c)
        grh = gc @ C.T
        gz, gr = g * (c - h) * z * (1 - z), grh * h * r * (1 - r)
        gates = np.concatenate([gz, gr], axis=1)
        carry = g * (1 - z) + grh * r + gates @ U.T
        gU += h.T @ gates
        gC += (r * h).T @ gc
        pre[t, :, : 2 * hidden], pre[t, :, 2 * hidden :] = gates, gc
    gE = np.zeros_like(w[f"E{d}"])
    np.add.at(gE, x.ravel(), pre.reshape(-1, 3 * hidden))
    out[f"E{d}"], out[f"U{d}"], out[f"C{d}"] = gE, gU, gC


def log_probs(w: dict, x: np.ndarray) -> np.ndarray:
    """Label log-probabilities of every position: (T, N, labels)."""
    logits = np.concatenate([run_layer(w, "f", x), run_layer(w, "b", x)], axis=2) @ w["V"] + w["b"]
    top = logits.max(axis=2, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=2, keepdims=True))


def loss_and_gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy of all positions, and its gradients."""
    (sf, kf), (sb, kb) = run_layer(w, "f", x, True), run_layer(w, "b", x, True)
    s = np.concatenate([sf, sb], axis=2)
    logits = s @ w["V"] + w["b"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    total = mask.sum()
    own = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0]
    loss = float(-(np.log(own + 1e-12) * mask).sum() / total)
    g = p.copy()
    g[:, np.arange(len(y)), y] -= 1
    g *= (mask / total)[..., None]
    out = {"V": np.tensordot(s, g, ([0, 1], [0, 1])), "b": g.sum(axis=(0, 1))}
    gs = (g @ w["V"].T).astype(np.float32)
    hidden = sf.shape[2]
    back_layer(w, "f", x, kf, gs[..., :hidden], out)
    back_layer(w, "b", x, kb, gs[..., hidden:], out)
    return loss, out


def segments(data: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (N, size) padded by zeros, their lengths, and the text each belongs to."""
    counts = np.array([-(-len(t) // size) for t in data], np.int64)
    x = np.frombuffer(b"".join(t.ljust(int(c) * size, b"\0") for t, c in zip(data, counts, strict=True)), np.uint8).reshape(-1, size)
    of = np.repeat(np.arange(len(data)), counts)
    lengths = np.full(len(x), size)
    ends = np.cumsum(counts)[counts > 0] - 1
    lengths[ends] = [len(t) - (len(t) - 1) // size * size for t in data if t]
    return x, lengths, of


def train(pieces: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Model:
    langs = sorted({lang for _, lang in pieces})
    pieces = [p for p in pieces if p[0]]
    if not pieces:
        return Model([], {})
    rng = np.random.default_rng(seed)
    w = new_weights(len(langs), hidden, rng)
    x, lengths, of = segments([t for t, _ in pieces])
    y = np.array([langs.index(lang) for _, lang in pieces])[of]
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    by_lang = [k for k in by_lang if len(k)]
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(k, -(-BATCH // len(by_lang))) for k in by_lang])
        mask = (np.arange(SEGMENT)[:, None] < lengths[pick][None]).astype(np.float32)
        _, grads = loss_and_gradients(w, x[pick].T, mask, y[pick])
        scale = min(1.0, 1.0 / (1e-9 + float(sum((g * g).sum() for g in grads.values())) ** 0.5))
        rate = RATE * (1 - step / (steps + 1))
        for k, g in grads.items():
            g = g * scale
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, w)


def training_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> list[tuple[bytes, str]]:
    """A hashed sample of about ``per_lang`` labelled documents of each language, and of each some places of its whole text."""
    usable = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") <= per_lang
    share |= F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1_000_000)) * F.col("n") < per_lang * 1_000_000
    place = lambda i: F.pmod(F.xxhash64("id", i), F.greatest(F.length("text") - SEGMENT, F.lit(1))).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), F.lit(PIECES)), lambda i: F.substring(F.col("text"), place(i), F.lit(SEGMENT)))
    rows = usable.join(F.broadcast(sizes), "lang").filter(share).select("id", "lang", cut.alias("cut")).collect()
    rows.sort(key=lambda r: (r.id, r.lang, r.cut))
    return [(piece.encode()[:SEGMENT], r.lang) for r in rows for piece in r.cut]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _judge(model: Model):
    def pooled(texts: list[bytes]) -> np.ndarray:
        x, lengths, of = segments(texts)
        sums = np.zeros((len(texts), len(model.langs)))
        for at in range(0, len(x), BLOCK):
            part = slice(at, at + BLOCK)
            mask = (np.arange(SEGMENT)[:, None] < lengths[part][None]).astype(np.float32)
            own = np.einsum("tnk,tn->nk", log_probs(model.weights, np.ascontiguousarray(x[part].T)), mask)
            np.add.at(sums, of[part], own)
        sizes = np.array([len(t) for t in texts], float)[:, None]
        scores = sums / np.maximum(sizes, 1) * np.minimum(sizes, EVIDENCE)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = pooled([texts[k].encode() for k in known])
            for k, best, top in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                lang[k], score[k] = model.langs[best], float(top)
        return lang, score

    return judge


def _predicted(model: Model):
    judge = _judge(model)

    def batches(it):
        for batch in it:
            lang, score = judge(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return batches


def _known(model: Model, least: float):
    """The rows whose language is known. Columns: text, then those of the table."""
    judge = _judge(model)

    def batches(it):
        for batch in it:
            if not model.langs:
                ok = [bool(t and _LETTER.search(t)) for t in batch.column(0).to_pylist()]
            else:
                ok = [lang != UNKNOWN and score >= least for lang, score in zip(*judge(batch.column(0).to_pylist()), strict=True)]
            yield batch.select(list(range(1, batch.num_columns))).filter(pa.array(ok, pa.bool_()))

    return batches


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(training_pieces(docs)))


def keep_known(docs: DataFrame, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose language is known; a score under ``least`` counts as unknown. Each row is judged by itself, whatever its id.

    Where no model could be learned, the rows whose text has a letter.
    """
    bounded_batches(docs.sparkSession)
    model = train(training_pieces(docs, id_col, text_col))
    return docs.select(F.col(text_col).alias("_text"), "*").mapInArrow(_known(model, least), docs.schema)
