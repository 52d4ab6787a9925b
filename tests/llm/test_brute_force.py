"""Plain-loop versions of predictions and scores, and rows that must not be lost or merged."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from topicloom.llm import langid, minhash, quality
from topicloom.llm.shared import Words


def plain_prediction(model, text):
    """Language and score by loops over bytes, one position at a time."""
    data, w = text.encode(), model.weights
    hidden = w["Cf"].shape[0]
    total = np.zeros(len(model.langs))
    for at in range(0, len(data), langid.SEGMENT):
        # the last segment is filled up with zero bytes, which count for nothing but are read
        seg = data[at : at + langid.SEGMENT]
        padded = seg + bytes(langid.SEGMENT - len(seg))
        states = {}
        for d, order in (("f", range(len(padded))), ("b", range(len(padded) - 1, -1, -1))):
            h = np.zeros(hidden)
            for t in order:
                e = w[f"E{d}"][padded[t]].astype(float)
                gates = 1 / (1 + np.exp(-(e[: 2 * hidden] + h @ w[f"U{d}"])))
                z, r = gates[:hidden], gates[hidden:]
                h = h + z * (np.tanh(e[2 * hidden :] + (r * h) @ w[f"C{d}"]) - h)
                states[d, t] = h
        for t in range(len(seg)):
            logits = np.concatenate([states["f", t], states["b", t]]) @ w["V"] + w["b"]
            total += logits - math.log(sum(math.exp(x) for x in logits))
    scores = total / len(data) * min(len(data), langid.EVIDENCE)
    p = np.exp(scores - scores.max())
    return model.langs[int(p.argmax())], float((p / p.sum()).max())


def test_language_prediction_equals_plain_loops():
    model = langid.Model(["aa", "bb", "cc"], langid.new_weights(3, 6, np.random.default_rng(2)))
    rng = random.Random(1)
    texts = ["a", "é b", "ab " * 100, *("".join(rng.choice("abcdef é\n") for _ in range(rng.randrange(1, 300))) + "x" for _ in range(6))]
    langs, scores = langid._judge(model)(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        want = plain_prediction(model, text)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-4)


def test_quality_scores_equal_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    feats = quality.features(docs)
    model = quality.fit(feats, labels)
    got = {r.doc_id: r for r in feats.mapInArrow(quality._scored(model), "doc_id long, text_score double, meta_score double, score double, good boolean").collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    base = math.log(model.prior / (1 - model.prior))
    for r in docs.limit(40).collect():
        data = r.text.encode()
        words = data.split()
        counts = {}
        for word in words:
            bucket = int(Words([word]).hash[0] >> np.uint64(40)) % quality.BUCKETS
            counts[bucket] = counts.get(bucket, 0) + 1
        w = model.views[0].weights
        text = model.views[0].bias + sum(math.sqrt(n / len(words)) * w[b] for b, n in counts.items())
        other = sum(b < 128 and not chr(b).isalnum() for b in data)
        shape = [sum(65 <= b <= 90 for b in data) / len(data), sum(48 <= b <= 57 for b in data) / len(data), other / len(data), min(sum(map(len, words)) / len(words), 30) / 30, len(counts) / len(words), min(math.log1p(len(words)), 12) / 12]
        text = model.views[0].slope * (text + sum(x * y for x, y in zip(shape, w[quality.BUCKETS :], strict=True))) + model.views[0].shift
        at = quality.meta_features([(r.source, r.lang, len(r.text))]).at
        meta = model.views[1].slope * (model.views[1].bias + sum(model.views[1].weights[k] for k in at)) + model.views[1].shift
        both = base + model.weights[0] * (text - base) + model.weights[1] * (meta - base) + model.weights[2]
        assert got[r.doc_id].text_score == pytest.approx(sigmoid(text), abs=1e-5)
        assert got[r.doc_id].meta_score == pytest.approx(sigmoid(meta), abs=1e-5)
        assert got[r.doc_id].score == pytest.approx(sigmoid(both), abs=1e-5)


def test_quality_on_held_out_labels_beats_the_majority(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(docs, labels.filter("doc_id % 4 <> 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    assert (got.good == (got.quality == 1)).mean() > max(got.quality.mean(), 1 - got.quality.mean())


def words(start, n):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_null_and_repeated_ids_merge_nothing(spark):
    """Near copies of two unlike documents under one id, null or not, must not tie the two together."""
    a, b = words(0, 80), words(1000, 80)
    for same in (None, 3):
        rows = [(1, a), (7, b), (same, a + " end"), (same, b + " end")]
        got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(1, 1, True), (same, 1, False), *([(7, 7, True), (same, 7, False)] if same is None else [(7, 3, False), (same, 3, True)])], key=str)


def test_a_set_is_sent_once_a_block_pair(spark):
    """A document in buckets of many bands is in one cluster only."""
    rng = random.Random(3)
    rows = [(i, i % 7, rng.randrange(3), 1) for i in range(60)]
    members = spark.createDataFrame(rows, "id long, component long, cluster long, n int").withColumn("salt", minhash.by_hash("id", minhash.SALTS))
    dealt = minhash.cross_blocks(members, "cluster", "n").collect()
    sent = {}
    for r in dealt:
        sent.setdefault(r.id, []).append(r.side)
    majors = {i for i, s in sent.items() if s == [1]}
    assert all(sorted(s) in ([1], [0, 1]) for s in sent.values()) and majors
    # every pair of one cluster and different components meets on two sides of one block pair
    left = {(r.cluster, r.i, r.j, r.id) for r in dealt if r.side == 0}
    right = {(r.cluster, r.i, r.j, r.id) for r in dealt if r.side == 1}
    met = {frozenset((p[3], q[3])) for p in left for q in right if p[:3] == q[:3]}
    comp, clus = {r.id: r.component for r in dealt}, {r.id: r.cluster for r in dealt}
    assert all(frozenset((p, q)) in met for p in comp for q in comp if clus[p] == clus[q] and comp[p] != comp[q])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, component int"


@pytest.mark.parametrize("name", ["exact", "near", "substrings"])
def test_stages_with_empty_tables_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").count() == 0
    some = spark.createDataFrame([(1, words(0, 50), "en", "s", 1, 9, "d", 4), (2, words(500, 50), None, None, None, None, None, None)], SCHEMA)
    got = stage(spark, some, "").orderBy("doc_id").collect()
    assert [(r.doc_id, r.id, r.digest, r.component) for r in got] == [(1, 9, "d", 4), (2, None, None, None)]


def test_language_stage_keeps_lettered_documents_without_a_model(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, 1), (2, "12 34", None, None, 1), (3, None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]
