"""Co-training: held-out accuracy on two redundant views, and defined cases."""

import numpy as np

from topicloom.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, score int"


def test_few_labels_and_a_pool():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    xs = [(rng.normal(0, 1, (1200, 10)) + (2 * y[:, None] - 1) * 0.8).astype(np.float32) for _ in range(2)]
    model = quality.co_train([x[:40] for x in xs], y[:40], [x[40:800] for x in xs])
    assert min(model.taught) > 100
    score = model.score([x[800:] for x in xs])
    assert ((score[:, 2] >= 0.5) == y[800:]).mean() > 0.95


def test_documents_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(docs, labels.filter("doc_id % 4 <> 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    share = max(got.quality.mean(), 1 - got.quality.mean())
    assert (got.good == (got.quality == 1)).mean() >= share - 0.05


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1), (None, "a b", "x", "s", 1), (2, "", "x", "s", 1), (2, "w " * 50000, "x", "s", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 for r in got)
    assert quality.score_quality(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, labels).collect())
