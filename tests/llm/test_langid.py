"""Language ID: gradients by finite differences, held-out accuracy, defined cases."""

import numpy as np

from topicloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(3, 4, rng).items()}
    x, y = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    mask = (np.arange(7)[:, None] < rng.integers(1, 8, 5)[None]).astype(float)
    _, grads = langid.loss_and_gradients(w, x, mask, y)
    for name in w:
        places = [np.unravel_index(i, w[name].shape) for i in rng.choice(w[name].size, 4)]
        if name[0] == "E":
            places = [(x[0, 0], i) for i in range(0, 12, 5)]
        for at in places:
            kept, losses = w[name][at], []
            for step in (1e-2, -1e-2):
                w[name][at] = kept + step
                losses.append(langid.loss_and_gradients(w, x, mask, y)[0])
            w[name][at] = kept
            assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97


def test_defined_cases(spark):
    model = langid.train([(b"aaaa bbb aaa", "x"), (b"zzzz yyy zzz", "y")], steps=40)
    rows = [(1, None, "x", ""), (2, "", "x", ""), (3, "12 34 !", "x", ""), (None, "aaa", None, ""), (5, "zz yy " * 5000, None, ""), (5, "zz yy " * 5000, None, "")]
    got = sorted(map(tuple, langid.predict(spark.createDataFrame(rows, SCHEMA), model).collect()), key=str)
    assert [r[2] for r in got] == ["und", "und", "und", "y", "y", "x"] and all(0 <= r[3] <= 1 for r in got)
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
