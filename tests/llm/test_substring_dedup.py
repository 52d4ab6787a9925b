import hashlib
import random

from topicloom.llm import substring_dedup as sd


def brute(rows, window):
    """(n_words, n_removed, kept) of each (id, text), None ids last."""
    key = lambda d: sd.LAST if d is None else d
    words = [(key(d), (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("xyzuvw") for _ in range(rng.choice([3, 19, 20, 21, 60, 200]))) for _ in range(40)]
    texts = [None, "", " \t\n", "one", "na " * 19, "na " * 20, "na " * 21, "na " * 500]
    for _ in range(120):
        kind = rng.random()
        a, b = rng.choice(base).split(" "), rng.choice(base).split(" ")
        if kind < 0.3:
            texts.append("  ".join(a))
        elif kind < 0.7:
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            texts.append(" ".join(a[:i]) + "\n" + "\t".join(b[j:]) + " new" + str(rng.random()))
        else:
            texts.append(rng.choice(base))
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, kept_text string, hash int").repartition(5)
    got = {r.doc_id: r for r in sd.substring_dedup(docs, with_text=True).collect()}
    for (i, t), want in zip(rows, brute(rows, sd.WINDOW), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == want, i
        assert hashlib.sha256(b" ".join(got[i].kept_text.encode().split())).hexdigest() == want[2]
        if not want[1]:
            assert got[i].kept_text == (t or "")


def test_null_ids_empty_table_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (5, long), (5, long), (9, long + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in sd.substring_dedup(docs).collect()), key=str)
    assert got == [(5, 0), (5, 0), (9, 40), (None, 40)]
    assert sd.substring_dedup(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    index = sd.FingerprintIndex(spark, buckets=3)
    for k in range(5):
        index.append(spark.createDataFrame([([10 * k, 10 * k + 1, 0],)], "prints array<long>"))
        assert len(index.runs) <= index.fanout + 0
    assert [r.print for r in index.repeated().collect()] == [0]
    index.drop()


def passages(rng, n):
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 25, 60]))) for _ in range(12)]
    return [" ".join(rng.choices(base, k=rng.choice([1, 1, 2, 3])) + [f"own{rng.random()}"] * rng.randrange(2)) for _ in range(n)]


def by_id(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_batches_of_a_kept_index_equal_one_call_over_all(spark, tmp_path):
    rng = random.Random(7)
    rows = list(enumerate([None, "", *passages(rng, 90)]))
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    folder, got = f"file://{tmp_path}/index", []
    for a, b in ((0, 30), (30, 55), (55, 55), (55, 92)):
        index = sd.FingerprintIndex(spark, folder, buckets=3)  # opened anew for each batch
        got += by_id(sd.dedup_batch(index, frame(rows[a:b])))
        assert len(index.runs) <= index.fanout
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows, sd.WINDOW), strict=True)), key=str)
    assert sorted(got, key=str) == want == by_id(sd.substring_dedup(frame(rows)))
    assert any(w[2] for w in want if w[0] >= 55)
    # what is indexed comes first, whatever the ids; a failed batch is not indexed
    index = sd.FingerprintIndex(spark, folder)
    index.add(frame([(1000, rows[5][1])]).selectExpr("doc_id doc", "text || ' lost lost' text"))
    fresh = " ".join(f"fresh{k}" for k in range(30))
    index = sd.FingerprintIndex(spark, folder)
    late = by_id(sd.dedup_batch(index, frame([(-5, fresh), (3, fresh + " x"), (None, rows[60][1]), (-9, "short text")])))
    removed = {r[0]: r[2] for r in late}
    assert removed[-5] == 0 and removed[3] == 30 and removed[-9] == 0
    assert removed[None] == (len(rows[60][1].split()) if len(rows[60][1].split()) >= sd.WINDOW else 0)
    index.drop()


def test_a_repeated_id_does_not_pass_a_copy_on_to_its_other_text(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(5, a), (7, a), (7, b), (8, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in sd.substring_dedup(docs).collect()) == [(5, 0), (7, 0), (7, 30), (8, 30)]


def test_equal_hashes_of_other_words_remove_nothing():
    import numpy as np
    import pyarrow as pa

    text = "  ".join(f"w{k}" for k in range(20))
    words = sd.Words([text.encode()])
    own, key = sd.signed(sd.Windows(words, 20).hash).tolist(), b"k" * 16
    right = int.from_bytes(sd._check(b" ".join(text.encode().split()), key), "little", signed=True)

    def removed(check):
        lists = pa.list_(pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([None], pa.list_(pa.binary())), pa.array([own], lists), pa.array([[check]], lists)], ["doc", "text", "copies", "hash", "check"])
        return next(sd._kept_rows(20, False, key)([batch])).column(2).to_pylist()

    assert removed(right) == [20] and removed(right ^ 1) == [0]
    windows = [b"x", b"y", b"x", b"y", b"z"]  # one hash for all: only equal words are repeats
    assert sd._repeats(np.zeros(5, np.int64), windows.__getitem__).tolist() == [False, False, True, True, False]
