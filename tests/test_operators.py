"""Clusters, embeddings, descriptions, sources and streams on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.functions.tokens import EncoderTokens, SpaceTokens
from topicloom.operators import cluster, topics, words
from topicloom.operators.describe import Enhancer, sample_first, sample_poisson, sample_uniform
from topicloom.sources import embedding, tables
from topicloom.streaming.topics import placed_stream, windowed_counts


def blobs(seed=0, each=60, noise=15):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    return np.concatenate([*(c + rng.normal(0, 0.5, (each, 2)) for c in centres), rng.uniform(-30, 40, (noise, 2))])


def test_density_clusters_find_blobs_and_outliers():
    labels = cluster.density_labels(blobs(), 20)
    assert set(labels) == {-1, 0, 1, 2}
    for k in range(3):
        part = labels[60 * k : 60 * (k + 1)]
        assert len(set(part[part >= 0])) == 1 and (part >= 0).mean() > 0.9
    assert (labels[180:] == -1).mean() > 0.6
    assert set(cluster.density_labels(blobs()[:5], 20)) == {-1}


def test_weights_stand_for_repeated_points():
    x = blobs(noise=0)
    twice = cluster.density_labels(np.repeat(x, 2, axis=0), 20)[::2]
    assert (cluster.density_labels(x, 20, np.full(len(x), 2)) >= 0).mean() > 0.9
    assert len(set(twice[twice >= 0])) == 3


def test_ward_equals_brute_force():
    x = np.random.default_rng(1).normal(size=(30, 3))
    groups = [[i] for i in range(30)]
    while len(groups) > 4:
        cost = {(i, j): len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j}
        i, j = min(cost, key=cost.get)
        groups[i] += groups.pop(j)
    got = cluster.ward_labels(x, 4)
    assert sorted(sorted(np.flatnonzero(got == k).tolist()) for k in range(4)) == sorted(sorted(g) for g in groups)


def test_large_tables_are_clustered_by_groups(spark):
    x = blobs(each=100, noise=0)
    docs = spark.createDataFrame([(k, [float(v) for v in p]) for k, p in enumerate(x)], "doc_id long, emb_ld array<double>")
    got = {r.doc_id: r.topic_idx for r in cluster.density_clusters(docs, min_size=20, most=60).collect()}
    assert len(got) == 300 and len({v for v in got.values() if v >= 0}) == 3
    three = {r.doc_id: r.topic_idx for r in cluster.density_clusters(docs, k=3, min_size=20).collect()}
    assert len({v for v in three.values() if v >= 0}) == 3


def test_treebank_tokens(spark):
    df = spark.createDataFrame([("I don't know. The U.S. team's well-known (old) goal, 3.5% \"so\" they'll cannot end.",)], "text string")
    assert df.select(T.tokens(F.col("text"))).first()[0] == (
        "I do n't know . The U.S. team 's well-known ( old ) goal , 3.5 % `` so '' they 'll can not end .".split()
    )


def reverse_encoder():
    class Reverse:
        def encode(self, t):
            return [ord(c) for c in t]

        def decode(self, ids):
            return "".join(map(chr, ids))

    return Reverse


def test_token_counters(spark):
    df = spark.createDataFrame([("a b c",), ("",), (None,)], "text string")
    assert [tuple(r) for r in df.select(SpaceTokens().count(F.col("text")), SpaceTokens().cut(F.col("text"), 2)).collect()][:2] == [(3, "a b"), (0, "")]
    own = EncoderTokens(reverse_encoder())
    assert [tuple(r) for r in df.select(own.count(F.col("text")), own.cut(F.col("text"), 3)).collect()][:2] == [(5, "a b"), (0, "")]


def failing_embedder():
    def embed(texts):
        """Fails on batches, and always on texts with an x."""
        if len(texts) > 1 or "x" in texts[0]:
            raise OSError
        return [[float(len(texts[0])), 1.0]]

    return lambda: embed


def test_embeddings_by_chunks_with_retries(spark):
    docs = spark.createDataFrame([(1, "aa aa"), (2, "b" * 3 + " " + "c c c"), (3, "x"), (4, "x" * 4 + " c c c c")], "doc_id long, text string")
    got = {r.doc_id: r.emb_hd for r in embedding.document_embeddings(docs, failing_embedder(), most=3).collect()}
    assert got[1] == [5.0, 1.0] and got[3] is None
    assert got[2] == pytest.approx([3.0, 1.0])  # chunks of 3, 3 and 3 characters
    assert got[4] == pytest.approx([3.0, 1.0])  # "xxx" fails and so does "x c": only " c" and what follows count


def test_remote_paths_depend_on_deployment():
    assert embedding.RemoteClient("http://h/v1", "k", "m").url("embeddings") == "http://h/v1/embeddings"
    assert embedding.RemoteClient("http://h", "k", "m", "d", "1").url("chat/completions") == "http://h/deployments/d/chat/completions?api-version=1"


def test_requests_keep_to_the_budget():
    e = Enhancer(context=60)
    many = [f"w{k}" for k in range(500)]
    assert e.message_tokens(e.topword_request(many)) <= 60 and "w0" in e.topword_request(many)[1]["content"]
    request = e.document_request(["a " * 500, "b"], truncate=10)
    assert request[1]["content"].count("a") == 10
    assert e.document_request(["a " * 500], truncate=None)[1]["content"] == "Documents:\n"
    assert Enhancer().topic_name(["one", "two", "three", "four"]) == "one two three"


def test_sampling():
    assert sample_first(4).tolist() == [0, 1, 2, 3] and sorted(sample_uniform(1)(5)) == [0, 1, 2, 3, 4]
    drawn = sample_poisson(1)(50)
    assert len(drawn) == 50 and drawn.max() < 50 and (drawn <= 2).mean() > 0.7
    assert "second" in Enhancer().describe_documents(["first", "second"], sampling=lambda n: [1])


def test_cosine_topwords_keep_both_orders(spark):
    counts = spark.createDataFrame([(0, "near", 1), (0, "often", 9), (0, "none", 5)], "topic_idx int, word string, n long")
    vectors = spark.createDataFrame([("near", [1.0, 0.0]), ("often", [0.6, 0.8])], "word string, emb_hd array<double>")
    centre = spark.createDataFrame([(0, [1.0, 0.0])], "topic_idx int, centroid_hd array<double>")
    rows = words.topwords_cosine(counts, vectors, centre).orderBy("rank").collect()
    assert [(r.word, r.cosine, r.top_cosine) for r in rows] == [("often", 0.6, 1.0), ("near", 1.0, 0.6)]
    with pytest.raises(KeyError):
        words.topwords_cosine(counts, vectors, centre, strict=True)


def test_nearest_by_join_equals_nearest_by_array(spark, monkeypatch):
    docs = spark.createDataFrame([(k, [float(k % 5), float(k % 3), 1.0]) for k in range(20)], "doc_id long, v array<double>")
    points = spark.createDataFrame([(k, [float(k), 1.0, 1.0]) for k in range(4)], "i int, p array<double>")
    got = sorted(map(tuple, topics.nearest(docs, points, "v", "p", "i").collect()))
    monkeypatch.setattr(topics, "MOST_POINTS", 2)
    assert got == sorted(map(tuple, topics.nearest(docs, points, "v", "p", "i").collect()))


def test_csv_corpus_and_saved_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,x,"first\nline"\n2,y,\n3,z,third\n4,z,fourth\n')
    rows = tables.csv_corpus(spark, f"file://{tmp_path}/a.csv", 2, rows=3)
    assert [r.text for r in rows.orderBy("doc_id").collect()] == ["first\nline", "third"]
    assert tables.load_embeddings(spark, f"file://{tmp_path}/none") is None
    spark.range(1).write.parquet(f"file://{tmp_path}/m/topics")
    with pytest.raises(ValueError):
        tables.load_model(spark, f"file://{tmp_path}/m", ["topics"])


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, emb_hd array<double>")
    docs.write.parquet(f"{tmp_path}/docs")
    centres = spark.createDataFrame([(0, [0.0, 2.0]), (1, [3.0, 0.1])], "topic_idx int, centroid_hd array<double>")
    stream = placed_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/docs"), centres)
    q = stream.writeStream.format("memory").queryName("placed").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("placed").collect())) == [(1, 1), (2, 0)]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = windowed_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
