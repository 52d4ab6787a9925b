"""From a corpus to named topics, then searching and editing them, offline."""

import json
import random

import pytest
from pyspark.sql import functions as F

from topicloom.model import TopicModel
from topicloom.operators.describe import Enhancer, OfflineChat

THEMES = {
    "space": "rocket orbit moon launch planet comet telescope galaxy",
    "food": "bread cheese recipe oven flour butter garlic pepper",
    "sport": "goal match player team league referee stadium coach",
}


class ToolChat(OfflineChat):
    """Asks for one tool, then answers from its result; everything else as the offline model."""

    def __init__(self, name="", arguments=None, reply=None):
        self.name, self.arguments, self.reply, self.seen = name, arguments or {}, reply, []

    def chat(self, messages, tools=None, temperature=0.5):
        self.seen.append(messages)
        if tools and self.name:
            assert self.name in {t["function"]["name"] for t in tools}
            return {"content": None, "tool_calls": [{"id": "1", "function": {"name": self.name, "arguments": json.dumps(self.arguments)}}]}
        if messages[-1]["role"] == "tool":
            return {"content": "done: " + messages[-1]["content"][:20]}
        if self.reply is not None and "index of the topic" in messages[0]["content"]:
            return {"content": self.reply}
        return super().chat(messages, tools, temperature)


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(5), [(0, "")]
    for t, words in enumerate(THEMES.values()):
        rows += [(1 + 40 * t + k, " ".join(rng.choices(words.split(), k=16))) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def model(docs):
    return TopicModel(min_cluster_size=8, dims=3, n_topwords=20, n_topwords_description=10, low=0.0, high=1.0).fit(docs)


def test_fit_structure(model):
    topics = model.topic_set
    n = topics.indices()
    assert n == list(range(len(n))) and len(n) >= 3
    docs = topics.docs().collect()
    assert len(docs) == 120 and all(-1 <= r.topic_idx < len(n) for r in docs)
    for k in n:
        own = sorted((r for r in docs if r.topic_idx == k), key=lambda r: r.doc_pos)
        assert [r.doc_pos for r in own] == list(range(len(own)))
        assert all(a.similarity >= b.similarity for a, b in zip(own, own[1:], strict=False))
        assert len({(r.doc_id - 1) // 40 for r in own}) == 1  # no topic mixes themes
    for method in ("tfidf", "cosine_similarity"):
        words = [topics.words(k, 3, method) for k in n]
        assert all(len(w) == 3 for w in words)
    table = model.topic_prompting.get_topic_lis()
    assert all(t["topic_name"] and t["topic_description"] and t["n_docs"] for t in table)
    assert "fitted=True" in repr(model) and model.repr_topics().count("-" * 150) == len(n) - 1
    points = model.visualize_clusters()
    assert points.count() == sum(t["n_docs"] for t in table) and {"x", "y", "hover", "topic_name"} <= set(points.columns)


def test_fixed_number_of_topics_and_given_vectors(docs, model, spark, tmp_path):
    path = f"file://{tmp_path}/vectors"
    model.save_embeddings(path)
    other = TopicModel(n_topics=3, min_cluster_size=8, dims=3, n_topwords=20, n_topwords_description=10, embeddings_path=path).fit(docs, describe=False)
    assert 1 <= len(other.topic_set.indices()) <= 3
    assert set(other.topic_set.vocab.columns) == {"word"}  # words with vectors are the vocabulary
    model.save(f"file://{tmp_path}/model")
    loaded = TopicModel().load(spark, f"file://{tmp_path}/model")
    assert loaded.repr_topics() == model.repr_topics()
    assert loaded.topic_prompting.knn_search(0, "moon", 3) == model.topic_prompting.knn_search(0, "moon", 3)


def test_search(model):
    p = model.topic_prompting
    texts, places = p.knn_search(0, "moon orbit", k=4, doc_cutoff_threshold=5)
    assert len(texts) == len(places) == 4 and all(len(t.split(" ")) == 5 for t in texts)
    theme = {k: (model.topic_set.docs().filter(F.col("topic_idx") == k).first().doc_id - 1) // 40 for k in model.topic_set.indices()}
    assert theme[p.nearest_topic("rocket launch moon planet")] == 0
    p.enhancer = Enhancer(ToolChat(reply="The topic index is: 1"))
    assert p.identify_topic_idx("anything") == 1
    answer, found = p.prompt_knn_search("garlic?", topic_index=None)
    assert answer and len(found[0]) == len(found[1])
    p.enhancer = Enhancer(ToolChat(reply="-1"))
    assert p.identify_topic_idx("anything") is None
    p.enhancer = Enhancer(ToolChat(reply="no idea"))
    with pytest.raises(ValueError):
        p.identify_topic_idx("anything")
    info = p.get_topic_information([0, 1])
    assert set(info) == {0, 1} and "Words:" in info[0]
    with pytest.raises(ValueError):
        p.get_topic_information([99])
    p.enhancer = Enhancer()


def sizes(t):
    return {r.topic_idx: r.n_docs for r in t.topics.collect()}


def test_splits_and_combine(model):
    p, before = model.topic_prompting, sizes(model.topic_set)
    k = len(before)
    two = p.split_topic_kmeans(0, 2)
    assert len(sizes(two)) == k + 1 and sum(sizes(two).values()) == sum(before.values())
    assert [sizes(two)[i] for i in range(k - 1)] == [before[i] for i in range(1, k)]
    assert sizes(two)[k - 1] + sizes(two)[k] == before[0] and all(two.words(i, 3) for i in (k - 1, k))
    assert sizes(model.topic_set) == before
    dense = p.split_topic_hdbscan(0, 5)
    assert sum(sizes(dense).values()) == sum(before.values())
    ids = model.topic_set.assignment.filter("topic_idx = 1").select("doc_id", (F.col("doc_id") % 3 - 1).cast("int").alias("part"))
    assert len(sizes(p.split_topic_new_assignments(1, ids))) == k + 2
    with pytest.raises(ValueError):
        p.split_topic_keywords(0, ["one"])
    own = model.topic_set.words(0, 2)
    assert len(sizes(p.split_topic_keywords(0, own))) == k + 1
    one = p.combine_topics([0, 1])
    assert len(sizes(one)) == k - 1 and sizes(one)[k - 2] == before[0] + before[1]
    words = one.top_words.filter(F.col("topic_idx") == k - 2)
    assert words.count() == words.select("word").distinct().count()


def test_add_and_delete(model):
    p, before = model.topic_prompting, sizes(model.topic_set)
    fewer = p.delete_topic(0)
    assert len(sizes(fewer)) == len(before) - 1 and sum(sizes(fewer).values()) == sum(before.values())
    more = p.add_new_topic_keyword("garlic pepper", rename_new_topic=True)
    assert sum(sizes(more).values()) == sum(before.values())
    assert {r.topic_idx: r.topic_name for r in more.topics.collect()}[max(sizes(more))] == "garlic pepper"


TOOLS = {
    "knn_search": {"topic_index": 0, "query": "moon"}, "identify_topic_idx": {"query": "moon"}, "get_topic_information": {"topic_idx_lis": [0, 1]},
    "split_topic_kmeans": {"topic_idx": 0, "n_clusters": 2}, "combine_topics": {"topic_idx_lis": [0, 1]}, "split_topic_hdbscan": {"topic_idx": 0},
}


@pytest.mark.parametrize("name", sorted(TOOLS))
def test_tools(model, name):
    p = model.topic_prompting
    p.enhancer = Enhancer(ToolChat(name, TOOLS[name], reply="1"))
    answer, result = model.prompt("please")
    assert answer.startswith("done: ") and result is not None
    p.enhancer = Enhancer()


def test_all_tools_are_known_and_bad_calls_fail(model):
    p = model.topic_prompting
    assert len(p.tools()) == len(p.tool_schemas()) == 10
    for name, arguments in (("no_such", {}), ("knn_search", {"query": "x"}), ("delete_topic", {"topic_idx": 0, "x": 1})):
        with pytest.raises(ValueError):
            p.call_tool(name, arguments)
    assert model.prompt("hello")[1] is None  # no tool picked
