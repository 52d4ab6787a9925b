"""Searching and editing topics, directly or through a chat model that picks a tool."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators import build, cluster, topics
from topicloom.operators.build import TopicSet
from topicloom.operators.describe import Enhancer

KNN, PER_DOC, RESERVE = 20, 1000, 100


def _vector(values) -> F.Column:
    return F.array(*(F.lit(float(x)) for x in values))


class TopicPrompting:
    """Holds the current topic set. Edits return a new one, and make it the current one with ``inplace``."""

    def __init__(self, topic_set: TopicSet, embed: Callable[[list[str]], list], enhancer: Enhancer | None = None, n_topwords: int = build.N_TOPWORDS):
        self.topic_set, self.embed, self.enhancer, self.n_topwords = topic_set, embed, enhancer or Enhancer(), n_topwords

    # ---- reading

    def get_topic_lis(self) -> list[dict]:
        return [r.asDict() for r in self.topic_set.topics.select("topic_idx", "topic_name", "topic_description", "n_docs").orderBy("topic_idx").collect()]

    def set_topic_lis(self, topic_set: TopicSet) -> None:
        self.topic_set = topic_set
        self.reindex_topics()

    def show_topic_lis(self) -> str:
        text = "\n".join(f"Topic {t['topic_idx']}: {t['topic_name']}\n{t['topic_description']}" for t in self.get_topic_lis())
        print(text)
        return text

    def reindex_topics(self) -> None:
        """Indices from 0 without gaps, in their order."""
        old = self.topic_set.indices()
        if old != list(range(len(old))):
            self.topic_set = build.replaced(self.topic_set, [], self.topic_set.assignment.select("doc_id", F.col("topic_idx").alias("part")).limit(0), self.n_topwords)

    def _check(self, *indices: int) -> None:
        if missing := set(indices) - set(self.topic_set.indices()):
            raise ValueError(f"no such topics: {sorted(missing)}")

    def knn_search(self, topic_index: int, query: str, k: int = KNN, doc_cutoff_threshold: int = PER_DOC) -> tuple[list[str], list[int]]:
        """Texts of the topic's documents nearest to the query, each cut, as far as the context goes; and their places in the topic."""
        self._check(topic_index)
        docs = self.topic_set.docs()
        found = topics.knn_search(docs, _vector(self.embed([query])[0]), topic_index, k, per_doc=doc_cutoff_threshold, budget=self.enhancer.context - RESERVE)
        rows = sorted(found.join(docs.select("doc_id", "text", "doc_pos"), "doc_id").collect(), key=lambda r: r["rank"])  # at most k
        return [" ".join(r.text.split(" ")[:doc_cutoff_threshold]) for r in rows], [r.doc_pos for r in rows]

    def identify_topic_idx(self, query: str, n_tries: int = 3) -> int | None:
        """The topic that the chat model finds nearest to a query, None where it says -1."""
        lines = "\n".join(f"{t['topic_idx']}: {t['topic_name']}. {t['topic_description']}" for t in self.get_topic_lis())
        messages = [{"role": "system", "content": "Answer with the index of the topic that fits the request best, -1 if none does."}, {"role": "user", "content": f"Topics:\n{lines}\nRequest: {query}"}]
        for _ in range(n_tries):
            reply = self.enhancer.chat.chat(messages, temperature=self.enhancer.temperature)["content"] or ""
            if found := re.search(r"-?\d+", reply):
                return None if int(found.group()) == -1 else int(found.group())
        raise ValueError("the reply names no topic")

    def nearest_topic(self, query: str) -> int:
        """The topic whose centroid is nearest to a query; needs no chat model."""
        point = self.topic_set.topics.select(F.lit(0).alias("doc_id")).limit(1).withColumn("emb_hd", _vector(self.embed([query])[0]))
        return topics.nearest(point, self.topic_set.topics, "emb_hd", "centroid_hd", "topic_idx").first().topic_idx

    def prompt_knn_search(self, llm_query: str, topic_index: int | None = None, n_tries: int = 3) -> tuple[str, tuple[list[str], list[int]]]:
        """An answer from the documents found for a question, and these."""
        if topic_index is None:
            topic_index = self.identify_topic_idx(llm_query, n_tries)
        if topic_index is None:
            raise ValueError("no topic fits the question")
        found = self.knn_search(topic_index, llm_query)
        messages = [{"role": "system", "content": "Answer the question from the documents alone."}, {"role": "user", "content": "Documents:\n" + "\n".join(found[0]) + f"\nQuestion: {llm_query}"}]
        for last in range(n_tries):
            try:
                return self.enhancer.chat.chat(messages, temperature=self.enhancer.temperature)["content"], found
            except Exception:
                if last == n_tries - 1:
                    raise
        raise ValueError("n_tries must be positive")

    def get_topic_information(self, topic_idx_lis: list[int], max_number_topwords: int = 500) -> dict[int, str]:
        self._check(*topic_idx_lis)
        rows = build.topic_information(self.topic_set.topics, self.topic_set.top_words, topic_idx_lis, max_number_topwords, budget=self.enhancer.context)
        return {r.topic_idx: r.information for r in rows.orderBy("topic_idx").collect()}

    # ---- editing

    def _done(self, new: TopicSet, fresh: list[int], inplace: bool) -> TopicSet:
        new = self.enhancer.describe_topics(new, only=fresh)
        if inplace:
            self.topic_set = new
        return new

    def _replaced(self, removed: list[int], parts: DataFrame, inplace: bool) -> TopicSet:
        new = build.replaced(self.topic_set, removed, parts, self.n_topwords)
        return self._done(new, new.indices()[len(self.topic_set.indices()) - len(removed) :], inplace)

    def _own(self, topic: int) -> DataFrame:
        self._check(topic)
        return self.topic_set.docs().filter(F.col("topic_idx") == topic)

    def split_topic_new_assignments(self, topic_idx: int, assignments: DataFrame, inplace: bool = False) -> TopicSet:
        """A topic in as many new ones as ``assignments`` (doc_id, part) has parts, -1 included."""
        own = self._own(topic_idx).select("doc_id")
        return self._replaced([topic_idx], assignments.join(own, "doc_id", "left_semi"), inplace)

    def split_topic_kmeans(self, topic_idx: int, n_clusters: int = 2, inplace: bool = False) -> TopicSet:
        return self._replaced([topic_idx], cluster.kmeans_parts(self._own(topic_idx), n_clusters), inplace)

    def split_topic_hdbscan(self, topic_idx: int, min_cluster_size: int = 100, inplace: bool = False) -> TopicSet:
        """By density; what belongs to no part becomes a topic as well."""
        return self._replaced([topic_idx], cluster.density_clusters(self._own(topic_idx), min_size=min_cluster_size).withColumnRenamed("topic_idx", "part"), inplace)

    def _keywords(self, keywords: list[str]) -> DataFrame:
        rows = [(k, [float(x) for x in v]) for k, v in enumerate(self.embed(keywords))]
        return self.topic_set.topics.sparkSession.createDataFrame(rows, "keyword_idx int, emb_kw array<double>")

    def split_topic_keywords(self, topic_idx: int, keywords: list[str], inplace: bool = False) -> TopicSet:
        if len(keywords) < 2:
            raise ValueError("needs two keywords at least")
        parts = topics.split_by_keywords(self._own(topic_idx), topic_idx, self._keywords(keywords), strict=True)
        return self._replaced([topic_idx], parts.withColumnRenamed("keyword_idx", "part"), inplace)

    def split_topic_single_keyword(self, topic_idx: int, keyword: str, inplace: bool = False) -> TopicSet:
        """By the topic's own name and a keyword."""
        self._check(topic_idx)
        name = self.topic_set.topics.filter(F.col("topic_idx") == topic_idx).first().topic_name or ""
        return self.split_topic_keywords(topic_idx, [name, keyword], inplace)

    def combine_topics(self, topic_idx_lis: list[int], inplace: bool = False) -> TopicSet:
        self._check(*topic_idx_lis)
        parts = self.topic_set.assignment.filter(F.col("topic_idx").isin(topic_idx_lis)).select("doc_id", F.lit(0).alias("part"))
        return self._replaced(list(topic_idx_lis), parts, inplace)

    def _rebuilt(self, assignment: DataFrame, inplace: bool) -> TopicSet:
        """All topics extracted again under another assignment; documents that it leaves out stay outliers."""
        old = self.topic_set
        docs = old.base.join(assignment, "doc_id", "left").withColumn("topic_idx", F.coalesce("topic_idx", F.lit(-1)))
        new = build.build_topics(docs, old.reducer, old.word_vectors, old.vocab, n_topwords=self.n_topwords)
        return self._done(new, new.indices(), inplace)

    def add_new_topic_keyword(self, keyword: str, inplace: bool = False, rename_new_topic: bool = False) -> TopicSet:
        """Documents closer to the keyword than to their own centroid form a new last topic; with ``rename_new_topic`` it is called by the keyword."""
        old = self.topic_set
        point = old.topics.select(F.lit(0).alias("i")).limit(1).withColumn("emb_hd", _vector(self.embed([keyword])[0]))
        low = old.reducer.transform(point, "emb_hd", "emb_ld").first().emb_ld
        moved = topics.add_topic(old.docs().filter("topic_idx >= 0").drop("similarity"), _vector(low), old.topics.select("topic_idx", "centroid_ld"), "emb_ld", "centroid_ld")
        new = self._rebuilt(moved, inplace)
        if rename_new_topic:
            new = new.named({max(new.indices()): (keyword, None)})
            if inplace:
                self.topic_set = new
        return new

    def delete_topic(self, topic_idx: int, inplace: bool = False, only_orphans: bool = False) -> TopicSet:
        """Every document goes to the nearest centroid that is left, or only the deleted topic's."""
        self._check(topic_idx)
        old = self.topic_set
        moved = topics.delete_topics(old.docs(), [topic_idx], old.topics.select("topic_idx", "centroid_ld"), "emb_ld", "centroid_ld", only_orphans)
        return self._rebuilt(moved, inplace)

    # ---- tools of the chat model

    def tools(self) -> dict[str, dict]:
        """Each tool: its function, what it does, its arguments, and which of the resulting topics it reports (None: what it returns)."""
        one, text, many = {"type": "integer"}, {"type": "string"}, {"type": "array", "items": {"type": "integer"}}
        names, flag = {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}
        parts = lambda a, _new: len(a["keywords"]) if "keywords" in a else a.get("n_clusters", 2)
        every = lambda _a, new: len(new.indices())
        table = [
            ("knn_search", "Find the documents of a topic that answer a question.", {"topic_index": one, "query": text, "k": one}, ["topic_index", "query"], None),
            ("identify_topic_idx", "Find the topic that a description fits.", {"query": text}, ["query"], None),
            ("get_topic_information", "Tell about some topics, to compare them.", {"topic_idx_lis": many}, ["topic_idx_lis"], None),
            ("split_topic_kmeans", "Split a topic into a number of parts.", {"topic_idx": one, "n_clusters": one, "inplace": flag}, ["topic_idx"], parts),
            ("split_topic_hdbscan", "Split a topic where its documents are dense.", {"topic_idx": one, "min_cluster_size": one, "inplace": flag}, ["topic_idx"], every),
            ("split_topic_keywords", "Split a topic by keywords.", {"topic_idx": one, "keywords": names, "inplace": flag}, ["topic_idx", "keywords"], parts),
            ("split_topic_single_keyword", "Split from a topic what a keyword fits better.", {"topic_idx": one, "keyword": text, "inplace": flag}, ["topic_idx", "keyword"], lambda a, new: 2),
            ("combine_topics", "Make one topic of several.", {"topic_idx_lis": many, "inplace": flag}, ["topic_idx_lis"], lambda a, new: 1),
            ("add_new_topic_keyword", "Add a topic for a keyword.", {"keyword": text, "inplace": flag, "rename_new_topic": flag}, ["keyword"], lambda a, new: 1),
            ("delete_topic", "Delete a topic and deal its documents to the others.", {"topic_idx": one, "inplace": flag}, ["topic_idx"], every),
        ]
        return {n: {"call": getattr(self, n), "description": d, "properties": p, "required": r, "last": k} for n, d, p, r, k in table}

    def tool_schemas(self) -> list[dict]:
        return [{"type": "function", "function": {"name": n, "description": t["description"], "parameters": {"type": "object", "properties": t["properties"], "required": t["required"]}}} for n, t in self.tools().items()]

    def call_tool(self, name: str, arguments: dict) -> tuple[str, object]:
        """A tool's result as JSON and as it is. Unknown tools and arguments are errors."""
        tool = self.tools().get(name)
        if tool is None:
            raise ValueError(f"no such tool: {name}")
        if wrong := (set(arguments) - set(tool["properties"])) | (set(tool["required"]) - set(arguments)):
            raise ValueError(f"{name}: wrong or missing arguments {sorted(wrong)}")
        if name == "split_topic_hdbscan":
            arguments = {"min_cluster_size": 10, **arguments}
        result = tool["call"](**arguments)
        if tool["last"] is None:
            return json.dumps(result), result
        first = len(result.indices()) - tool["last"](arguments, result)
        return build.topics_json(result.topics.filter(F.col("topic_idx") >= first)).first().json, result

    def general_prompt(self, prompt: str, n_tries: int = 2) -> tuple[list[dict], object]:
        """The messages of a request and its tool's result: the chat model picks a tool, gets its result, and answers. None where it picks none."""
        lines = "\n".join(f"{t['topic_idx']}: {t['topic_name']}" for t in self.get_topic_lis())
        messages = [{"role": "system", "content": f"You work on these topics with the given tools.\n{lines}"}, {"role": "user", "content": prompt}]
        for last in range(n_tries):
            message = self.enhancer.chat.chat(messages, tools=self.tool_schemas(), temperature=self.enhancer.temperature)
            calls = message.get("tool_calls")
            if not calls:
                return [*messages, {"role": "assistant", "content": message.get("content")}], None
            function = calls[0]["function"]
            try:
                text, result = self.call_tool(function["name"], json.loads(function["arguments"]))
            except (ValueError, TypeError, KeyError):
                if last == n_tries - 1:
                    raise
                continue
            messages += [{"role": "assistant", "content": None, "tool_calls": calls[:1]}, {"role": "tool", "tool_call_id": calls[0].get("id"), "content": text}]
            answer = self.enhancer.chat.chat(messages, temperature=self.enhancer.temperature)
            return [*messages, {"role": "assistant", "content": answer.get("content")}], result
        raise ValueError("n_tries must be positive")
