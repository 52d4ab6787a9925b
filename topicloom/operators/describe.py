"""Names and descriptions of topics through a chat model, with token budgets and sampling of documents.

A chat model is an object with ``chat(messages, tools=None, temperature=...)`` that
returns a message: a dict with ``content`` and perhaps ``tool_calls``. ``OfflineChat``
needs no server.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from topicloom.functions.tokens import within_budget
from topicloom.operators.build import TopicSet

CONTEXT, TEMPERATURE, TRUNCATE, N_WORDS = 16_384, 0.5, 100, 500


def rough_tokens(text: str) -> int:
    """Offline token count of a string: pieces between single spaces."""
    return len(text.split(" ")) if text else 0


class OfflineChat:
    """Answers from the request alone: a name of the first three words, a description of the first ten."""

    def chat(self, messages: list[dict], tools: list[dict] | None = None, temperature: float = TEMPERATURE) -> dict:
        last = messages[-1]["content"]
        words = (re.findall(r"^Words: (.*)$", last, re.M) or [""])[-1].split(", ")
        if "name" in messages[0]["content"]:
            return {"content": " ".join(words[:3])}
        return {"content": f"About {', '.join(words[:10])}" if words[0] else f"About: {last[:200]}"}


# ---- sampling: which of n documents, by rank -----------------------------------


def sample_first(n: int) -> np.ndarray:
    return np.arange(n)


def sample_uniform(seed: int = 42) -> Callable[[int], np.ndarray]:
    return lambda n: np.random.default_rng(seed).permutation(n)


def sample_poisson(seed: int = 42) -> Callable[[int], np.ndarray]:
    """Ranks drawn from a Poisson law of mean 1, with repeats, so mostly the first documents."""
    return lambda n: np.minimum(np.random.default_rng(seed).poisson(1, n), max(n - 1, 0))


class Enhancer:
    """Requests for names and descriptions; ``count`` gives the tokens of a string."""

    def __init__(self, chat=None, count: Callable[[str], int] = rough_tokens, context: int = CONTEXT, temperature: float = TEMPERATURE):
        self.chat, self.count, self.context, self.temperature = chat or OfflineChat(), count, context, temperature

    def __repr__(self) -> str:
        return f"Enhancer(chat={type(self.chat).__name__}, context={self.context}, temperature={self.temperature})"

    def message_tokens(self, messages: list[dict]) -> int:
        return sum(self.count(m.get("content") or "") for m in messages)

    def _ask(self, messages: list[dict]) -> str:
        return self.chat.chat(messages, temperature=self.temperature)["content"]

    def topword_request(self, words: list[str], n_words: int = N_WORDS, query: Callable[[list[str]], str] | None = None, task: str = "Describe in two sentences what such a topic is about.") -> list[dict]:
        """Messages with as many of the first words as fit into the context."""
        head = [{"role": "system", "content": f"You get the most telling words of a topic, the most important first. {task}"}]
        query = query or (lambda some: f"Words: {', '.join(some)}")
        some = words[:n_words]
        some = within_budget(some, [self.count(w) + 1 for w in some], self.context - self.message_tokens(head) - self.count(query([])))
        return [*head, {"role": "user", "content": query(some)}]

    def describe_topwords(self, words: list[str], n_words: int = N_WORDS, query=None) -> str:
        return self._ask(self.topword_request(words, n_words, query))

    def topic_name(self, words: list[str], n_words: int = N_WORDS, query=None) -> str:
        return self._ask(self.topword_request(words, n_words, query, "Give a name of at most three words.")).strip().strip('"')

    def document_request(self, documents: list[str], truncate: int | None = TRUNCATE, n_documents: int | None = None, query: Callable[[list[str]], str] | None = None) -> list[dict]:
        """Messages with the first documents, each cut to so many words, as far as the context goes; none where the first is too long."""
        head = [{"role": "system", "content": "You get documents of a topic. Describe in two sentences what the topic is about."}]
        query = query or (lambda some: "Documents:\n" + "\n".join(some))
        some = documents[:n_documents]
        if truncate is not None:
            some = [" ".join(d.split(" ")[:truncate]) for d in some]
        some = within_budget(some, [self.count(d) + 1 for d in some], self.context - self.message_tokens(head) - self.count(query([])))
        return [*head, {"role": "user", "content": query(some)}]

    def describe_documents(self, documents: list[str], truncate: int | None = TRUNCATE, n_documents: int | None = None, query=None, sampling: Callable[[int], np.ndarray] | None = None) -> str:
        """``sampling`` gives the places of the documents to use from how many there are; None takes them in order."""
        chosen = [documents[int(k)] for k in (sampling or sample_first)(len(documents))]
        return self._ask(self.document_request(chosen, truncate, n_documents, query))

    def describe_topics(self, topics: TopicSet, n_words: int = N_WORDS, only: list[int] | None = None) -> TopicSet:
        """Names and descriptions of all topics, or of some; one more try after a failure."""
        names = {}
        for topic in topics.indices() if only is None else only:
            words = topics.words(topic, n_words)
            for last in (False, True):
                try:
                    names[topic] = (self.topic_name(words, n_words), self.describe_topwords(words, n_words))
                    break
                except Exception:
                    if last:
                        raise
        return topics.named(names)
