"""Vectors of texts from a pluggable embedder, in chunks, with retries.

An embedder is a callable from a list of texts to a list of equally long vectors
(None for a text that failed). ``HashEmbedder`` works offline; ``RemoteClient``
speaks to a server that the caller names.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import split_long
from topicloom.functions.tokens import SpaceTokens, TokenCounter
from topicloom.functions.vectors import mean_vectors

MAX_TOKENS, TRIES = 8191, 3


class HashEmbedder:
    """Offline stand-in: signed hashed word counts of length 1; equal for equal texts on every machine."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for k, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[k, h % self.dims] += 1.0 if h >> 63 else -1.0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class RemoteClient:
    """Embeddings and chat from a server with a JSON interface. With ``deployment`` the model is part of the path, as hosted deployments have it.

    The key is given by the caller and is kept out of plans: embedders are made in the workers by a function.
    """

    def __init__(self, base_url: str, key: str, model: str, deployment: str | None = None, version: str | None = None, timeout: float = 60):
        self.base, self.key, self.model, self.deployment, self.version, self.timeout = base_url.rstrip("/"), key, model, deployment, version, timeout

    def url(self, kind: str) -> str:
        path = f"{self.base}/deployments/{self.deployment}/{kind}" if self.deployment else f"{self.base}/{kind}"
        return f"{path}?api-version={self.version}" if self.version else path

    def _post(self, kind: str, body: dict) -> dict:
        head = {"Content-Type": "application/json", **({"api-key": self.key} if self.deployment else {"Authorization": f"Bearer {self.key}"})}
        request = urllib.request.Request(self.url(kind), json.dumps(body).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._post("embeddings", {"model": self.model, "input": [t]})["data"][0]["embedding"] for t in texts]

    def chat(self, messages: list[dict], tools: list[dict] | None = None, temperature: float = 0.5) -> dict:
        """The reply's message: ``content``, and ``tool_calls`` where the model asks for some."""
        body = {"model": self.model, "messages": messages, "temperature": temperature, **({"tools": tools} if tools else {})}
        return self._post("chat/completions", body)["choices"][0]["message"]


def with_retries(embed: Callable, text: str, tries: int = TRIES) -> list[float] | None:
    """The vector of one text, None where every one of ``tries`` + 1 attempts failed."""
    for _ in range(tries + 1):
        try:
            return embed([text])[0]
        except Exception:  # noqa: BLE001  any failure of a remote service
            continue
    return None


def embedded(rows: DataFrame, make: Callable, text: str = "text", out: str = "emb_hd", batch: int = 64, tries: int = TRIES) -> DataFrame:
    """``rows`` with a vector for each text. ``make`` builds the embedder in each worker; failing batches are tried text by text."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` array<double>"

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch].copy()
                texts = some[text].tolist()
                try:
                    found = embed(texts)
                except Exception:  # noqa: BLE001
                    found = [with_retries(embed, t, tries) for t in texts]
                some[out] = pd.Series(list(found), index=some.index, dtype=object)
                yield some

    return rows.mapInPandas(vectors, schema)


def document_embeddings(docs: DataFrame, make: Callable, tokens: TokenCounter | None = None, most: int = MAX_TOKENS, tries: int = TRIES) -> DataFrame:
    """(doc_id, emb_hd): mean of the vectors of each text's chunks that could be embedded; null where none could."""
    size = (tokens or SpaceTokens()).count(F.col("text"))
    chunks = docs.select("doc_id", F.explode(split_long(F.col("text"), size, most)).alias("text"))
    found = embedded(chunks, make, tries=tries).select("doc_id", "emb_hd")
    means = mean_vectors(found.filter("emb_hd is not null"), ["doc_id"], "emb_hd", "emb_hd")
    return docs.select("doc_id").join(means, "doc_id", "left")


def vocabulary_embeddings(vocab: DataFrame, make: Callable, tries: int = TRIES) -> DataFrame:
    """(word, emb_hd) of each distinct word."""
    return embedded(vocab.select("word").distinct(), make, text="word", tries=tries)


def token_total(docs: DataFrame, tokens: TokenCounter | None = None) -> DataFrame:
    """One row: tokens of the whole corpus."""
    return docs.agg(F.sum((tokens or SpaceTokens()).count(F.col("text")).cast("long")).alias("n_tokens"))


def message_tokens(messages: DataFrame, tokens: TokenCounter | None = None) -> DataFrame:
    """(conv_id, n_tokens): tokens of the messages' contents, roles not counted."""
    return messages.groupBy("conv_id").agg(F.sum((tokens or SpaceTokens()).count(F.col("text")).cast("long")).alias("n_tokens"))
