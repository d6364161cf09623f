"""Providers of vectors and replies. There is no network here: the stub and the mock stand for services, and a service is one
more subclass that the caller passes in."""

from __future__ import annotations

import json
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingProvider(ABC):
    """Turns texts into vectors of dim numbers."""

    name = "provider"
    dim = 0

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[np.ndarray]: ...

    def embed(self, text: str) -> np.ndarray:
        return self.embed_batch([text])[0]

    def healthy(self) -> bool:
        return len(self.embed("ping")) == self.dim


class StubEmbedding(EmbeddingProvider):
    """Counts the states of a running FNV-1a hash over the bytes of a text by their remainder, as a unit vector."""

    name = "stub"
    #: Fixed values of the hash.
    OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v, state = np.zeros(self.dim), self.OFFSET
            for byte in text.encode():
                state = ((state ^ byte) * self.PRIME) & 0xFFFFFFFFFFFFFFFF
                v[state % self.dim] += 1
            size = np.sqrt((v * v).sum())
            out.append((v / size if size else v).astype(np.float32))
        return out


class HttpEmbedding(EmbeddingProvider):
    """An endpoint of the common /embeddings form. Vectors of another length are an error."""

    name = "http"

    def __init__(self, base_url: str, api_key: str, model: str, dim: int, timeout: float = 60.0):
        self.base_url, self.api_key, self.model, self.dim, self.timeout = base_url.rstrip("/"), api_key, model, dim, timeout

    def embed_batch(self, texts: list[str]) -> list[np.ndarray]:
        reply = _posted(f"{self.base_url}/embeddings", self.api_key, {"model": self.model, "input": texts}, self.timeout)
        return self.parsed(reply, len(texts))

    def parsed(self, reply: dict, count: int) -> list[np.ndarray]:
        rows = sorted(reply["data"], key=lambda r: r.get("index", 0))
        if len(rows) != count or any(len(r["embedding"]) != self.dim for r in rows):
            raise ValueError(f"expected {count} vectors of {self.dim} numbers")
        return [np.array(r["embedding"], np.float32) for r in rows]


class LlmProvider(ABC):
    """Completes a prompt."""

    name = "llm"

    @abstractmethod
    def complete(self, prompt: str, system: str | None = None) -> str: ...

    def complete_json(self, prompt: str, system: str | None = None):
        return json.loads(self.complete(prompt, system))


class MockLlm(LlmProvider):
    """The reply of the first pattern that the prompt contains, else the default."""

    name = "mock"

    def __init__(self, replies: dict[str, str], default: str = '{"observations":[]}'):
        self.replies, self.default = replies, default

    def complete(self, prompt: str, system: str | None = None) -> str:
        return next((r for p, r in self.replies.items() if p in prompt), self.default)


class HttpLlm(LlmProvider):
    """An endpoint of the common /chat/completions form."""

    name = "http"

    def __init__(self, base_url: str, api_key: str, model: str, timeout: float = 120.0):
        self.base_url, self.api_key, self.model, self.timeout = base_url.rstrip("/"), api_key, model, timeout

    def complete(self, prompt: str, system: str | None = None) -> str:
        messages = [{"role": "system", "content": system}] * (system is not None) + [{"role": "user", "content": prompt}]
        return _posted(f"{self.base_url}/chat/completions", self.api_key, {"model": self.model, "messages": messages}, self.timeout)["choices"][0]["message"]["content"]


def _posted(url: str, api_key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


def embedded(rows: DataFrame, text: str, provider: EmbeddingProvider, batch: int = 256) -> DataFrame:
    """rows with the column vector; batches of a partition go to the provider one by one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[np.ndarray] = []
            for i in range(0, len(f), batch):
                vectors += provider.embed_batch([t or "" for t in f[text].iloc[i : i + batch]])
            yield f.assign(vector=[v.tolist() for v in vectors])

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<float>")


def completed(rows: DataFrame, prompt: str, provider: LlmProvider, system: str | None = None) -> DataFrame:
    """rows with the column reply."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(reply=[provider.complete(p, system) for p in f[prompt]])

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", reply string")


def decoded_vector(blob: bytes) -> np.ndarray:
    """A vector from its stored form: 32-bit floats, least byte first."""
    if len(blob) % 4:
        raise ValueError("a stored vector has four bytes for each number")
    return np.frombuffer(blob, "<f4")


def encoded_vector(vector) -> bytes:
    return np.asarray(vector, "<f4").tobytes()
