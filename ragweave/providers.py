"""What models must offer, and deterministic offline stand-ins. Providers are pickled to the workers."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...


class ChatModel(Protocol):
    def chat(self, system: str, user: str, schema: dict | None = None) -> str: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


class HashEmbedder:
    """Counts of words hashed to a fixed number of dimensions; refuses texts over max_chars, as servers do."""

    def __init__(self, dim: int = 64, max_chars: int | None = None):
        self.dim, self.max_chars = dim, max_chars

    def embed(self, text: str) -> list[float]:
        if self.max_chars is not None and len(text) > self.max_chars:
            raise ValueError("text too long")
        out = [0.0] * self.dim
        for w in words(text):
            digest = hashlib.md5(w.encode()).digest()
            out[digest[0] % self.dim] += 1.0 if digest[1] & 1 else -1.0
        return out


class OverlapScorer:
    """Share of the first text's distinct words that the second has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [len(a & b) / len(a) if (a := set(words(x))) and (b := set(words(y))) is not None else 0.0 for x, y in pairs]


class RuleChat:
    """Answers from the prompt alone: splits questions at `and`, quotes the first passage, judges by shared words."""

    def chat(self, system: str, user: str, schema: dict | None = None) -> str:
        if schema is not None:
            question = user.rsplit("Question:", 1)[-1].strip()
            return json.dumps({"queries": [p.strip() for p in re.split(r"\band\b|;", question) if p.strip()]})
        asked = set(words(user.split("Question:", 1)[-1].split("\n", 1)[0]))
        body = user.split("Passages:", 1)[-1].split("Passage:", 1)[-1]
        shared = len(asked & set(words(body)))
        if "RELEVANT" in system:
            return "RELEVANT" if shared * 2 >= len(asked) else "NOT RELEVANT"
        if "UNANSWERABLE" in system:
            return "YES" if shared * 2 >= len(asked) else "NO"
        if "Final Verdict" in system:
            return "Final Verdict: Faithful" if shared else "Final Verdict: Unfaithful"
        passage = body.split("Content:", 1)[-1].strip().split("\n", 1)[0]
        return passage if passage and shared else "I could not find an answer in the passages."


class HttpChat:
    """Chat and embedding over a local model server's JSON interface."""

    def __init__(self, url: str, model: str, timeout: int = 120):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def _post(self, path: str, body: dict) -> dict:
        import urllib.request

        request = urllib.request.Request(f"{self.url}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def chat(self, system: str, user: str, schema: dict | None = None) -> str:
        body = {"model": self.model, "stream": False, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return self._post("/api/chat", body | ({"format": schema} if schema else {}))["message"]["content"]

    def embed(self, text: str) -> list[float]:
        return self._post("/api/embeddings", {"model": self.model, "prompt": text})["embedding"]
