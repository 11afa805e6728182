"""What a model has to look like, and deterministic defaults that need no service.

A model is an object with one batch method. It is pickled to the executors and used there
on one Arrow batch at a time, so it should open its connection on first use.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from itertools import chain
from typing import Protocol

import numpy as np

from passagebook.functions.text import SPACE

_WORD = re.compile("[^" + SPACE + "]+")
# What str.split would also take for space.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """Same words as the column expression `words`."""
    return text.split() if _OTHER_SPACE.search(text) is None else _WORD.findall(text)


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class Scorer(Protocol):
    def score(self, queries: Sequence[str], contents: Sequence[str]) -> Sequence[float]: ...


class Generator(Protocol):
    name: str

    def generate(
        self,
        questions: Sequence[str],
        contexts: Sequence[str],
        prompts: Sequence[str],
        system_prompt: str,
        max_tokens: int,
        temperature: float,
    ) -> Sequence[tuple[str, int] | Exception]:
        """For each prompt the answer and the number of tokens used, or what went wrong."""
        ...


class Extractor(Protocol):
    def extract(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[str, str]]]:
        """For each text its mentions: entity type and entity."""
        ...


class _Buckets(dict):
    """Word to bucket; remembers a bounded number of words."""

    def __init__(self, dim: int, most: int):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        bucket = int.from_bytes(digest[:4], "big") % self.dim
        if len(self) < self.most:
            self[word] = bucket
        return bucket

    def __reduce__(self):
        return _Buckets, (self.dim, self.most)


class HashedWords:
    """Bag of lower-case words hashed into `dim` buckets, scaled to length 1."""

    name = "hashed-words"

    def __init__(self, dim: int = 1024, cache_size: int = 200_000):
        self.dim = dim
        self._buckets = _Buckets(dim, cache_size)

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        hits = [list(map(self._buckets.__getitem__, split_words(t.lower()))) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(h) for h in hits])
        flat = np.fromiter(chain.from_iterable(hits), np.int64, len(row))
        out = np.bincount(row * self.dim + flat, minlength=len(texts) * self.dim)
        out = out.reshape(len(texts), self.dim).astype(np.float64)
        lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(lengths == 0, 1.0, lengths)


class WordOverlap:
    """F1 of the distinct lower-case words of query and content."""

    def score(self, queries: Sequence[str], contents: Sequence[str]) -> list[float]:
        out = []
        for query, content in zip(queries, contents, strict=True):
            q, c = set(split_words(query.lower())), set(split_words(content.lower()))
            total = len(q) + len(c)
            out.append(2.0 * len(q & c) / total if total else 0.0)
        return out


class ExtractiveGenerator:
    """Answers with the context sentence that shares most distinct words with the question.

    The first such sentence wins a tie. An answer of more than max_tokens words ends there. An
    empty context is an error, so a batch shows it as a failed row.
    """

    name = "extractive"

    def generate(self, questions, contexts, prompts, system_prompt, max_tokens, temperature):
        rows = zip(questions, contexts, prompts, strict=True)
        return [self._answer(*row, max_tokens) if row[1] else ValueError("no context") for row in rows]

    def _answer(self, question: str, context: str, prompt: str, max_tokens: int) -> tuple[str, int]:
        from passagebook.operators.chunking import split_sentences

        asked = set(split_words(question.lower()))
        best, best_hits = "", -1
        for part in context.split("\n\n---\n\n"):
            body = part.split("\n", 1)[1] if part.startswith("[Source: ") else part
            for sentence in split_sentences(body):
                hits = len(asked & set(split_words(sentence.lower())))
                if hits > best_hits:
                    best, best_hits = sentence, hits
        words = split_words(best)
        if len(words) > max_tokens:
            words = words[:max_tokens]
            best = " ".join(words)
        return best, len(split_words(prompt)) + len(words)


def with_retry(
    call: Callable,
    tries: int = 3,
    delay: float = 1.0,
    sleep: Callable[[float], None] = time.sleep,
) -> tuple[object, int, str | None]:
    """Call until it works: (result, attempts, None), or (None, tries, message).

    The pause doubles after every failure.
    """
    message = None
    for attempt in range(tries):
        try:
            return call(), attempt + 1, None
        except Exception as exc:  # noqa: BLE001 - any model failure counts as a failed try
            message = f"{type(exc).__name__}: {exc}"
            if attempt + 1 < tries:
                sleep(delay * 2**attempt)
    return None, tries, message
