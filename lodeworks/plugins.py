"""What an application supplies from outside: embedders, text models, entailment, web search. Defaults are deterministic and offline."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class TextModel(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...


class EntailmentChecker(Protocol):
    def check(self, claims: Sequence[str], evidence: Sequence[str]) -> list[tuple[str, float]]: ...


class WebSearch(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


class HashingEmbedder:
    """Unit vectors of signed hashed words: a stand-in with the shape of an embedding model, not with its quality."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def fingerprint(self) -> str:
        return hashlib.sha256(f"hashing|{self.dimension}".encode()).hexdigest()


class NoModel:
    """Answers nothing, so that every caller takes its stated fallback."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        return ""


class UnknownEntailment:
    def check(self, claims: Sequence[str], evidence: Sequence[str]) -> list[tuple[str, float]]:
        return [("unknown", 0.0)] * len(claims)


def embed_column(embedder: Embedder, batch: int = 256):
    """A column function that embeds texts in batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = [r for i in range(0, len(texts), batch) for r in embedder.embed(texts.iloc[i : i + batch].tolist())]
            yield pd.Series([r.tolist() for r in rows], index=texts.index)

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder, text: Column) -> DataFrame:
    return chunks.withColumn("embedding", embed_column(embedder)(text))
