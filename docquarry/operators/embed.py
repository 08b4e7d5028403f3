"""Embedders: text to unit vectors of a fixed width.

An embedder has a name, a dimension, and `column`, which turns a text column
into array<float>. Documents and questions must go through the same one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.config import Config
from docquarry.functions.text import SPACES, collapse


class Embedder(Protocol):
    name: str
    dimension: int

    def column(self, text: Column) -> Column: ...


class HashedEmbedder:
    """Counts of hashed words, scaled to length 1.

    Deterministic and without a model, for tests and for lexical retrieval: it
    finds shared words, not shared meaning. With unit=False vectors are the
    counts, whole numbers, to be searched with scale=True.
    """

    def __init__(self, dimension: int = Config.embedding_dimension, unit: bool = True):
        if dimension < 1:
            raise ValueError(f"a dimension must be positive, not {dimension}")
        self.name, self.dimension, self.unit = f"hashed-{dimension}", dimension, unit

    def buckets(self, text: Column) -> Column:
        """The bucket of every word."""
        words = F.filter(F.split(F.lower(collapse(F.coalesce(text, F.lit("")))), SPACES), lambda w: F.length(w) > 0)
        return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % self.dimension).cast("int"))

    def counts(self, text: Column, unit: bool = False) -> Column:
        """How many words fall into each bucket, scaled to length 1 if `unit`.

        Words are hashed by SQL expressions; Arrow batches spread them out.
        """

        dimension = self.dimension

        @F.pandas_udf("array<float>")
        def spread(buckets: pd.Series) -> pd.Series:
            out = np.zeros((len(buckets), dimension), np.float32)
            rows = np.repeat(np.arange(len(buckets)), buckets.map(len).to_numpy(dtype=np.int64))
            if len(rows):
                np.add.at(out, (rows, np.concatenate(buckets.to_list()).astype(np.int64)), 1)
            if unit:
                length = np.sqrt((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
                out = (out / np.where(length > 0, length, 1)).astype(np.float32)
            return pd.Series(list(out))

        return spread(self.buckets(text))

    def column(self, text: Column) -> Column:
        return self.counts(text, self.unit)


_models: dict[str, object] = {}


def _model(name: str):
    """The model, loaded once in each process."""
    if name not in _models:
        from sentence_transformers import SentenceTransformer

        _models[name] = SentenceTransformer(name)
    return _models[name]


class NeuralEmbedder:
    """A sentence-transformers model, run on the executors in Arrow batches. Needs that package and its weights."""

    def __init__(self, name: str = Config.embedding_model):
        self.name = name
        self.dimension = int(_model(name).get_sentence_embedding_dimension())

    def column(self, text: Column) -> Column:

        name = self.name

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _model(name)
            for texts in batches:
                vectors = model.encode(texts.fillna("").tolist(), normalize_embeddings=True, convert_to_numpy=True)
                yield pd.Series(list(vectors.astype("float32")))

        return embed(text)


def create_embedder(name: str | None = None) -> Embedder:
    """hashed or hashed-N, or the name of a sentence-transformers model."""
    if name is None or name == "hashed":
        return HashedEmbedder()
    if name.startswith("hashed-"):
        return HashedEmbedder(int(name.removeprefix("hashed-")))
    return NeuralEmbedder(name)
