"""Text encoders of the user's choice: loaded once per worker, asked in batches, one dense vector per field."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T


class TextEncoder(Protocol):
    """Anything that turns texts into a matrix, one row per text."""

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


# A function without arguments that loads the encoder; it runs on the worker, so nothing large is shipped.
EncoderFactory = Callable[[], TextEncoder]

# Texts given to an encoder in one call.
BATCH_TEXTS = 512


class HashedWords:
    """Word counts in a fixed number of slots, by the first 32 bits of a word's md5."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word, n in Counter(text.split()).items():
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims] += n
        return out


class WordTable:
    """Sum of the vectors a table has for the words of a text; words it lacks count nothing."""

    def __init__(self, vectors: dict[str, Sequence[float]]):
        self.vectors = {w: np.asarray(v, float) for w, v in vectors.items()}
        self.dims = len(next(iter(self.vectors.values()), []))

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        nothing = np.zeros(self.dims)
        return np.array([sum((self.vectors.get(w, nothing) for w in t.split()), nothing) for t in texts]).reshape(len(texts), self.dims)


def encode_fields(df: DataFrame, fields: Sequence[str], factory: EncoderFactory) -> DataFrame:
    """Add ``<field>_vec`` for each field. A batch encodes each distinct text once; null is an empty text.

    The encoder is loaded when a task begins its first batch, not per batch or row.
    """
    added = [f"{f}_vec" for f in fields]
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in added]])
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for batch in batches:
            if not len(batch):
                continue
            texts = [batch[f].fillna("").tolist() for f in fields]
            distinct = list(dict.fromkeys(t for column in texts for t in column))
            vectors = [v for at in range(0, len(distinct), BATCH_TEXTS) for v in np.asarray(encoder.encode(distinct[at:at + BATCH_TEXTS]), float)]
            known = dict(zip(distinct, vectors))
            yield batch[names].assign(**{n: [known[t] for t in column] for n, column in zip(added, texts)})

    return df.select(*names).mapInPandas(run, schema)


def cosine_block(values: Sequence[np.ndarray], goals: Sequence[np.ndarray]) -> np.ndarray:
    """Cosines of every value with every goal, not below 0; a vector without length scores 0."""
    x, y = np.stack([np.asarray(v, float) for v in values]), np.stack([np.asarray(g, float) for g in goals])
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.maximum(np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0), 0.0)


def composite_vectors(df: DataFrame, id_col: str, weights: Mapping[str, float], factory: EncoderFactory) -> DataFrame:
    """(id, vec): weighted mean of the unit vectors of several fields; a field without a vector is left out of the mean."""
    fields = [n for n in weights if n in df.columns]
    shares = np.array([float(weights[n]) for n in fields])
    schema = T.StructType([df.schema[id_col], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack([np.stack(batch[f"{n}_vec"].tolist()) for n in fields])
                size = np.linalg.norm(x, axis=2, keepdims=True)
                units = np.divide(x, size, out=np.zeros_like(x), where=size > 0) * shares[:, None, None]
                present = ((size > 0) * shares[:, None, None]).sum(axis=0)
                mean = np.divide(units.sum(axis=0), present, out=np.zeros(x.shape[1:]), where=present > 0)
                yield pd.DataFrame({id_col: batch[id_col], "vec": list(mean)})

    return encode_fields(df.select(id_col, *fields), fields, factory).mapInPandas(run, schema)
