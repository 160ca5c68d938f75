"""Vectors of texts: unit length, and an embedder that needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(vector: Column) -> Column:
    """``vector`` scaled to length one; a zero vector stays."""
    squares = F.aggregate(F.transform(vector.cast("array<double>"), lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return F.when(squares == 0, vector.cast("array<float>")).otherwise(F.transform(vector.cast("array<double>"), lambda x: (x / F.sqrt(squares)).cast("float")))


def hashing_embedder(size: int = 256, seed: int = 0) -> Callable[[Column], Column]:
    """Text to a unit vector of ``size`` components: the sum of a pseudo-random vector for each word, which the word's hash
    seeds. Texts that share words point in similar directions; a text without any is zero."""
    if size <= 0:
        raise ValueError("size must be positive")
    words = re.compile(r"\w+").findall

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def one(text: str | None) -> np.ndarray:
            total = np.zeros(size)
            for word in words((text or "").lower()):
                if word not in known:
                    digest = hashlib.blake2b(f"{seed}:{word}".encode(), digest_size=8).digest()
                    known[word] = np.random.default_rng(int.from_bytes(digest, "big")).standard_normal(size)
                total += known[word]
            norm = np.linalg.norm(total.astype(np.float32))
            return (total / norm if norm else total).astype(np.float32)

        return texts.map(one)

    return embed


def missing(texts: Column, cache_hash: Column) -> Column:
    """Whether a cached vector is of another text than ``texts``, or there is none: it has to be made anew."""
    return cache_hash.isNull() | (cache_hash != F.sha2(F.coalesce(texts, F.lit("")).cast("binary"), 256))
