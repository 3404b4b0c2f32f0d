"""Texts to vectors without a model: words hashed into a fixed number of signed places, unit length."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def vector(text: str | None, dimensions: int) -> list[float] | None:
    """The same text has the same vector everywhere; a text without words has zeros, null has none."""
    if text is None:
        return None
    x = np.zeros(dimensions)
    for w in _WORD.findall(text.lower()):
        h = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        x[(h >> 1) % dimensions] += 1 if h & 1 else -1
    n = np.linalg.norm(x)
    return (x / n if n else x).tolist()


def embedded(text: Column, dimensions: int = 64) -> Column:
    """Batches of texts to vectors. Any function of that shape can take its place, such as one that holds a text encoder."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: vector(t if isinstance(t, str) else None, dimensions))

    return F.pandas_udf(run, "array<double>")(text)
