"""Model calls as pluggable column functions, with deterministic stand-ins.

A provider is a plain function from a list of inputs to a list of outputs; it runs in Arrow batches, a client per
task.  Filter before a model column: Spark may evaluate it for rows that a later condition drops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sanitized

Provider = Callable[[list[str]], list]


def in_batches(provider: Provider, inputs: list[str], size: int, default=None) -> list:
    """Outputs for all inputs; a batch whose count does not match is asked one by one, nothing becomes ``default``."""
    out: list = []
    for at in range(0, len(inputs), size):
        part = inputs[at : at + size]
        found = provider(part)
        if len(found) != len(part):
            found = [(provider([x]) or [default])[0] for x in part]
        out += [default if f is None else f for f in found]
    return out


def model_column(make_provider: Callable[[], Provider], kind: T.DataType, *, size: int = 25, default=None) -> Callable[[Column], Column]:
    """A column function over sanitized text; null inputs stay null."""

    @F.pandas_udf(kind)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        provider = make_provider()
        for s in batches:
            known = s.notna()
            out = pd.Series([None] * len(s), dtype=object)
            out[known.to_numpy()] = pd.Series(in_batches(provider, s[known].tolist(), size, default), dtype=object).to_numpy()
            yield out

    return lambda text: call(sanitized(text))


def hashed_embedding(length: int = 64) -> Provider:
    """Stand-in for an embedding model: signs of word hashes, summed."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * length
            for w in t.lower().split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % length] += 1.0 if h[4] & 1 else -1.0
            out.append(v)
        return out

    return embed


def first_sentence(longest: int = 300) -> Provider:
    """Stand-in for a summary model."""
    return lambda texts: [t.strip().split(". ")[0][:longest] for t in texts]


def overlap_rating() -> Provider:
    """Stand-in for a judge of two texts joined by a tab: share of common words in percent."""

    def rate(texts: list[str]) -> list[int]:
        out = []
        for t in texts:
            a, _, b = t.partition("\t")
            x, y = set(a.lower().split()), set(b.lower().split())
            out.append(round(100 * len(x & y) / max(1, len(x | y))))
        return out

    return rate
