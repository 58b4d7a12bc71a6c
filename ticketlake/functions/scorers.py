"""Plug-in surface for models: text -> vector and text -> probability.

The caller hands over a factory; it runs in the Python worker, once per worker
process and key, and returns a function over a batch of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchModel = Callable[[list], Sequence[Any]]

_loaded: dict[str, BatchModel] = {}


def _model(key: str, factory: Callable[[], BatchModel]) -> BatchModel:
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def scorer(key: str, factory: Callable[[], BatchModel], return_type: T.DataType):
    """An iterator pandas UDF around the model that ``factory`` loads."""

    @F.pandas_udf(return_type)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, factory)
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if known.any():
                out[known] = pd.Series(
                    list(model(texts[known].tolist())), index=texts.index[known]
                )
            yield out

    return apply


def text_embedder(key: str, factory: Callable[[], BatchModel]):
    """text -> array<float>, e.g. around a sentence encoder."""
    return scorer(key, factory, T.ArrayType(T.FloatType()))


def text_classifier(key: str, factory: Callable[[], BatchModel]):
    """text -> probability of the urgent label, e.g. around a zero-shot model."""
    return scorer(key, factory, T.DoubleType())
