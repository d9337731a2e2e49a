"""Plug points for tokenizers and embedders, with rule-based defaults that need no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import words


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A bag of words hashed to ``dimensions`` signed counts; words and hashes are native, the counts of a batch are added up at once."""
    # A word's place, and its sign as the place's.
    place = lambda h: (F.pmod(h, F.lit(dimensions)) + 1) * F.when(F.shiftright(h, 40) % 2 == 0, 1).otherwise(-1)

    def counts(places: pa.Array) -> pa.Array:
        n = len(places)
        row, at = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(places), 0).to_numpy()), places.flatten().to_numpy()
        told = np.bincount(row * dimensions + np.abs(at) - 1, np.sign(at), n * dimensions)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dimensions)
        return pa.ListArray.from_arrays(offsets, pa.array(told, pa.float64()), mask=places.is_null())

    return F.arrow_udf(counts, "array<double>")(F.transform(words(F.lower(text)), lambda w: place(F.xxhash64(w))))


def embedder(model: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from a model that maps a list of texts to a matrix, one Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float32)))

    return embed
