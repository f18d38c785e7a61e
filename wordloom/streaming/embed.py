"""Vectors for a stream of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.sources.formats import BinaryModel


def fnv1_32_bytes(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h * 16777619 & 0xFFFFFFFF) ^ b
    return h


def word_grams(word: str, minn: int, maxn: int, unit: str = "byte") -> list[bytes]:
    """n-grams of <word>, cut in bytes or, with unit "char", in characters."""
    whole = f"<{word}>"
    data = whole if unit == "char" else whole.encode()
    n = len(data)
    cut = [data[i : i + k] for i in range(n) for k in range(minn, maxn + 1) if k < n and i + k <= n] if minn >= 1 else []
    return [g.encode() for g in cut] if unit == "char" else cut


def word_vector(model: BinaryModel, index: dict[str, int], word: str, subwords: list[str] | None = None, unit: str = "byte") -> np.ndarray:
    """The mean of the word's own row, if it has one, and its subwords' rows."""
    rows = [index[word]] if word in index else []
    grams = [s.encode() for s in subwords] if subwords else word_grams(word, model.minn, model.maxn, unit)
    if grams and model.buckets > 0:
        rows += [len(model.words) + fnv1_32_bytes(g) % model.buckets for g in grams]
    return np.mean(model.matrix[rows], axis=0) if rows else np.zeros(model.matrix.shape[1])


def before_blank(lines: DataFrame) -> DataFrame:
    """The lines of a file, read as text, before its first empty one."""
    numbered = lines.select("value", F.monotonically_increasing_id().alias("__at"))
    end = numbered.where(F.length("value") == 0).agg(F.coalesce(F.min("__at"), F.lit((1 << 63) - 1)))
    return numbered.where(F.col("__at") < end.scalar()).select("value")


def embed_stream(lines: DataFrame, path: str, unit: str = "byte") -> DataFrame:
    """(w, v) of lines `word [subword ...]` in a column value, in a stream or not.

    Stateless: each worker maps the model file at path, which all workers
    reach, and reads only the rows it needs.  Blank lines give no row; see
    before_blank() for input that ends at one.
    """
    from wordloom.sources.formats import read_model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = read_model(path)
        index = {w: i for i, w in enumerate(model.words)}
        for pdf in batches:
            parts = [x.split() for x in pdf["value"] if x and x.strip()]
            found = [word_vector(model, index, x[0], x[1:] or None, unit) for x in parts]
            # Columns of no rows have no kind of their own.
            yield pd.DataFrame({"w": pd.Series([x[0] for x in parts], dtype=object), "v": pd.Series(found, dtype=object)})

    return lines.select("value").mapInPandas(run, "w string, v array<double>")
