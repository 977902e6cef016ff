"""Dense vectors of texts by a model, in Arrow batches; the built-in model hashes tokens."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import batches as parted
from ..functions.text import tokens

DIMENSION = 256


def hashed_tokens(words: pa.Array, dimension: int = DIMENSION) -> np.ndarray:
    """Rows of token counts in signed buckets, by the md5 of the token, at unit length; no token gives zeros."""
    distinct = words.flatten().dictionary_encode()
    digest = [hashlib.md5(t.encode()).digest() for t in distinct.dictionary.to_pylist()]
    bucket = np.array([int.from_bytes(h[:4], "big") % dimension for h in digest], np.int64)
    sign = np.array([1.0 if h[4] < 128 else -1.0 for h in digest])
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    at = distinct.indices.to_numpy()
    row = np.repeat(np.arange(len(length)), length)
    out = np.zeros((len(length), dimension))
    if len(at):
        out = np.bincount(row * dimension + bucket[at], weights=sign[at], minlength=out.size).reshape(out.shape)
    return out / np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-300)[:, None]


def embed(df: DataFrame, text: str, out: str, model: Callable[[list[str]], np.ndarray] | None = None, batch_rows: int = 64) -> DataFrame:
    """df with a vector (array<double>) of each whole text; null texts have none.

    ``model`` takes a list of texts and gives a matrix; it gets ``batch_rows`` texts at a time. Without one,
    tokens are hashed into 256 signed buckets.
    """
    columns = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns) + f", `{out}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parted.parts(batch, text if model else "__tokens", 1 << 62 if model else 1 << 17, batch_rows if model else 1024):
                null = part.column(text).is_null().to_numpy(zero_copy_only=False)
                v = np.asarray(model(part.column(text).fill_null("").to_pylist()), float) if model else hashed_tokens(part.column("__tokens"))
                keep = np.ascontiguousarray(v[~null]).ravel()
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(null, 0, v.shape[1]))]).astype(np.int32), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.ListArray.from_arrays(offsets, pa.array(keep))], [*columns, out])

    rows = df.select(*columns) if model else df.select(*columns, tokens(text).alias("__tokens"))
    return rows.mapInArrow(run, schema)
