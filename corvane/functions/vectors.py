"""Vector functions: validity and cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if either has norm 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def problem(v: Column, dim: int | None = None) -> Column:
    """Why a vector is invalid, else null: its length, its first non-finite component, a zero norm."""
    bad = F.array_position(F.transform(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), True)
    out = F.when(v.isNull(), "null")
    if dim is not None:
        out = out.when(F.size(v) != dim, F.concat(F.lit("dimension "), F.size(v)))
    return out.when(bad > 0, F.concat(F.lit("component "), bad - 1)).when(~F.exists(v, lambda x: x != 0), "zero norm")


def cosine_to(query: list[float], v: Column) -> Column:
    """Cosine of each vector to one query, a batch at a time; null for null vectors and those of another length."""
    q = np.asarray(query, np.float64)
    norm = np.linalg.norm(q)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            flat, at = a.values.to_numpy(zero_copy_only=False), a.offsets.to_numpy()
            fits = (np.diff(at) == len(q)) & a.is_valid().to_numpy(zero_copy_only=False)
            out = np.zeros(len(a))
            if fits.all() and len(a):
                x = flat[at[0] : at[-1]].astype(np.float64).reshape(len(a), -1)
            else:
                x = np.array([flat[i:j] if ok else np.ones(len(q)) for i, j, ok in zip(at, at[1:], fits, strict=False)], np.float64).reshape(len(a), len(q))
            n = np.sqrt(np.einsum("ij,ij->i", x, x)) * norm
            np.divide(x @ q, n, out=out, where=n > 0)
            yield pa.array(out, mask=~fits)

    return F.arrow_udf(run, "double")(v)
