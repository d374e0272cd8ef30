"""Hash embeddings by numpy, on batches that Spark hands to a task: buckets, not dense vectors, go over."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _counts(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes row * width + bucket, and how often each occurs."""
    row = np.repeat(np.arange(len(lists), dtype=np.int64), np.asarray(lists.value_lengths().fill_null(0)))
    return np.unique(row * width + np.asarray(lists.flatten(), np.int64), return_counts=True)


def _bucket_cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    n = len(a)
    width = 1 + max((int(np.asarray(x.flatten()).max(initial=0)) for x in (a, b)), default=0)
    (ka, na), (kb, nb) = _counts(a, width), _counts(b, width)
    norms = np.sqrt(np.bincount(ka // width, na * na, n)) * np.sqrt(np.bincount(kb // width, nb * nb, n))
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    dot = np.bincount(both // width, na[i] * nb[j], n)
    cosine = np.divide(dot, norms, out=np.zeros(n), where=norms != 0)
    return pa.array(cosine, mask=np.asarray(a.is_null()) | np.asarray(b.is_null()))


def bucket_cosine(a: Column, b: Column) -> Column:
    """text.bucket_cosine for columns of rows, a batch at a time; inside lambdas there is only that one."""
    return F.arrow_udf(_bucket_cosine, "double")(a, b)


def half_up(x: np.ndarray, places: int = 9) -> np.ndarray:
    """Rounded as F.round does: halves go up by the shortest decimal of the double."""
    x = np.asarray(x, np.float64)
    scaled = np.abs(x) * 10.0**places
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**places, x)
    unit = Decimal(1).scaleb(-places)
    for i in np.flatnonzero(np.abs(scaled % 1.0 - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP))
    return out


def dense(lists: list[list[int]]) -> np.ndarray:
    """A row of counts for each list, over the buckets that occur; and as its last column the norm of the row."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
    _, code = np.unique(flat, return_inverse=True)
    width = int(code.max(initial=-1)) + 1
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    d = np.bincount(row * width + code, minlength=len(lists) * width).reshape(len(lists), width).astype(np.float64)
    return np.column_stack([d, np.sqrt((d * d).sum(axis=1))])


def cosines(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The rounded cosine of each row of dense() to one of them."""
    norms = many[:, -1] * one[-1]
    return half_up(np.divide(many[:, :-1] @ one[:-1], norms, out=np.zeros(len(many)), where=norms != 0))


def over_jobs(fold: Callable, out: str, *columns: Column) -> Column:
    """fold(arrays of one job) for each row of a table that has a row a job."""

    def run(*batch: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in batch], strict=True)
        return pa.array([fold(*r) for r in rows], kind)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(out))
    return F.arrow_udf(run, out)(*columns)
