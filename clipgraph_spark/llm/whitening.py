"""Whitening of vectors: covariance by distributed sums, leading components by a symmetric eigensolver, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, table

#: The covariance has dims * dims entries on the driver and in each task; longer vectors are refused.
MAX_DIMS = 2048
COMPONENTS = 32
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Grid:
    """How an entry c becomes a whole number: floor(scale * c) + offset."""

    scale: float = 64.0
    offset: int = 1_000_000


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors of `dims` entries with sums S, and the components (rows) with their eigenvalues."""

    grid: Grid
    n: int
    sums: tuple[int, ...]
    peak: int
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)


# -- whole-number vectors ---------------------------------------------------------------------


def _valid(col: pa.Array, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of all rows, which rows are valid, and the whole numbers of all rows, flat.

    Null rows, and rows with a null, non-finite or (beyond 2^62) too large entry are not valid.
    """
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(col).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(flat * grid.scale)
        bad = ~np.isfinite(flat) | ~(np.abs(scaled) < 2.0**62)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    ok = lengths >= 0
    ok[row[bad]] = False
    return lengths, ok, np.where(bad, 0, scaled).astype(np.int64) + grid.offset


def _rows(col: pa.Array, grid: Grid, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the valid rows of `dims` entries, and their matrix."""
    lengths, ok, flat = _valid(col, grid)
    ok &= lengths == dims
    return np.flatnonzero(ok), flat[np.repeat(ok, np.maximum(lengths, 0))].reshape(-1, dims)


def _sums(batches: Iterator[pa.RecordBatch], grid: Grid) -> Iterator[pa.RecordBatch]:
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    peak: dict[int, int] = {}
    for b in batches:
        lengths, ok, flat = _valid(b.column(0), grid)
        entry = np.repeat(np.where(ok, lengths, -1), np.maximum(lengths, 0))
        for d in np.unique(lengths[ok]).tolist():
            m = int((ok & (lengths == d)).sum())
            count[d] = count.get(d, 0) + m
            if 0 < d <= MAX_DIMS:
                x = flat[entry == d].reshape(m, d)
                most = max(abs(int(x.min())), abs(int(x.max())))
                peak[d] = max(peak.get(d, 0), most)
                s = x.sum(0) if most * m < 1 << 62 else x.astype(object).sum(0)
                total[d] = total.get(d, 0) + s.astype(object)
    rows = [(d, n, i, str(s), peak.get(d, 0)) for d, n in count.items() for i, s in enumerate(total.get(d, [0]))]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["dims", "n", "i", "s", "peak"])


def _centred(x: np.ndarray, fit: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S in whole numbers (wide ones where 64 bits may not hold them), and x - S / n."""
    narrow = fit.n * (fit.peak + 1) < 1 << 61
    moved = fit.n * (x if narrow else x.astype(object)) - np.array(fit.sums, np.int64 if narrow else object)
    return moved, (moved / fit.n).astype(float)


def _squares(moved: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None where it passes 64 bits."""
    if not moved.size:
        return [0] * len(moved)
    most = max(abs(int(moved.min())), abs(int(moved.max())))
    if most * most * moved.shape[1] < 1 << 63:
        return (moved * moved).sum(1).tolist()
    wide = moved.astype(object)
    return [s if s < 1 << 63 else None for s in (wide * wide).sum(1).tolist()]


# -- distributed sums -------------------------------------------------------------------------


def _products(vectors: DataFrame, rows_of, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of y and of y y' over all rows; rows_of gives the matrix of a batch. A task sends its lower triangle once."""

    def run(batches):
        total, gram = np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            y = rows_of(b)
            total += y.sum(0)
            gram += y.T @ y
        rows = [[total[i], *gram[i, : i + 1]] for i in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "part"])

    parts = vectors.mapInArrow(run, "i int, part array<double>").select("i", F.posexplode("part").alias("j", "v"))
    total, gram = np.zeros(dims), np.zeros((dims, dims))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (found[c].to_numpy() for c in ("i", "j", "v"))
    total[i[j == 0]] = v[j == 0]
    gram[i[j > 0], j[j > 0] - 1] = v[j > 0]
    return total, np.tril(gram) + np.tril(gram, -1).T


# -- the symmetric eigensolver ------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and reflectors of Householder's reduction: a = Q T Q', Q the product of the reflections."""
    a, n, reflectors = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        size = np.linalg.norm(v)
        if size == 0 or not v[1:].any():
            reflectors.append(None)
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = alpha
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each of x, how many eigenvalues of the tridiagonal matrix lie below it: the negative pivots."""
    tiny = max(np.finfo(float).tiny, float((e * e).max(initial=0.0)) * np.finfo(float).tiny * 4)
    q = d[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of Gershgorin's interval on Sturm counts."""
    n = len(d)
    reach = np.abs(np.concatenate([e, [0.0]])) + np.abs(np.concatenate([[0.0], e]))
    pad = EPS * n * max(np.abs(d).max(), reach.max()) + np.finfo(float).tiny
    lo, hi = np.full(k, (d - reach).min() - pad), np.full(k, (d + reach).max() + pad)
    below = n - np.arange(k)  # the (j+1)-th largest has n - j eigenvalues not above it
    while True:
        mid = (lo + hi) / 2
        open_ = (mid > lo) & (mid < hi) & (hi - lo > EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not open_.any():
            return mid
        above = sturm_count(d, e, mid) >= below
        hi, lo = np.where(open_ & above, mid, hi), np.where(open_ & ~above, mid, lo)


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float):
    """Solves (T - shift) x = b by elimination with row exchanges; pivots below `least` are raised to it."""
    n = len(d)
    main, up, up2, low = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n, e.tolist()
    swap, factor = [False] * n, [0.0] * n
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            swap[i] = True
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
        if abs(main[i]) < least:
            main[i] = least
        factor[i] = f = low[i] / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * up2[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            s = x[i]
            if i + 1 < n:
                s -= up[i] * x[i + 1]
            if i + 2 < n:
                s -= up2[i] * x[i + 2]
            x[i] = s / main[i]
        return np.array(x)

    return solve


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) for falling eigenvalues; those of a cluster are kept orthogonal to each other.

    A cluster is a run of eigenvalues whose neighbours differ by less than a thousandth of the matrix's size; equal
    ones are pushed apart by some units of the last place, so that their systems differ.
    """
    size = float(np.abs(d).max() + (2 * np.abs(e).max() if len(e) else 0.0))
    out, rng, start, last = np.zeros((len(values), len(d))), np.random.default_rng(7), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            start = j
        shift = min(value, last - 10 * EPS * size)
        last = shift
        solve, x = _solver(d, e, shift, EPS * size), rng.standard_normal(len(d))
        for _ in range(6):
            for _ in range(2):
                x = x - out[start:j].T @ (out[start:j] @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x = x - out[start:j].T @ (out[start:j] @ x)
        out[j] = x / np.linalg.norm(x)
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to k leading eigenvalues of a covariance and their unit eigenvectors (rows), the largest entry positive.

    Eigenvalues that are zero to working precision are left out: there is nothing to whiten along them.
    """
    size = float(np.abs(v).max(initial=0.0))
    if not size:
        return np.empty(0), np.empty((0, len(v)))
    d, e, reflectors = tridiagonal(v / size)
    x = inverse_iteration(d, e, leading_values(d, e, min(k, len(v)))).T
    for j in range(len(reflectors) - 1, -1, -1):
        if reflectors[j] is not None:
            x[j + 1 :] -= 2 * np.outer(reflectors[j], reflectors[j] @ x[j + 1 :])
    x = x.T / np.linalg.norm(x, axis=0)[:, None]
    values = np.einsum("ki,ij,kj->k", x, v, x)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > EPS * len(v) * values.max()]
    x = x[order]
    return values[order], x * np.where(x[np.arange(len(x)), np.abs(x).argmax(1)] < 0, -1.0, 1.0)[:, None]


# -- the operator -----------------------------------------------------------------------------


def fit(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS, grid: Grid = Grid()) -> Whitening | None:
    """Sums first, then the covariance of the centred vectors (divisor n), then its k leading components on the driver.

    The vectors of the commonest length (ties: the longest) are fitted. None if there are none. What comes to the
    driver is dims * dims sums, whatever the rows; more than MAX_DIMS dimensions are refused.
    """
    only = vectors.select(column)
    rows = only.mapInArrow(lambda it: _sums(it, grid), "dims long, n long, i long, s string, peak long")
    per = rows.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("peak").alias("peak"))
    best = per.where("dims > 0 and i = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not best:
        return None
    dims = best[0]["dims"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MAX_DIMS} are fitted")
    found = sorted(per.where(F.col("dims") == dims).collect(), key=lambda r: r["i"])
    start = Whitening(grid, found[0]["n"], tuple(int(r["s"]) for r in found), max(r["peak"] for r in found), 0.0, np.empty(0), np.empty((0, dims)))
    total, gram = _products(only, lambda b: _centred(_rows(b.column(0), grid, dims)[1], start)[1], dims)
    mean = total / start.n  # what rounding has left of it
    v = gram / start.n - np.outer(mean, mean)
    values, components = leading_components(v, k)
    return Whitening(grid, start.n, start.sums, start.peak, float(np.trace(v)), values, components)


def project(vectors: DataFrame, model: Whitening, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """`keep`, deviation and whitened (an array, by component) of each valid vector of the fitted length.

    deviation is the exact sum of (n * x - S)^2, null where it passes 64 bits.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    own = free_names(vectors.select(*keep), "deviation", "whitened")
    fields = vectors.select(*keep).schema.fields
    packed = vectors.select(F.struct(*keep).alias("k"), F.col(column).alias("v"))

    def run(batches):
        m = shared.value
        scaled = (m.components / np.sqrt(m.values)[:, None]).T
        for b in batches:
            at, x = _rows(b["v"], m.grid, m.dims)
            moved, y = _centred(x, m)
            flat = (y @ scaled).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(m.values)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b["k"].take(pa.array(at)), pa.array(_squares(moved), pa.int64()), lists], names=["k", *own])

    kept = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    return packed.mapInArrow(run, f"k struct<{kept}>, {own[0]} long, {own[1]} array<double>").select("k.*", *own)


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    total, gram = _products(projected.select("whitened"), lambda b: b.column(0).values.to_numpy().reshape(-1, k), k)
    mean = total / model.n
    return float(np.abs(gram / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding", k: int = COMPONENTS, grid: Grid = Grid()) -> DataFrame:
    """A row for each valid vector and component: `keep`, component, n, deviation, whitened, explained, identity_error.

    Null vectors, vectors with null or non-finite entries (or one too large for a long), empty vectors and vectors
    of another length than the commonest are dropped. Repeated rows count and stay; other columns are not read, and
    names in `keep` may be any but the result's own. Components are numbered by falling eigenvalue; those of
    eigenvalue zero are absent, so vectors that are all alike, or one vector alone, give no row, as does an empty table.
    """
    model = fit(vectors, column, k, grid)
    if model is None or not len(model.values):
        own = (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))
        return vectors.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in own]).where(F.lit(False))
    # keep's names are free: the projection's own columns are made longer where they clash
    packed = project(vectors.select(F.struct(*keep).alias("k"), F.col(column).alias("v")), model, ("k",), "v")
    error = identity_error(packed, model)
    explained = F.array(*[F.lit(float(x)) for x in model.values / model.trace])
    rows = packed.select("k", "deviation", F.posexplode("whitened").alias("at", "w"))
    return rows.select(
        "k.*", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
