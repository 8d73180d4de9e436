"""Whitening of embeddings: leading principal components by matrix-free block Lanczos.

Vectors are made whole numbers first, so that copies are found, sums are exact and deviations can be checked. The covariance is
never made: a step is one pass over the distinct vectors that multiplies their centred rows, and again their transpose, with a block
of columns. Only blocks of (dimensions x columns) come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, discard, lean, staged
from .ordering import only

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Columns of a block: as many as components, so that equal eigenvalues of that number come together.
BLOCK = 16
#: Columns of the basis; a longer one is cut down to its best vectors (a thick restart).
BASIS = 160
#: Residuals, relative to the largest eigenvalue, at which components count as found.
TOLERANCE = 1e-14
#: Eigenvalues below this share of the largest count as zero: there is nothing to scale.
RANK = 1e-10
STEPS = 200
#: Entries must stay whole numbers in double precision; vectors beyond count as not finite.
_LARGEST = 2.0**46
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def whole(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """floor(64 c) of every vector of a column, with its row; without those that are null, empty, or have an entry that is null, not finite or of 2**46 and more."""
    at = column.offsets.to_numpy()
    c = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(c) < _LARGEST)  # NaN, which a null becomes, is smaller than nothing
    x = np.floor(np.where(bad, 0.0, c) * SCALE).astype(np.int64)
    spoiled = np.r_[0, np.cumsum(bad)]
    keep = np.flatnonzero((at[1:] > at[:-1]) & (spoiled[at[1:]] == spoiled[at[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)).tolist()
    return keep, [x[at[i] : at[i + 1]] for i in keep]


def to_code(x: np.ndarray) -> bytes:
    """A whole vector in the fewest bytes an entry; equal vectors have equal codes."""
    for k, kind in enumerate(_WIDTHS):
        limit = np.iinfo(kind)
        if (x.min() >= limit.min and x.max() <= limit.max):
            return bytes([k]) + x.astype(kind).astype(kind(0).dtype.newbyteorder("<")).tobytes()
    raise AssertionError


def from_code(code: bytes) -> np.ndarray:
    return np.frombuffer(code, np.dtype(_WIDTHS[code[0]]).newbyteorder("<"), offset=1).astype(np.int64)


def fit_list(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """``code, length`` of each distinct whole vector once. Copies are taken together before the shuffle."""
    schema = T.StructType.fromDDL("code binary, length int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {to_code(x): len(x) for x in whole(batch.column(0))[1]}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int32())], schema=arrow)

    return only(embeddings, column).mapInArrow(lean(run), schema).distinct()


def _rows(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return np.array([from_code(c) for c in batch.column(column).to_pylist()], np.int64)


def _summed(codes: DataFrame, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of what ``part`` makes of some of them, an array of ``shape``; added up in tasks, then entry by entry."""
    size = int(np.prod(shape))
    schema = T.StructType.fromDDL("entry int, value double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += part(_rows(batch.slice(at, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total.ravel())], schema=arrow)

    out = np.zeros(size)
    for r in codes.select("code").mapInArrow(lean(run), schema).groupBy("entry").agg(F.sum("value").alias("value")).collect():
        out[r["entry"]] = r["value"]
    return out.reshape(shape)


@dataclass
class Centre:
    """Exact mean of the fit list: of ``n`` vectors (without the shift), ``total`` per dimension."""

    n: int
    total: list[int]

    def __post_init__(self) -> None:
        self.middle = np.array([round(t / self.n) if abs(t) < 1 << 52 else t // self.n for t in self.total], np.int64)
        self.rest = [t - self.n * int(m) for t, m in zip(self.total, self.middle, strict=True)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in 64 bits, or as Python numbers where those don't hold it."""
        y = x - self.middle
        most = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.rest), default=0)
        if most < 1 << 62:
            return y * self.n - np.array(self.rest, np.int64)
        return y.astype(object) * self.n - np.array(self.rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)**2 of each row, exact."""
        z = self.scaled(x)
        most = int(np.abs(z).max(initial=0))
        if z.dtype == object or most * most * z.shape[1] >= 1 << 62:
            z = z.astype(object)
        return [int(v) for v in (z * z).sum(axis=1)]


@dataclass
class Whitener:
    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    restarts: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns of ``block`` outside ``basis``, and how many had to be drawn anew because the block broke down.

    Each column is taken out of the basis and of those before it twice. One that is nothing but rounding, next to ``scale``, is replaced
    by a random one, as long as there are directions left.
    """
    d = len(block)
    out, drawn = np.zeros((d, 0)), 0
    for v in block.T:
        for _ in range(8):
            if basis.shape[1] + out.shape[1] >= d:
                return out, drawn
            whole_norm = np.linalg.norm(v)
            w = v
            for _ in range(2):
                w = w - basis @ (basis.T @ w)
                w = w - out @ (out.T @ w)
            norm = np.linalg.norm(w)
            if norm > 1e-11 * max(whole_norm, scale) and norm > 0:
                w = w / norm
                w = w - basis @ (basis.T @ w) - out @ (out.T @ w)
                out = np.column_stack([out, w / np.linalg.norm(w)])
                break
            v, scale, drawn = rng.standard_normal(d), 0.0, drawn + 1
    return out, drawn


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE, seed: int = 7):
    """Largest eigenpairs of the symmetric ``product`` of ``d`` dimensions: (values falling, vectors, largest residual, passes, restarts).

    Every new block is orthogonalised against the whole basis, twice; the products of all basis columns are kept, so Ritz pairs
    and their residuals come from the projected matrix itself and not from recurrences. It ends when the residuals of the ``wanted``
    largest are below ``tolerance`` of the largest value *and* a block of random directions outside the basis brings no larger one,
    or when the basis spans everything. A block that breaks down is filled with random directions.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    q, vq = np.zeros((d, 0)), np.zeros((d, 0))
    top, passes, restarts, checked = 0.0, 0, 0, False
    fresh, _ = _orthogonal(rng.standard_normal((d, min(block, d))), q, 0.0, rng)
    while True:
        made = product(fresh)
        passes += 1
        q, vq = np.column_stack([q, fresh]), np.column_stack([vq, made])
        t = q.T @ vq
        theta, s = np.linalg.eigh((t + t.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        vectors, images = q @ s, vq @ s
        residuals = images - vectors * theta
        norms = np.linalg.norm(residuals, axis=0)
        top = max(abs(theta[0]), top)
        done = q.shape[1] >= wanted and norms[:wanted].max() <= tolerance * max(top, 1e-300)
        if q.shape[1] >= d or passes >= STEPS or (done and checked) or top == 0.0:
            break
        checked = done
        if q.shape[1] + block > basis and q.shape[1] > 2 * block + wanted:
            keep = wanted + block
            q, vq = vectors[:, :keep], images[:, :keep]
            restarts += 1
        lead = np.argsort(norms[: wanted + block])[::-1][:block]
        source = rng.standard_normal((d, block)) if done else residuals[:, lead]
        fresh, drawn = _orthogonal(source, q, 0.0 if done else 1e-3 * tolerance * top, rng)
        restarts += bool(drawn)
        if not fresh.shape[1]:
            break
    return theta[:wanted], vectors[:, :wanted], float(norms[:wanted].max()) if wanted else 0.0, passes, restarts


def fit(embeddings: DataFrame, column: str = "embedding") -> tuple[Whitener | None, DataFrame]:
    """The whitener of the distinct vectors and their staged list; None where there is nothing that varies.

    Vectors of another length than the commonest one (of equally common ones the longest) are left out.
    """
    bounded_batches(embeddings.sparkSession)
    codes = staged(fit_list(embeddings, column), "fit-list")
    sizes = codes.groupBy("length").count().orderBy(F.desc("count"), F.desc("length")).first()
    if sizes is None:
        return None, codes
    d, n = sizes["length"], sizes["count"]
    own = codes.filter(F.col("length") == d)
    own.staged_path = codes.staged_path
    schema = T.StructType.fromDDL("entry int, value decimal(38,0)")
    arrow = to_arrow_schema(schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch)
                total += x.sum(axis=0).astype(object) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], schema=arrow)

    total = [0] * d
    for r in own.select("code").mapInArrow(lean(sums), schema).groupBy("entry").agg(F.sum("value").alias("value")).collect():
        total[r["entry"]] = int(r["value"])
    centre = Centre(n, total)

    def deviation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum(sum(centre.deviations(_rows(b))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([float(found)])], names=["value"])

    # Divided by n**3 at the end: each task's sum is exact, the sum of tasks is a double.
    trace = own.select("code").mapInArrow(lean(deviation), "value double").agg(F.sum("value")).first()[0] / float(n) ** 3

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return _summed(own, block.shape, part) / n

    values, vectors, residual, passes, restarts = block_lanczos(product, d)
    keep = values > RANK * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    if not keep.any():
        return None, own
    values, vectors = values[keep], vectors[:, keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitener(centre, vectors, values, trace, residual, passes, restarts), own


def identity_error(model: Whitener, own: DataFrame) -> float:
    """Largest absolute entry of the covariance of the fit list's whitened vectors less the identity; one pass."""
    k = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(own, (k + 1, k), part) / model.centre.n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Whitened leading components of every vector: a row per vector and component.

    Entries c become whole numbers, x = floor(64 c) + 1000000; covariance, mean and components are those of the distinct x vectors.
    Rows whose vector is null, empty, of another length than the commonest, or holds an entry that is null, not finite or of 2**46 and
    more in size have no result. Repeated rows have one each; they count once in the fit. There are as many components as vary, at
    most 16: none where all vectors are alike, so then and for an empty table there are no rows. Components of equal eigenvalues are
    some orthonormal ones. The sign is that which makes a component's largest entry positive. Other columns, whatever
    their names, are not read.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``; a deviation beyond a long is null.
    """
    rows = only(embeddings, "vec_id", column)
    model, own = fit(rows, column)
    schema = T.StructType([rows.schema["vec_id"], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        discard(own)
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(model, own)
    discard(own)
    arrow = to_arrow_schema(schema)
    d, k = model.vectors.shape
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fit_in = [(i, x) for i, x in zip(*whole(part.column(1)), strict=True) if len(x) == d]
                if not fit_in:
                    continue
                keep, x = [i for i, _ in fit_in], np.array([x for _, x in fit_in])
                m = len(keep)
                deviations = [v if v < 1 << 63 else None for v in model.centre.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(keep, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.centre.n)),
                        pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ], schema=arrow,
                )

    return rows.mapInArrow(lean(run), schema)
