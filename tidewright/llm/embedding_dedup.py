"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt into tiles of bounded size and quantised once; every
pair of tiles is one unit of work, to which only int8 components, scales and error bounds are sent.
A unit vector x is stored as s * q with int8 components q; e = |x - s q| is its own quantisation
error, and for two vectors

    |x.y - s_x s_y q_x.q_y|  <=  e_x + (1 + e_x) e_y.

The int8 products of a pair of tiles are exact in float32 (sums stay below 2**24). Pairs that the
bound puts above the threshold are links, pairs that it puts below are none. Vectors with a pair
that it leaves open go to a second pass over the same units in full precision, where just those
pairs are computed in double precision. A unit returns, for each class with links, how many vectors
it is linked to and the smallest class reachable inside the unit, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, staged
from .components import connected_components, local_labels

THRESHOLD = 0.9
#: Classes in a tile (twice that at most, as they are dealt by hash).
TILE = 4096
#: Rows of a product at a time, pairs recomputed at a time.
ROWS, PAIRS = 512, 1 << 16
#: Covers the float32 arithmetic on bounds and scales.
SLACK = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale and error norm (rounded up) of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(np.square(x - q * scale[:, None]).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, error


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x).sum(axis=1))


class Tile:
    """Quantised unit vectors."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, error: np.ndarray) -> None:
        self.q, self.scale, self.error = q, scale, error

    @classmethod
    def of(cls, x: np.ndarray) -> Tile:
        return cls(*quantise(x / norms(x)[:, None]))


def bounded_pairs(a: Tile, b: Tile, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of two tiles (of one, each pair once, if ``same``) that may reach the threshold, and whether they do for certain."""
    exact = np.float32 if a.q.shape[1] * 127 * 127 < 2**24 else np.float64
    qb, sb, eb = np.ascontiguousarray(b.q.T.astype(exact)), b.scale.astype(np.float32), b.error.astype(np.float32)
    for at in range(0, len(a.q), ROWS):
        rows, first = slice(at, at + ROWS), at if same else 0
        product = (a.q[rows].astype(exact) @ qb[:, first:]).astype(np.float32)
        product *= a.scale[rows, None].astype(np.float32) * sb[None, first:]
        margin = a.error[rows, None].astype(np.float32) + (1 + a.error[rows, None]).astype(np.float32) * eb[None, first:]
        left, right = np.nonzero(product + margin >= threshold - SLACK)
        sure = product[left, right] - margin[left, right] >= threshold + SLACK
        left, right = left + at, right + first
        if same:
            once = left < right
            left, right, sure = left[once], right[once], sure[once]
        if len(left):
            yield left, right, sure


class _Found:
    """Links of a unit: a weight for each class, and a forest."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.links = weight, np.zeros(len(weight), np.int64)
        self.forest: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.weight)
        self.links += np.bincount(i, self.weight[j], n).astype(np.int64) + np.bincount(j, self.weight[i], n).astype(np.int64)
        self.forest.append((i, j))
        if sum(len(x) for x, _ in self.forest) > 1 << 21:  # a forest is enough of the pairs so far
            self.forest = [(np.arange(n), self.labels())]

    def labels(self) -> np.ndarray:
        n = len(self.weight)
        return local_labels(*map(np.concatenate, zip(*self.forest, strict=True)), n) if self.forest else np.arange(n)


_LINKS = "cid long, links long, low long"


def _pack(dtype: str):
    schema = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("q", pa.binary()), ("scale", pa.binary()), ("error", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        flat = group["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype).astype(np.float64)
        tile = Tile.of(flat.reshape(len(group), -1))
        row = [group["dim"][0].as_py(), group["tile"][0].as_py(), group["cid"].to_numpy().astype("<i8").tobytes(), group["n"].to_numpy().astype("<i8").tobytes(), tile.q.tobytes(), tile.scale.astype("<f8").tobytes(), tile.error.astype("<f8").tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _work(threshold: float):
    """Links that the bounds prove, and which classes have pairs that they leave open (``open``)."""
    schema = pa.schema([("dim", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("side", pa.int32()), ("cid", pa.int64()), ("links", pa.int64()), ("low", pa.int64()), ("open", pa.bool_())])

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["tile"])
        if len(rows) == 1 and rows[0]["tile"] != rows[0]["other"]:  # the other tile has no vectors of this length
            return schema.empty_table()
        ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        tiles = [Tile(np.frombuffer(r["q"], np.int8).reshape(len(i), -1), np.frombuffer(r["scale"], "<f8"), np.frombuffer(r["error"], "<f8")) for r, i in zip(rows, ids, strict=True)]
        every, found = np.concatenate(ids), _Found(np.concatenate([np.frombuffer(r["weights"], "<i8") for r in rows]))
        shift, unsure = (len(ids[0]) if len(ids) == 2 else 0), np.zeros(len(every), bool)
        for i, j, sure in bounded_pairs(tiles[0], tiles[-1], len(tiles) == 1, threshold):
            j = j + shift
            found.add(i[sure], j[sure])
            unsure[i[~sure]] = unsure[j[~sure]] = True
        some = np.flatnonzero((found.links > 0) | unsure)
        label = found.labels()
        side = (some >= shift).astype(np.int32) if shift else np.zeros(len(some), np.int32)
        fixed = [pa.array(np.full(len(some), v), f.type) for v, f in zip((rows[0]["dim"], rows[0]["tile"], rows[-1]["tile"]), list(schema)[:3], strict=True)]
        return pa.Table.from_arrays([*fixed, pa.array(side), pa.array(every[some]), pa.array(found.links[some]), pa.array(every[label[some]]), pa.array(unsure[some])], schema=schema)

    return run


def _settle(dtype: str, threshold: float):
    """Of the classes of a unit with open pairs, in full precision: the links among those pairs."""
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("cid", "ascending")]).combine_chunks()
        x = group["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype).astype(np.float64).reshape(len(group), -1)
        shift, every = int((group["side"].to_numpy() == 0).sum()), group["cid"].to_numpy()
        same, length, found = group["a"][0] == group["b"][0], norms(x), _Found(group["n"].to_numpy())
        sides = [Tile.of(x)] if same else [Tile.of(x[:shift]), Tile.of(x[shift:])]
        for i, j, sure in bounded_pairs(sides[0], sides[-1], same, threshold):
            j = j if same else j + shift
            i, j = i[~sure], j[~sure]
            for k in range(0, len(i), PAIRS):
                p, q = i[k : k + PAIRS], j[k : k + PAIRS]
                keep = np.einsum("ij,ij->i", x[p], x[q]) / (length[p] * length[q]) >= threshold
                found.add(p[keep], q[keep])
        some = np.flatnonzero(found.links > 0)
        return pa.Table.from_arrays([pa.array(every[some]), pa.array(found.links[some]), pa.array(every[found.labels()[some]])], schema=schema)

    return run


def embedding_near_dups(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors are linked when their cosine in double precision reaches the threshold. Vectors that are null, empty, all zero,
    or hold null or non-finite components are linked with nothing, nor are vectors of different lengths with each other. Copies
    are one class with a weight: each counts the others among its links. Rows may share an id; a component's id is the smallest
    of its rows' ids. Labels and other columns are not read; an empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    bounded_batches(vectors.sparkSession)
    rows = staged(vectors.select("vec_id", F.when(good, F.transform(x, lambda v: v + F.lit(0).cast(kind))).alias("vec")), "vectors")
    classes = rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cid"), "vec", "first", "n"), "vector-classes")
    tiles = max(1, math.ceil(classes.count() / tile))
    dealt = classes.select("cid", "n", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("cid"), F.lit(tiles)).alias("tile"))
    packed = dealt.groupBy("dim", "tile").applyInArrow(_pack(dtype), "dim int, tile long, ids binary, weights binary, q binary, scale binary, error binary")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    spread = staged(packed, "vector-tiles").withColumn("other", others)
    units = spread.groupBy("dim", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b")).applyInArrow(_work(threshold), f"dim int, a long, b long, side int, {_LINKS}, open boolean")
    units = staged(units, "vector-links")
    open_ = units.filter("open").select("dim", "a", "b", "side", "cid").join(classes.select("cid", "n", "vec"), "cid")
    settled = staged(open_.groupBy("dim", "a", "b").applyInArrow(_settle(dtype, threshold), _LINKS), "settled-links")
    units = units.filter("links > 0").select("cid", "links", "low").unionByName(settled)
    links = units.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = connected_components(units.select(F.col("cid").alias("u"), F.col("low").alias("v")))
    named = classes.select("cid", "first", "n").join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "first", F.coalesce("component", "cid").alias("component"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "component").join(links, "cid", "left").select(F.col("cid").alias("_cid"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    of_class = classes.join(named, F.col("cid") == F.col("_cid")).select(F.col("vec").alias("_vec"), "n_links", "component_id")
    out = rows.join(of_class, F.col("vec") == F.col("_vec"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
