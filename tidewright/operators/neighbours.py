"""Mutual information by nearest neighbours, over groups of any size.

Points of a group are dealt to stretches of x by its quantiles, and again of y. A stretch is compared with itself; a point whose
neighbourhood reaches over the edge asks the stretches that it reaches. What lies within a distance on one axis is counted from ranks in
two stretches and the sizes of those between.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.staging import staged


def _stretch(value, edges):
    """The stretch of a value: how many edges are not above it."""
    return F.size(F.filter(edges, lambda e: e <= value))


def _answers(points: DataFrame, queries: DataFrame, by: list[str], axis: str, schema: str, answer) -> DataFrame:
    """``answer(points, queries)`` of each stretch (by, s) of ``points`` and the queries sent to it."""
    keys = [*by, "s"]

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return answer(p, q)

    return points.withColumn("s", F.col(f"s{axis}")).groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, schema)


def mutual_information(df: DataFrame, by: list[str], ident: str, x: str, y: str, k: int = 3, parts: int = 32) -> DataFrame:
    """``by, n, mutual_information`` in nats of ``x`` and ``y``, not below 0, by the distances to the ``k``-th neighbours.

    Both are divided by their deviation; distances are the larger of the two axes'. For each point the others strictly nearer than its
    ``k``-th neighbour are counted on either axis. Rows with a null in either are left out; ``ident`` is unique in a group. Null for
    groups of ``k`` points and fewer, 0 where x or y doesn't vary. Equal points are neighbours at distance 0 (nothing is nearer
    than that), so series of few distinct values want another measure. A stretch should fit a task: about n / ``parts`` points.
    """
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    rows = df.select(*by, F.col(ident).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    rows = staged(rows)  # what follows reads it for edges, points and their ranks
    cuts = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("dx"), F.stddev_pop("y").alias("dy"), F.percentile_approx("x", cuts, 10_000).alias("ex"), F.percentile_approx("y", cuts, 10_000).alias("ey"))
    stats = stats.select(*by, "n", "dx", "dy", *(F.expr(f"transform(array_distinct({e}), v -> v / nullif({d}, 0))").alias(e) for e, d in (("ex", "dx"), ("ey", "dy"))))
    stats = staged(stats)
    alive = stats.filter((F.col("n") > k) & (F.col("dx") > 1e-12) & (F.col("dy") > 1e-12))
    points = rows.join(alive, by).withColumns({"x": F.col("x") / F.col("dx"), "y": F.col("y") / F.col("dy")})
    points = points.withColumns({"sx": _stretch(F.col("x"), F.col("ex")), "sy": _stretch(F.col("y"), F.col("ey"))}).select(*by, "id", "x", "y", "n", "ex", "ey", "sx", "sy")
    near = f"{keys}, id long, x double, y double, d array<double>"

    def nearest(px, py, qx, qy, own: bool, most) -> list[list[float]]:
        """The k smallest distances of each query, in slices of queries; ``own``: queries are the points, each leaves itself out."""
        out = []
        for a in range(0, len(qx), 512):
            d = np.maximum(np.abs(qx[a : a + 512, None] - px[None]), np.abs(qy[a : a + 512, None] - py[None]))
            if own:
                d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            d = np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
            limits = [np.inf] * len(d) if most is None else most[a : a + 512]
            out += [[float(v) for v in row if v < m] for row, m in zip(d, limits, strict=True)]
        return out

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        px, py = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        return pdf[[*by, "id", "x", "y"]].assign(d=nearest(px, py, px, py, True, None))

    first = staged(points.groupBy(*by, "sx").applyInPandas(inside, near))
    bound = F.when(F.size("d") >= k, F.element_at("d", k)).otherwise(F.lit(float("inf")))
    wide = first.join(alive.select(*by, "ex"), by).withColumn("r", bound)
    # Other stretches that the neighbourhood reaches; a point with too few in its own asks all.
    reach = F.sequence(_stretch(F.col("x") - F.col("r"), F.col("ex")), _stretch(F.col("x") + F.col("r"), F.col("ex")))
    asked = wide.withColumn("s", F.explode(reach)).filter(F.col("s") != _stretch(F.col("x"), F.col("ex"))).select(*by, "s", "id", "x", "y", "r")

    def outside(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame(columns=[*by, "id", "x", "y", "d"])
        return q[[*by, "id", "x", "y"]].assign(d=nearest(p["x"].to_numpy(), p["y"].to_numpy(), q["x"].to_numpy(), q["y"].to_numpy(), False, q["r"].to_numpy()))

    more = _answers(points.select(*by, "x", "y", "sx"), asked, by, "x", near, outside)
    radius = staged(first.unionByName(more).groupBy(*by, "id", "x", "y").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("d"))), k).alias("r")))
    counts = []
    for axis in ("x", "y"):
        edges = f"e{axis}"
        sizes = points.groupBy(*by, F.col(f"s{axis}").alias("s")).agg(F.count("*").alias("c"))
        base = sizes.withColumn("before", F.sum("c").over(Window.partitionBy(*by).orderBy("s")) - F.col("c")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("s", "before", "c"))).alias("base"))
        ends = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col(axis) - F.col("r")).alias("at")), F.struct(F.lit(1).alias("sign"), (F.col(axis) + F.col("r")).alias("at"))))
        # The k-th neighbour lies at an end, give or take a rounding: the lower end is sought from just above it.
        sent = F.col("at") + F.when(F.col("sign") < 0, 1e-14 * (F.abs("mid") + F.col("r"))).otherwise(0.0)
        asks = radius.withColumn("end", ends).select(*by, "id", "r", F.col("end.sign").alias("sign"), F.col("end.at").alias("at"), F.col(axis).alias("mid")).join(alive.select(*by, edges), by).withColumn("s", _stretch(sent, F.col(edges))).drop(edges)

        def ranks(p: pd.DataFrame, q: pd.DataFrame, axis=axis) -> pd.DataFrame:
            if not len(q):
                return pd.DataFrame(columns=[*by, "s", "id", "sign", "rank"])
            v = np.sort(p[axis].to_numpy(dtype=float)) if len(p) else np.zeros(0)
            # Before the upper end are those less than r above the middle, before the lower one those not less than r below it.
            at, up, mid, r = q["at"].to_numpy(), q["sign"].to_numpy() > 0, q["mid"].to_numpy(), q["r"].to_numpy()
            before = lambda z: np.where(up, z - mid < r, mid - z >= r)
            rank = np.searchsorted(v, at)
            while len(v):
                more = (rank < len(v)) & before(v[np.minimum(rank, len(v) - 1)])
                less = (rank > 0) & ~before(v[np.maximum(rank - 1, 0)])
                if not (more | less).any():
                    break
                rank = rank + more - (less & ~more)
            return q[[*by, "s", "id", "sign"]].assign(rank=rank)

        told = _answers(points.select(*by, axis, f"s{axis}"), asks, by, axis, f"{keys}, s int, id long, sign int, rank long", ranks).join(base, by)
        before = F.aggregate("base", F.lit(0).cast("long"), lambda acc, b: F.when(b["s"] < F.col("s"), b["before"] + b["c"]).otherwise(acc))
        counts.append(told.withColumn("below", before + F.col("rank")).groupBy(*by, "id").agg((F.sum(F.col("sign") * F.col("below")) - 1).alias(f"n{axis}")))
    both = radius.join(counts[0], [*by, "id"]).join(counts[1], [*by, "id"])
    inner = [F.when(F.col("r") > 0, F.col(c)).otherwise(0) for c in ("nx", "ny")]
    terms = both.select(*by, *(_digamma(c + 1).alias(f"p{i}") for i, c in enumerate(inner))).groupBy(*by).agg(F.avg(F.col("p0") + F.col("p1")).alias("p"))
    found = alive.select(*by, "n").join(terms, by).select(*by, F.greatest(F.lit(0.0), _digamma(F.col("n")) + _digamma(F.lit(k)) - F.col("p")).alias("mutual_information"))
    flat = F.when(F.col("n") > k, F.lit(0.0))
    return stats.select(*by, "n").join(found, by, "left").select(*by, "n", F.coalesce("mutual_information", F.when(F.col("n") > k, flat)).alias("mutual_information"))


def _digamma(n):
    """Of whole numbers from 1 on: shifted by ten, then the asymptotic series (error below 1e-13)."""
    z = n.cast("double") + 10
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8)
    for i in range(10):
        series = series - 1 / (n.cast("double") + i)
    return series
