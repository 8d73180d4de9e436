"""Clusters of features that move together, their representatives and first components.

Correlations of all pairs come from one pass over the rows, as matrices of sums; what follows works on matrices of (features x features),
one for each group of series. The number of features is the bound: a thousand of them make a matrix of 8 MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Groups whose matrices a task holds before it hands them on.
HELD = 64
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_moments(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by, i, j, n, r, cov, mean_i`` for places i <= j of ``columns``, over the rows that have both values.

    Values are taken less their mean over all rows, so that products lose no digits. A task adds up matrices of sums, which are
    then added entry by entry. ``r`` is null where either doesn't vary, ``cov`` has divisor n.
    """
    k = len(columns)
    means = df.agg(*(F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"m{i}") for i, c in enumerate(columns))).first()
    shift = np.array([m if m is not None else 0.0 for m in means])
    schema = T.StructType([*(df.schema[b] for b in by), *T.StructType.fromDDL("i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))])
    arrow = to_arrow_schema(schema)
    low, high = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def hand_on() -> pa.RecordBatch:
            keys = [key for key in held for _ in low]
            sums = np.concatenate([m[:, low, high] for m in held.values()], axis=1)
            arrays = [pa.array([key[c] for key in keys], f.type) for c, f in zip(range(len(by)), arrow, strict=False)]
            arrays += [pa.array(np.tile(low, len(held)), pa.int32()), pa.array(np.tile(high, len(held)), pa.int32()), *(pa.array(s) for s in sums)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            x = np.column_stack([batch.column(len(by) + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in range(k)]) - shift
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(len(by))), strict=True)) if by else [()] * len(x)
            where: dict[tuple, list[int]] = {}
            for row, key in enumerate(keys):
                where.setdefault(key, []).append(row)
            for key, at in where.items():
                part = x[at]
                has = np.isfinite(part).astype(np.float64)
                part = np.where(has > 0, part, 0.0)
                sums = np.stack([has.T @ has, part.T @ has, has.T @ part, (part * part).T @ has, has.T @ (part * part), part.T @ part])
                held[key] = held[key] + sums if key in held else sums
            if len(held) > HELD:
                yield hand_on()
        if held:
            yield hand_on()

    added = df.select(*by, *(F.col(c).cast("double") for c in columns)).mapInArrow(run, schema).groupBy(*by, "i", "j").agg(*(F.sum(s).alias(s) for s in _SUMS))
    vx, vy, cov = (F.expr(e) for e in ("sxx / n - sx / n * sx / n", "syy / n - sy / n * sy / n", "sxy / n - sx / n * sy / n"))
    spread = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    base = F.array(*(F.lit(float(s)) for s in shift))
    return added.select(*by, "i", "j", F.col("n").cast("long").alias("n"), F.when(spread > 1e-14, cov / spread).alias("r"), F.when(F.col("n") > 0, cov).alias("cov"), F.when(F.col("n") > 0, F.col("sx") / F.col("n") + F.get(base, F.col("i"))).alias("mean_i"))


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (node, node, height) in the order of their height; nodes from the number of points on are merges before.

    Chains of nearest neighbours: each step goes to the nearest cluster until two are each other's, which are merged. Heights
    don't depend on the order that they are found in.
    """
    n = len(dist)
    d = dist.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    found, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        found.append((a, b, float(d[a, b])))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        size[a] += size[b]
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
    return sorted(found, key=lambda m: m[2])


def cut(merges: list[tuple[int, int, float]], n: int, threshold: float, inclusive: bool) -> np.ndarray:
    """The cluster of each point, named by its first point, of merges below (``inclusive``: or at) the threshold."""
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b, height in merges:
        if height < threshold or (inclusive and height == threshold):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return np.array([top(i) for i in range(n)])


def first_component(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit loadings of the first component, the largest of them positive, and its share of the variance."""
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, -1]
    total = float(np.trace(cov))
    return v * np.sign(v[np.abs(v).argmax()]), float(values[-1]) / total if total > 0 else 0.0


def feature_clusters(df: DataFrame, by: list[str], columns: list[str], threshold: float, inclusive: bool = True) -> DataFrame:
    """``by, feature, cluster, members, representative, loading, explained, mean`` of each feature in each group.

    Distance is 1 - |correlation| (1 where undefined), linkage the average; merges at a height of at most (``inclusive`` false: below)
    ``threshold`` hold. ``cluster`` is the place of its first feature; the representative is the member with the smallest mean distance
    to the members, of equally near ones the first. ``loading`` and ``explained`` belong to the first component of the members'
    covariance; a single member is its own.
    """
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)
    names = list(columns)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = len(names)
        r, cov, mean = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        r[i, j] = r[j, i] = np.nan_to_num(pdf["r"].to_numpy(dtype=float))
        cov[i, j] = cov[j, i] = np.nan_to_num(pdf["cov"].to_numpy(dtype=float))
        same = i == j
        mean[i[same]] = np.nan_to_num(pdf["mean_i"].to_numpy(dtype=float)[same])
        dist = np.clip(1 - np.abs(r), 0, None)
        np.fill_diagonal(dist, 0)
        label = cut(average_linkage(dist), k, threshold, inclusive)
        out = []
        for c in np.unique(label):
            at = np.flatnonzero(label == c)
            near = np.round(dist[np.ix_(at, at)].mean(axis=1), 12)
            loading, explained = first_component(cov[np.ix_(at, at)]) if len(at) > 1 else (np.ones(1), 1.0)
            out += [(*key, names[m], int(c), len(at), bool(n == near.argmin()), float(loading[n]), explained, float(mean[m])) for n, m in enumerate(at)]
        return pd.DataFrame(out, columns=[*by, "feature", "cluster", "members", "representative", "loading", "explained", "mean"])

    return pair_moments(df, by, names).groupBy(*by).applyInPandas(run, f"{keys}, feature string, cluster int, members int, representative boolean, loading double, explained double, mean double")


def eigen_features(df: DataFrame, by: list[str], order: str, columns: list[str], table: DataFrame) -> DataFrame:
    """``by, order, feature, value``: for each row and cluster the first component, under the representative's name; a single member as it is.

    Each group's loadings travel as one array, so rows are joined once and stay as they are; a null value counts as the mean.
    """
    member = F.struct(F.col("feature"), F.col("loading"), F.when(F.col("members") > 1, F.col("mean")).otherwise(F.lit(0.0)).alias("mean"))
    per = table.groupBy(*by, "cluster").agg(F.collect_list(member).alias("parts"), F.max(F.when(F.col("representative"), F.col("feature"))).alias("name"))
    sets = per.groupBy(*by).agg(F.collect_list(F.struct("name", "parts")).alias("clusters_"))
    value = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double"))))
    rows = df.select(*by, order, value.alias("values_")).join(sets, by).select(*by, order, "values_", F.explode("clusters_").alias("c_"))
    part = F.aggregate("c_.parts", F.lit(0.0), lambda acc, p: acc + p["loading"] * (F.coalesce(F.element_at(F.col("values_"), p["feature"]), p["mean"]) - p["mean"]))
    return rows.select(*by, order, F.col("c_.name").alias("feature"), part.alias("value"))


def best_of_clusters(table: DataFrame, by: list[str], scores: DataFrame) -> DataFrame:
    """Of each cluster the feature with the largest absolute ``score`` (null: smallest), of equal ones the first by name."""
    rated = table.select(*by, "feature", "cluster", "members").join(scores.select(*by, "feature", "score"), [*by, "feature"], "left")
    first = F.min(F.struct((-F.coalesce(F.abs("score"), F.lit(-1.0))).alias("far"), "feature", "score", "members"))
    return rated.groupBy(*by, "cluster").agg(first.alias("b")).select(*by, "cluster", "b.feature", "b.score", "b.members")


def max_relevance(df: DataFrame, by: list[str], columns: list[str], target: str, k: int) -> DataFrame:
    """``by, place, feature, relevance, score`` of up to ``k`` features, chosen one after the other in each group.

    Relevance is the F value of the correlation with the target; each step takes the feature with the most of it per mean absolute
    correlation with those taken before (each at least a thousandth), of equally good ones the first. Correlations come from one pass.
    """
    names = [*columns, target]
    keys = ", ".join(f"{b} {df.schema[b].dataType.simpleString()}" for b in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(names)
        r, n = np.zeros((m, m)), np.zeros((m, m))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        r[i, j] = r[j, i] = np.nan_to_num(pdf["r"].to_numpy(dtype=float))
        n[i, j] = n[j, i] = pdf["n"].to_numpy()
        square = r[:-1, -1] ** 2
        f = square / np.maximum(1 - square, 1e-300) * (n[:-1, -1] - 2)
        near, taken, out = np.maximum(np.abs(r[:-1, :-1]), 0.001), [], []
        for place in range(1, min(k, m - 1) + 1):
            score = f / (near[:, taken].mean(axis=1) if taken else 1.0)
            score[taken] = -np.inf
            best = int(score.argmax())
            taken.append(best)
            out.append((*key, place, names[best], float(f[best]), float(score[best])))
        return pd.DataFrame(out, columns=[*by, "place", "feature", "relevance", "score"])

    return pair_moments(df, by, names).groupBy(*by).applyInPandas(run, f"{keys}, place int, feature string, relevance double, score double")
