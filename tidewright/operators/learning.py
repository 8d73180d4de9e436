"""Training of tree models on purged folds, calibrated probabilities, importances and fold metrics, with Spark's own estimators.

Folds are tables of (fold, id, role); a fold's model is trained by Spark on its training rows, so the only loop on the driver is over
the folds, of which there are a few dozen.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.staging import staged

LABELS = (-1, 0, 1)
#: A split as a forest describes it: the feature's place and the threshold.
_SPLIT = re.compile(r"If \(feature (\d+) <= ([^)]+)\)")


def forest(features: list[str], trees: int = 100, depth: int = 8, leaf: int = 5, seed: int = 42) -> Pipeline:
    """Medians for nulls, then a random forest over the root of the features at each split; labels ``y_``, weights ``w_``."""
    filled = [f"{f}__filled" for f in features]
    model = RandomForestClassifier(labelCol="y_", weightCol="w_", featuresCol="x_", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="x_"), model])


def balanced(rows: DataFrame, label: str, weight: str | None) -> DataFrame:
    """``rows`` with ``y_``, the label's place among :data:`LABELS`, and ``w_``: the weight times what gives every label the same sum."""
    base = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = rows.withColumn("y_", (F.col(label) + 1).cast("double")).withColumn("w_", base)
    of_label = rows.groupBy("y_").agg(F.sum("w_").alias("s_"))
    total = of_label.agg(F.sum("s_").alias("t_"), F.count("*").alias("k_"))
    share = F.broadcast(of_label.join(F.broadcast(total)).select(F.col("y_").alias("y1_"), (F.col("t_") / F.col("k_") / F.col("s_")).alias("f_")))  # three rows
    return rows.join(share, rows["y_"] == share["y1_"]).withColumn("w_", F.col("w_") * F.col("f_")).drop("y1_", "f_")


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p_``, an array of the probabilities of :data:`LABELS`; labels that training didn't have get 0."""
    p = vector_to_array("probability")
    padded = F.slice(F.concat(p, F.array_repeat(F.lit(0.0), 3)), 1, 3)
    out = model.transform(rows).withColumn("p_", padded)
    return out.drop("probability", "rawPrediction", "prediction", "x_", *(c for c in out.columns if c.endswith("__filled")))


def _inputs(model: PipelineModel) -> list[str]:
    """Features of a model that is as :func:`forest` makes it; none of another."""
    kinds = (ImputerModel, VectorAssembler, RandomForestClassificationModel)
    return list(model.stages[0].getInputCols()) if tuple(map(type, model.stages)) == kinds else []


def _stepped(x: Column, edges: list[float], above: float) -> Column:
    """The smallest of the ascending ``edges`` that ``x`` doesn't exceed, or ``above``."""
    if not edges:
        return F.lit(above)
    mid = len(edges) // 2
    return F.when(x <= edges[mid], _stepped(x, edges[:mid], edges[mid])).otherwise(_stepped(x, edges[mid + 1 :], above))


def alike(rows: DataFrame, models: list[PipelineModel]) -> DataFrame:
    """``rows`` with one value for all that lie between the same two thresholds of a feature, which no tree of the models tells apart.

    So there are few vectors, however many rows, and predictions stay what they are. Models other than :func:`forest`'s change nothing.
    """
    inputs = [_inputs(m) for m in models]
    if not all(inputs):
        return rows
    edges: dict[str, set[float]] = {f: set() for names in inputs for f in names}
    for names, model in zip(inputs, models, strict=True):
        for k, at in _SPLIT.findall(model.stages[-1].toDebugString):
            edges[names[int(k)]].add(float(at))
    kinds, new = dict(rows.dtypes), {}
    for f in edges:
        if kinds[f] == "double":
            x, at = F.col(f), sorted(edges[f])
            new[f] = F.when(x.isNull() | F.isnan(x), x).otherwise(_stepped(x, at, math.nextafter(at[-1], math.inf) if at else 0.0))
    return rows.withColumns(new) if new else rows


class Calibrated:
    """A forest per inner fold, and for each label an isotonic map from its out-of-fold probability to the label's frequency.

    Probabilities are the mean over the forests of the mapped ones, divided by their sum (all alike where that is 0). Inner
    folds are runs of ``order``, so a fold's rows are neighbours in time. Rows have a unique ``id``.
    """

    def __init__(self, models: list[PipelineModel], maps: list[list]) -> None:
        self.models, self.maps = models, maps

    @classmethod
    def fit(cls, make: Callable[[], Pipeline], rows: DataFrame, order: str, folds: int = 3) -> Calibrated:
        # Inner folds by quantiles of the order: a few numbers.
        edges = rows.approxQuantile(order, [k / folds for k in range(1, folds)], 0.001)
        inner = F.lit(0)
        for e in edges:
            inner = inner + (F.col(order) > e).cast("int")
        # Trees draw rows by partition and place: the same rows must lie in the same places for reruns to agree.
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.withColumn("inner_", inner).repartition(parts, "id").sortWithinPartitions("id").persist()
        models, maps = [], []
        for k in range(folds):
            model = make().fit(rows.filter(F.col("inner_") != k))
            held = rows.filter(F.col("inner_") == k)
            if names := _inputs(model):  # rows that no tree tells apart are scored once
                held = alike(held, [model]).groupBy(*names, "y_").agg(F.sum("w_").alias("w_"))
            held = probabilities(model, held).persist()
            models.append(model)
            maps.append([
                IsotonicRegression(featuresCol="f_", labelCol="l_", weightCol="w_").fit(held.select(F.col("p_")[j].alias("f_"), (F.col("y_") == j).cast("double").alias("l_"), "w_")) for j in range(len(LABELS))
            ])
            held.unpersist()
        rows.unpersist()
        return cls(models, maps)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p_``, calibrated."""
        names = []
        for k, (model, maps) in enumerate(zip(self.models, self.maps, strict=True)):
            rows = probabilities(model, rows).withColumnRenamed("p_", f"q{k}_")
            for j, m in enumerate(maps):
                m.setFeaturesCol("f_").setPredictionCol(f"c{k}{j}_")
                rows = m.transform(rows.withColumn("f_", F.col(f"q{k}_")[j])).drop("f_")
                names.append(f"c{k}{j}_")
        mean = [sum(F.col(f"c{k}{j}_") for k in range(len(self.models))) / len(self.models) for j in range(len(LABELS))]
        total = mean[0] + mean[1] + mean[2]
        p = F.array(*(F.when(total > 0, m / total).otherwise(F.lit(1 / len(LABELS))) for m in mean))
        return rows.withColumn("p_", p).drop(*names, *(f"q{k}_" for k in range(len(self.models))))

    def importances(self, features: list[str]) -> dict[str, float]:
        """Mean decrease of impurity of the forests, each summing to one."""
        vectors = [m.stages[-1].featureImportances.toArray() for m in self.models]
        return {f: float(sum(v[i] for v in vectors) / len(vectors)) for i, f in enumerate(features)}


def train_on_folds(rows: DataFrame, folds: DataFrame, fold: str, features: list[str], label: str, order: str, weight: str | None = None, least: int = 30, make: Callable[[], Pipeline] | None = None) -> tuple[DataFrame | None, dict]:
    """Out-of-sample predictions of every fold, and each fold's fitted model.

    ``rows`` has ``id``, ``order`` (a number), features, a label of -1, 0, 1; ``folds`` has ``fold, id, role`` with ``train`` and ``test``.
    A fold with fewer than ``least`` training rows, or with one label only, is skipped. Returns ``fold, id, y_true, y_pred, prob_m1, prob_0,
    prob_p1`` (None without folds) and the models by fold.
    """
    make = make or (lambda: forest(features))
    rows, folds = staged(rows), staged(folds)  # each model reads them many times
    counts = folds.join(rows.select("id", label), "id").filter("role = 'train'").groupBy(fold).agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"))
    out, models = None, {}
    for r in counts.filter((F.col("n") >= least) & (F.col("k") > 1)).orderBy(fold).collect():
        own = folds.filter(F.col(fold) == r[fold])
        train = balanced(rows.join(own.filter("role = 'train'").select("id"), "id"), label, weight)
        model = Calibrated.fit(make, train, order)
        test = model.probabilities(rows.join(own.filter("role = 'test'").select("id"), "id"))
        models[r[fold]] = model
        part = predictions(test, label).select(F.lit(r[fold]).alias("fold"), "id", "y_true", "y_pred", "prob_m1", "prob_0", "prob_p1")
        out = part if out is None else out.unionByName(part)
    return out, models


def predictions(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``y_true``, the most probable label (of equally probable ones the smallest) and the three probabilities."""
    best = (F.array_position("p_", F.array_max("p_")) - 2).cast("int")
    return rows.select("*", F.col(label).cast("int").alias("y_true"), best.alias("y_pred"), *(F.col("p_")[j].alias(n) for j, n in enumerate(("prob_m1", "prob_0", "prob_p1"))))


def fold_metrics(predicted: DataFrame, by: list[str] = ["fold"]) -> DataFrame:  # noqa: B006
    """``by, n, accuracy, f1_weighted, log_loss, auc`` of predictions, all folds at once.

    F1 is weighted by the true labels' counts, a label that is never right counts 0. Log loss is that of the true label's probability,
    no smaller than 1e-15. ``auc`` is for folds with two labels, one of them 1: the chance that a row of it has a higher
    ``prob_p1`` than another, ties by half. It comes from counts per probability, summed over hundredths first and within them then, so a
    fold of any size is many tasks' work.
    """
    # Like predictions are counted first: the one shuffle of the rows, which all that follows shares.
    like = predicted.groupBy(*by, "y_true", "y_pred", "prob_m1", "prob_0", "prob_p1").agg(F.count("*").alias("c"))
    p_true = F.when(F.col("y_true") == -1, F.col("prob_m1")).when(F.col("y_true") == 0, F.col("prob_0")).otherwise(F.col("prob_p1"))
    n, of = F.sum("c"), lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0))
    f1 = F.lit(0.0)
    for y in LABELS:
        hit, true, called = of((F.col("y_true") == y) & (F.col("y_pred") == y)), of(F.col("y_true") == y), of(F.col("y_pred") == y)
        f1 = f1 + F.when(hit > 0, true * 2.0 * hit / (true + called)).otherwise(0.0)
    base = like.groupBy(*by).agg(
        n.alias("n"), (of(F.col("y_true") == F.col("y_pred")) / n).alias("accuracy"), (F.sum(-F.log(F.greatest(p_true, F.lit(1e-15))) * F.col("c")) / n).alias("log_loss"), (f1 / n).alias("f1_weighted"),
        F.countDistinct("y_true").alias("labels"), of(F.col("y_true") == 1).alias("ones"),
    )
    counts = like.groupBy(*by, F.floor(F.col("prob_p1") * 100).alias("part_"), "prob_p1").agg(of(F.col("y_true") == 1).alias("pos"), of(F.col("y_true") != 1).alias("neg"))
    inside = Window.partitionBy(*by, "part_").orderBy("prob_p1")
    ranked = counts.withColumn("under_", F.sum("neg").over(inside) - F.col("neg"))
    parts = ranked.groupBy(*by, "part_").agg(F.sum("neg").alias("all_"), F.sum("pos").alias("pos_"), F.sum(F.col("pos") * (F.col("under_") + F.col("neg") / 2.0)).alias("won_"))
    parts = parts.withColumn("below_", F.sum("all_").over(Window.partitionBy(*by).orderBy("part_")) - F.col("all_"))
    wins = parts.groupBy(*by).agg((F.sum(F.col("won_") + F.col("pos_") * F.col("below_")) / (F.sum("pos_") * F.sum("all_"))).alias("auc_"))
    auc = F.when((F.col("labels") == 2) & (F.col("ones") > 0), F.col("auc_")).alias("auc")
    return base.join(wins, by).select(*by, "n", "accuracy", "f1_weighted", "log_loss", auc)


def shuffled(rows: DataFrame, columns: str | list[str], seed: int, parts: int = 256) -> DataFrame:
    """``rows`` (with a unique ``id``) whose ``columns`` have their values dealt out anew, together, by a hash of the seed; reruns agree.

    The values at each place in order of one hash go to the row at that place in order of another. Places are counted by leading bits
    of the hash first, then within them.
    """
    columns = [columns] if isinstance(columns, str) else columns

    def places(df: DataFrame, salt: int) -> DataFrame:
        h = F.xxhash64("id", F.lit(seed), F.lit(salt))
        df = df.withColumn("h_", h).withColumn("b_", F.pmod("h_", F.lit(parts)))
        sizes = df.groupBy("b_").count().withColumn("before_", F.sum("count").over(Window.orderBy("b_")) - F.col("count")).drop("count")  # ``parts`` rows
        return df.join(F.broadcast(sizes), "b_").withColumn("place_", F.col("before_") + F.row_number().over(Window.partitionBy("b_").orderBy("h_", "id"))).drop("h_", "b_", "before_")

    values = places(rows.select("id", *(F.col(c).alias(f"value{i}_") for i, c in enumerate(columns))), 1).drop("id")
    dealt = {c: F.col(f"value{i}_") for i, c in enumerate(columns)}
    return places(rows, 2).join(values, "place_").withColumns(dealt).drop("place_", *(f"value{i}_" for i in range(len(columns))))


def permutation_importance(model: Calibrated, rows: DataFrame, features: list[str], label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """``feature, importance, deviation``: how much accuracy falls when a feature's values are dealt out anew, mean and deviation over ``repeats``.

    A repeat deals all features out in one go, by the same places; a trial takes one of them from there and the others from the row. Trials
    are counted by vector and label, with values that no tree tells apart as one, and every vector is scored once.
    """
    inputs = [_inputs(m) for m in model.models]
    read = {f for names in inputs for f in names} if all(inputs) else {*rows.columns} - {"id", label}
    fixed = sorted(read - {*features})  # what the model reads besides
    rows = staged(alike(rows.select("id", *features, *fixed, label), model.models))
    trials = rows.select(*features, *fixed, label, F.lit(-1).alias("trial_"))
    other = [f"{f}__dealt" for f in features]
    for k in range(repeats):
        dealt = shuffled(rows.select("*", *(F.col(f).alias(o) for f, o in zip(features, other, strict=True))), other, seed * 1000 + k)
        each = [F.struct(*(F.col(other[j] if j == i else g).alias(g) for j, g in enumerate(features)), F.lit(i * repeats + k).alias("trial_")) for i in range(len(features))]
        trials = trials.unionByName(dealt.select(*fixed, label, F.explode(F.array(*each)).alias("t_")).select("t_.*", *fixed, label))
    counts = trials.filter(F.col(label).isNotNull()).groupBy(*features, *fixed, label, "trial_").agg(F.count("*").alias("c_"))
    vectors = counts.groupBy(*features, *fixed).agg(F.collect_list(F.struct(label, "trial_", "c_")).alias("of_"))
    scored = predictions(model.probabilities(vectors).select("p_", F.explode("of_").alias("t_")).select("p_", "t_.*"), label)
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("c_")).otherwise(0)) / F.sum("c_")
    base = F.max(F.when(F.col("trial_") < 0, F.col("acc"))).over(Window.partitionBy())  # a row a trial
    falls = scored.groupBy("trial_").agg(right.alias("acc")).withColumn("fall", base - F.col("acc")).filter("trial_ >= 0")
    name = F.element_at(F.array(*map(F.lit, features)), F.floor(F.col("trial_") / repeats).cast("int") + 1)
    return falls.groupBy(name.alias("feature")).agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("deviation"))
