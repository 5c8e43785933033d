"""Pixel classifiers: extra trees for floating material and a boosted ensemble of all classes for the rest, joined by a two-expert rule."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata import ANNOTATOR_WEIGHTS, FLOATING_CLASSES
from .trees import Binned, Trees, boosted, boosted_probabilities, extra_trees, forest_probabilities

DEBRIS_CLASS = FLOATING_CLASSES[0]


def annotator_weight(conf: Column) -> Column:
    out = F.lit(0.4)
    for k, v in ANNOTATOR_WEIGHTS.items():
        out = F.when(conf == k, v).otherwise(out)
    return out


def argmax_class(p: Column, classes: list[int]) -> Column:
    """Class of the largest probability, the first on ties."""
    return F.get(F.array(*map(F.lit, classes)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def two_expert(forest: Column, booster: Column | None, classes: list[int], weight: float = 0.5, floating: tuple[int, ...] = FLOATING_CLASSES) -> Column:
    """The forest decides on floating classes; elsewhere the weighted vote picks the best class that does not float."""
    own = argmax_class(forest, classes)
    if booster is None:
        return own
    keep = F.array(*(F.lit(c not in floating) for c in classes))
    vote = F.zip_with(F.zip_with(forest, booster, lambda a, b: weight * a + (1 - weight) * b), keep, lambda v, k: F.when(k, v).otherwise(-1.0))
    return F.when(own.isin(*floating), own).otherwise(argmax_class(vote, classes))


def group_probability(p: Column, classes: list[int], group: tuple[int, ...]) -> Column:
    return sum((F.get(p, F.lit(i)) for i, c in enumerate(classes) if c in group), F.lit(0.0))


def threshold_override(label: Column, p: Column, threshold: float, to: int) -> Column:
    return F.when(p >= threshold, F.lit(to)).otherwise(label)


def vectors(df: DataFrame, features: list[str] | str, out: str = "features") -> DataFrame:
    """df with an array of columns (missing as 0) or of one array column."""
    x = F.transform(features, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))) if isinstance(features, str) else F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features))
    return df.withColumn(out, x)


@dataclass
class Forest:
    """Extra trees over an array column of so many features."""

    trees: Trees
    width: int

    @property
    def numClasses(self) -> int:  # noqa: N802
        return self.trees.value.shape[1]

    def p(self, features: Column) -> Column:
        return forest_probabilities(features, self.trees, self.width)


@dataclass
class Booster:
    """Rounds of a tree per class, and the scores before them."""

    first: np.ndarray
    rounds: list[Trees]
    width: int

    def p(self, features: Column) -> Column:
        return boosted_probabilities(features, (self.first, self.rounds), self.width)


def fit(df: DataFrame, label: str = "label", weight: str | None = None, trees: int = 40, rounds: int = 10, depth: int = 12, seed: int = 42, booster: bool = True, rate: float = 0.3):
    """(forest, booster) on df (features, label 0..k-1): extra trees, and gradient boosting of all classes on histograms, with trees of a third of the forest's depth."""
    data = Binned(df, "features", label, weight)
    classes = (data.rows.agg(F.max("y")).first()[0] or 0) + 1
    forest = Forest(extra_trees(data, classes, trees, depth, seed=seed), data.features)
    if not booster:
        return forest, None
    return forest, Booster(*boosted(data, classes, rounds, max(2, depth // 3), rate), data.features)


def probabilities(df: DataFrame, forest, booster=None, features: str = "features") -> DataFrame:
    """df with p_forest and, given a booster, p_booster: an array over the classes each."""
    out = df.withColumn("p_forest", forest.p(F.col(features)))
    return out if booster is None else out.withColumn("p_booster", booster.p(F.col(features)))


def importances(forest: Forest, names: list[str], top: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(names, map(float, forest.trees.importances(len(names)))), key=lambda x: -x[1])[:top]


#: Models by name, as an experiment compares them: trees or rounds, depth.
MODELS = {"forest": lambda **kw: fit(booster=False, **kw), "two experts": lambda **kw: fit(**kw)}


class Bundle:
    """A fitted pair with its classes; `save` and `load` keep it in a folder that Spark can write."""

    def __init__(self, forest, booster, classes: list[int]):
        self.forest, self.booster, self.classes = forest, booster, classes

    def judged(self, df: DataFrame, weight: float = 0.5) -> DataFrame:
        """df (features) with label, p_floating and p_debris."""
        p = probabilities(df, self.forest, self.booster)
        label = two_expert(F.col("p_forest"), F.col("p_booster") if self.booster else None, self.classes, weight)
        return p.select(*df.columns, label.alias("label"), group_probability(F.col("p_forest"), self.classes, FLOATING_CLASSES).alias("p_floating"), group_probability(F.col("p_forest"), self.classes, (DEBRIS_CLASS,)).alias("p_debris"))

    def save(self, spark, path: str) -> None:
        """A row per node, and one for what holds for all."""
        rounds = self.booster.rounds if self.booster else []
        nodes = [("forest", self.forest.trees), *(("booster", t) for t in rounds)]
        rows = [(kind, k, i, int(t.feature[i]), float(t.threshold[i]), int(t.bin[i]), int(t.child[i]), float(t.gain[i]), t.value[i].tolist()) for k, (kind, t) in enumerate(nodes) for i in range(len(t.feature))]
        spark.createDataFrame(rows, "kind string, part int, node long, feature int, threshold double, bin int, child long, gain double, value array<double>").write.mode("overwrite").parquet(f"{path}/nodes")
        about = (self.classes, self.forest.width, [t.roots for _, t in nodes], self.booster.first.tolist() if self.booster else None)
        spark.createDataFrame([about], "classes array<int>, width int, roots array<int>, first array<double>").write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> Bundle | None:
        """The bundle of a folder, or None where there is none: detection then goes without. Its nodes are bounded as they were grown (`trees.MOST_NODES`)."""
        from pyspark.errors import AnalysisException

        try:
            about = spark.read.schema("classes array<int>, width int, roots array<int>, first array<double>").json(f"{path}/about").first()
        except AnalysisException:
            return None
        t = spark.read.parquet(f"{path}/nodes").orderBy("part", "node").toPandas()
        grown = []
        for k, roots in enumerate(about.roots):
            part = t[t["part"] == k]
            one = Trees(roots, len(part["value"].iloc[0]))
            one.feature, one.threshold, one.bin, one.child, one.gain = (part[c].to_numpy() for c in ("feature", "threshold", "bin", "child", "gain"))
            one.value = np.stack(part["value"].to_list())
            grown.append(one)
        booster = Booster(np.array(about.first), grown[1:], about.width) if about.first is not None else None
        return cls(Forest(grown[0], about.width), booster, list(about.classes))


def trained(df: DataFrame, label: str = "label", weight: str | None = None, model: str = "two experts", **kw) -> Bundle:
    """A bundle on df (features, label: any class numbers)."""
    classes = sorted(x[0] for x in df.select(F.col(label).cast("int")).distinct().collect())  # a class is a row
    place = F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))))
    forest, booster = MODELS[model](df=df.withColumn("_label", F.element_at(place, F.col(label).cast("int"))), label="_label", weight=weight, **kw)
    return Bundle(forest, booster, classes)


def report(scored: DataFrame, truth: str = "truth", predicted: str = "label") -> dict[str, DataFrame]:
    """What a trained model is judged by: per class, debris, floating, the confusion table."""
    from .evaluate import binary_scores, confusion, precision_recall

    m = confusion(scored, truth, predicted)
    group = lambda ids: binary_scores(scored, F.col(truth).isin(*ids), F.col(predicted).isin(*ids))
    return {"classes": precision_recall(m), "debris": group((DEBRIS_CLASS,)), "floating": group(FLOATING_CLASSES), "confusion": m}


def experiments(learn: DataFrame, held: DataFrame, sets: dict[str, list[str]], models: tuple[str, ...] = ("forest", "two experts"), weights: tuple[str | None, ...] = (None, "weight"), **kw) -> DataFrame:
    """(features, model, weighted, accuracy, macro_f1): each feature set with each model, weighted or not, fitted on learn and scored on held (columns of the
    sets, label, weight). A row per fit."""
    from functools import reduce

    from .evaluate import confusion, precision_recall

    out = []
    for name, columns in sets.items():
        a, b = vectors(learn, columns), vectors(held, columns)
        for model in models:
            for weight in weights:
                scored = trained(a, weight=weight, model=model, **kw).judged(b.withColumnRenamed("label", "truth"))
                m = confusion(scored, "truth", "label")
                right = m.agg((F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
                f1 = precision_recall(m).agg(F.avg("f1").alias("macro_f1"))
                out.append(right.crossJoin(f1).select(F.lit(name).alias("features"), F.lit(model).alias("model"), F.lit(weight is not None).alias("weighted"), "accuracy", "macro_f1"))  # one row each
    return reduce(DataFrame.union, out)
