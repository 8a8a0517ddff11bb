"""Models over assembled features: boosted trees, and stacks of forests and boosting under a logistic or a perceptron blend.

Rows are (id, label, features...). Rows without a label are test rows: nothing learns from them, and
they get predictions like all others.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ensemble import stretched
from ..operators.frames import folds, hash_share
from ..sources.store import materialize

# Class weights for labels 0 and 1.
CLASS_WEIGHTS = (1.309028344, 0.472001959)
#: Fits that run side by side; each is a row of small jobs.
ABREAST = 8


def class_weight(label: Column) -> Column:
    return F.when(label == 1, CLASS_WEIGHTS[1]).otherwise(CLASS_WEIGHTS[0])


def _inputs(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("id", "label", "weight", "fold", "stop")]


def _p(df: DataFrame) -> DataFrame:
    return df.select("id", "label", vector_to_array("probability")[1].alias("p"))


def _stopped(losses: list[float], patience: int) -> int | None:
    """The number of rounds of the least loss, if no better one follows within patience rounds."""
    best = 0
    for k, x in enumerate(losses):
        if x < losses[best]:
            best = k
        if k - best >= patience:
            return best + 1
    return None


def fit_boosted(rows: DataFrame, depth: int = 7, rounds: int = 2500, step: float = 0.02, subsample: float = 0.6, seed: int = 4242, patience: int = 25) -> PipelineModel:
    """Boosted trees, as many as until the loss on a tenth of the labelled rows, by hash of id, has not fallen for ``patience`` rounds.

    Spark stops at the first round that is not better, so fits of 50, 100, 200, ... rounds are watched
    from outside: with one seed the first trees of a longer fit are those of a shorter one.
    """
    assembler = VectorAssembler(inputCols=_inputs(rows), outputCol="x")
    known = rows.filter("label IS NOT NULL").withColumn("weight", class_weight(F.col("label"))).withColumn("stop", hash_share("id", seed) < 0.1)
    known = materialize(assembler.transform(known).select("id", "label", "weight", "stop", "x"))
    seen, held = known.filter("NOT stop"), known.filter("stop")
    if held.isEmpty():
        raise ValueError("no row to stop by")
    fit = lambda n: GBTClassifier(maxDepth=depth, maxIter=n, stepSize=step, subsamplingRate=subsample, seed=seed, weightCol="weight", featuresCol="x").fit(seen)
    n = min(2 * patience, rounds)
    while True:
        fitted = fit(n)
        losses = fitted.evaluateEachIteration(held)
        best = _stopped(losses, patience)
        if best or n == rounds:
            break
        n = min(2 * n, rounds)
    best = best or 1 + losses.index(min(losses))
    return PipelineModel([assembler, fitted if best == n else fit(best)])


def boosted(rows: DataFrame, **size) -> DataFrame:
    """(id, label, p) of boosted trees for all rows."""
    return _p(fit_boosted(rows, **size).transform(rows))


def save(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(id, p) of rows (id, features...)."""
    return model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance) of fit_boosted's model, largest first."""
    inputs, fitted = model.stages[0].getInputCols(), model.stages[-1]
    return sorted(zip(inputs, map(float, fitted.featureImportances), strict=True), key=lambda x: (-x[1], x[0]))


def perceptron(inputs: int, layers: tuple[int, ...] = (300, 200, 100), seed: int = 4242) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, *layers, 2], seed=seed, featuresCol="x")


def bases(seed: int = 4242, trees: int = 100, rounds: int = 50, deepest: int = 30) -> dict:
    """The stack's base models. Forests grow as deep as Spark lets them.

    Spark has no extremely randomised trees; in their place stand forests that see all rows, one feature in
    three at a split, and few thresholds of each.
    """
    shared = {"numTrees": trees, "maxDepth": deepest, "seed": seed, "weightCol": "weight", "featuresCol": "x"}
    forest = lambda impurity: RandomForestClassifier(impurity=impurity, **shared)
    extra = lambda impurity: RandomForestClassifier(impurity=impurity, bootstrap=False, featureSubsetStrategy="onethird", maxBins=8, **shared)
    return {
        "gini": forest("gini"),
        "entropy": forest("entropy"),
        "extra_gini": extra("gini"),
        "extra_entropy": extra("entropy"),
        "boosted": GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.05, subsamplingRate=0.5, seed=seed, weightCol="weight", featuresCol="x"),
    }


def stacked(rows: DataFrame, k: int = 10, seed: int = 4242, blend: str = "logistic", layers: tuple[int, ...] = (300, 200, 100), stretch: bool = True, **size) -> DataFrame:
    """(id, label, p): base models predict each fold from the others and test rows by the mean over folds; a blend of them is moved to the range 0 to 1.

    blend: 'logistic' or 'perceptron'. size: of the base models, see bases. Fits run side by side.
    """
    inputs = _inputs(rows)
    known = folds(rows.filter("label IS NOT NULL").withColumnRenamed("label", "is_duplicate"), k).withColumnRenamed("is_duplicate", "label")
    rows = known.unionByName(rows.filter("label IS NULL").withColumn("fold", F.lit(-1))).withColumn("weight", class_weight(F.col("label")))
    rows = materialize(VectorAssembler(inputCols=inputs, outputCol="raw").transform(rows).select("id", "label", "weight", "fold", "raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True)

    def fold(name: str, base, f: int) -> DataFrame:
        learned = Pipeline(stages=[scaler, base]).fit(rows.filter((F.col("fold") != f) & (F.col("fold") >= 0)))
        return _p(learned.transform(rows.filter(F.col("fold").isin(f, -1)))).select("id", F.lit(name).alias("base"), "p")

    with ThreadPoolExecutor(ABREAST) as pool:
        jobs = [pool.submit(fold, name, base, f) for name, base in bases(seed, **size).items() for f in range(k)]
        parts = [j.result() for j in jobs]
    names = list(bases())
    level = reduce(DataFrame.unionByName, parts).groupBy("id").pivot("base", names).agg(F.avg("p"))
    level = materialize(VectorAssembler(inputCols=names, outputCol="x").transform(rows.select("id", "label", "weight").join(level, "id")))
    top = LogisticRegression(featuresCol="x", weightCol="weight") if blend == "logistic" else perceptron(len(names), layers, seed)
    out = _p(top.fit(level.filter("label IS NOT NULL")).transform(level))
    if not stretch:
        return out
    out = materialize(out)
    return out.drop("p").join(stretched(out.select("id", "p")), "id")
