"""Residual correction: boosted trees learn what is left between estimates and truths, on rows that are then not judged.

Rows are dealt into folds by a hash of their id, so a row is in the same fold in every run. The model
is a ``pyspark.ml`` pipeline, fitted on the folds that are not held out, and can be written and read.
Trees that are split by variance depend on numbers of rows and sums of residuals alone, so rows with
the same features are learned from as one, their mean residual weighted with their number: the many
passes of boosting read as many rows as there are different features, each row of the table is read once.
A corrected estimate is never below zero. All sums go through Spark's tree aggregation; what the driver
holds is the trees and the names.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.storage import checkpointed

FOLDS, HELD_OUT = 5, 0
#: Bins of a feature; the library wants at least as many rows as a feature has names.
MAX_BINS = 32


def with_folds(rows: DataFrame, id_col: str, folds: int = FOLDS) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)).cast("int"))


def learned_groups(rows: DataFrame, numbers: list[str], names: list[str]) -> DataFrame:
    """Rows that are learned from, one for all with the same features: features, residual (their mean), weight (their number)."""
    usable = rows.where(F.col("fold") != HELD_OUT).dropna(subset=["estimate", "truth", *numbers])
    learned = usable.select(*numbers, *names, (F.col("truth") - F.col("estimate")).cast("double").alias("_residual"))
    groups = learned.groupBy(*numbers, *names).agg(F.avg("_residual").alias("_residual"), F.count("*").cast("double").alias("_weight"))
    return checkpointed(groups.sortWithinPartitions(*numbers, *names))  # in the same order in every run


def _indexer(groups: DataFrame, name: str) -> StringIndexerModel:
    """Names by falling number of rows, as StringIndexer orders them."""
    found = groups.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("label")).agg(F.sum("_weight").alias("n"))
    labels = [r["label"] for r in found.orderBy(F.desc("n"), "label").select("label").toLocalIterator()]
    return StringIndexerModel.from_labels(labels, inputCol=name, outputCol=f"{name}_index", handleInvalid="keep")


def fit(rows: DataFrame, numbers: list[str], names: list[str], trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """rows (estimate, truth, fold, features) -> model; held-out rows, rows without truth and rows with a null number are not learned from.

    ``numbers`` are features as they are, ``names`` by index, unknown ones as a value of their own.
    """
    groups = learned_groups(rows, numbers, names)
    indexers = [_indexer(groups, n) for n in names]
    features = VectorAssembler(inputCols=[*numbers, *[f"{n}_index" for n in names]], outputCol="features", handleInvalid="keep")
    prepared = PipelineModel([*indexers, features])
    if 0 < (n := groups.count()) < MAX_BINS:  # the same weights on more rows
        copies = -(-MAX_BINS // n)
        groups = groups.withColumn("_weight", F.col("_weight") / copies).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    boosted = GBTRegressor(featuresCol="features", labelCol="_residual", weightCol="_weight", predictionCol="correction", maxIter=trees, maxDepth=depth, maxBins=MAX_BINS, seed=seed)
    return PipelineModel([*prepared.stages, boosted.fit(prepared.transform(groups))])


def corrected(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with ``corrected``: estimate and correction, at least 0."""
    found = model.transform(rows)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.greatest(F.lit(0.0), F.col("estimate") + F.col("correction")).alias("corrected"))


def errors(judged: DataFrame) -> DataFrame:
    """Held-out rows: n, mae_before, mae_after."""
    held = judged.where((F.col("fold") == HELD_OUT) & F.col("truth").isNotNull())
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("truth")))
    return held.agg(F.count("*").alias("n"), mae("estimate").alias("mae_before"), mae("corrected").alias("mae_after"))
