"""Random-forest forecast of final sales with an interval from its trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from boxline.operators.common import ranked
from boxline.operators.features import CATEGORICAL, NUMERIC
from boxline.operators.quantiles import exact_quantile
from boxline.sources.session import materialise, new_path

MIN_ROWS = 10
LOWER, UPPER = 0.10, 0.90
FALLBACK_SPREAD, FALLBACK_MIN = 0.12, 500.0
_KEY = ("match_id", "date", "sales_window")
_PART_ROWS, _LEAST_PARTS = 50_000, 8


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 180
    min_leaf: int = 3
    max_depth: int = 30  # Spark's largest; leaves are bounded by their least size
    seed: int = 42
    memory_mb: int = 1024


@dataclass(frozen=True)
class Forecaster:
    """A fitted forest, or the median of past finals when data is scarce."""

    model: PipelineModel | None
    leaves: DataFrame | None
    fallback: float


def fit(training: DataFrame, settings: ForestSettings = ForestSettings()) -> Forecaster:
    """Train on feature rows with ``final_sales``.

    The bags follow from the seed, a row's part and its place there. Parts are
    therefore dealt by a hash of the row, as many as there are rows for, and put in order: neither the number
    of cores nor the files that the rows come from changes a forecast.
    """
    spark = training.sparkSession
    # Fitting passes over the rows many times.
    fields = list(dict.fromkeys((*(k for k in _KEY if k in training.columns), *NUMERIC, *CATEGORICAL, "final_sales")))
    training = materialise(training.select(*fields), "training")
    parts = max(_LEAST_PARTS, training.count() // _PART_ROWS)
    training = training.repartition(parts, F.xxhash64(*fields)).sortWithinPartitions(*fields)
    median = exact_quantile(training, "final_sales", 0.5, name="v").first()
    fallback = float(median["v"]) if median and median["v"] is not None else 0.0
    if training.limit(MIN_ROWS).count() < MIN_ROWS:
        return Forecaster(None, None, fallback)

    indexed = [f"{c}_index" for c in CATEGORICAL]
    coded = [f"{c}_code" for c in CATEGORICAL]
    stages = [
        # Unseen values get the last index, which the encoder drops: all zeros.
        StringIndexer(inputCols=list(CATEGORICAL), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True),
        VectorAssembler(inputCols=[*NUMERIC, *coded], outputCol="features"),
        RandomForestRegressor(
            featuresCol="features", labelCol="final_sales", predictionCol="forest", leafCol="leaves",
            numTrees=settings.trees, minInstancesPerNode=settings.min_leaf, maxDepth=settings.max_depth,
            featureSubsetStrategy="all", seed=settings.seed, maxMemoryInMB=settings.memory_mb,
        ),
    ]
    model = Pipeline(stages=stages).fit(training)
    return Forecaster(model, leaf_values(spark, model), fallback)


def leaf_values(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Prediction of each leaf, by tree and leaf number."""
    path = new_path(spark, "forest")
    model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    fields = "nodeData" if "nodeData" in nodes.columns else None
    node = nodes.select("treeID", f"{fields}.*") if fields else nodes
    leaves = node.filter(F.col("leftChild") < 0)
    number = F.row_number().over(Window.partitionBy("treeID").orderBy("id")) - 1
    return leaves.select(F.col("treeID").cast("int").alias("tree"), number.cast("int").alias("leaf"), F.col("prediction").alias("value"))


def predict(forecaster: Forecaster, snapshots: DataFrame) -> DataFrame:
    """Expected, lower and upper final sales per snapshot row."""
    current = F.coalesce(F.col("cumulative_sales"), F.lit(0.0))
    if forecaster.model is None:
        expected = F.greatest(F.lit(forecaster.fallback), current)
        spread = F.greatest(expected * FALLBACK_SPREAD, F.lit(FALLBACK_MIN))
        return snapshots.select(
            "match_id", expected.alias("expected"), F.greatest(current, expected - spread).alias("lower"), (expected + spread).alias("upper")
        )
    scored = forecaster.model.transform(snapshots).select(
        "match_id", "forest", current.alias("current"), F.posexplode(vector_to_array("leaves")).alias("tree", "_leaf")
    )
    votes = scored.withColumn("leaf", F.col("_leaf").cast("int")).join(forecaster.leaves, ["tree", "leaf"])
    # As many votes per match as there are trees.
    per_match = votes.groupBy("match_id", "forest", "current").agg(F.percentile("value", F.array(F.lit(LOWER), F.lit(UPPER))).alias("q"))
    expected = F.greatest("forest", "current")
    return per_match.select(
        "match_id",
        expected.alias("expected"),
        F.greatest(F.col("current"), F.col("q")[0]).alias("lower"),
        F.greatest(expected, F.col("q")[1]).alias("upper"),
    )


def feature_importance(forecaster: Forecaster, sample: DataFrame, limit: int | None = None) -> DataFrame:
    """Model inputs by ``rank`` of their importance."""
    spark = sample.sparkSession
    schema = "feature string, importance double"
    if forecaster.model is None:
        return spark.createDataFrame([], schema + ", rank int")
    meta = forecaster.model.transform(sample.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    weights = forecaster.model.stages[-1].featureImportances.toArray()
    rows = [(names[i].replace("_code_", "_"), float(w)) for i, w in enumerate(weights)]
    return ranked(spark.createDataFrame(rows, schema), F.col("importance").desc(), "feature", limit=limit)
