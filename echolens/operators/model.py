"""Gradient-boosted opportunity model over the training matrix."""

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolens.fixed import REASON_MODEL_GAP, REASON_MODEL_LEAD
from echolens.functions.numbers import fixed, score_band
from echolens.session import ensure_checkpoints
from echolens.operators.scoring import action_text, opportunity_scores

FEATURES = ["cooccurrence", "avg_position_with_source", "unique_domains", "competitor_avg_cooccurrence", "total_mentions",
            "brand_avg_position", "brand_prompt_count", "domain_authority_weight", "position_score", "domain_type_enc"]
TARGET = "opportunity_gap"
#: Partitions the model is fitted on: fixed, since bagging draws rows per partition.
_PARTITIONS = 2


class Trained(NamedTuple):
    model: PipelineModel
    mae: float
    r2: float


def _filled(matrix: DataFrame) -> DataFrame:
    numeric = [c for c in [*FEATURES, TARGET] if c in matrix.columns]
    return matrix.select("domain_type", "brand", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numeric])


def split(matrix: DataFrame, seed: int = 42, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the row's key, the same however the data is partitioned."""
    digest = F.md5(F.concat_ws("|", "domain_type", "brand", F.lit(str(seed))).cast("binary"))
    in_test = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < test_percent
    return matrix.filter(~in_test), matrix.filter(in_test)


def train_model(matrix: DataFrame, trees: int = 200, seed: int = 42) -> Trained:
    """Fit on 80 % of the rows and report MAE and R² on the rest. Raises if there are no rows."""
    ensure_checkpoints(matrix.sparkSession)  # else the lineage of the residuals grows with every tree
    # Rows in a fixed order and partitioning: the same matrix gives the same model, whatever its layout.
    rows, train = _filled(matrix).repartition(_PARTITIONS, "domain_type", "brand").sortWithinPartitions("domain_type", "brand").persist(), None
    try:
        if rows.isEmpty():
            raise ValueError("no co-occurrence data to train on")
        train, test = split(rows, seed)
        train = train.persist()
        stages = [
            StringIndexer(inputCol="domain_type", outputCol="domain_type_enc", stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            GBTRegressor(featuresCol="features", labelCol=TARGET, predictionCol="predicted_opportunity", maxIter=trees,
                         stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
        ]
        model = Pipeline(stages=stages).fit(train)
        scored = model.transform(test)
        score = lambda name: RegressionEvaluator(labelCol=TARGET, predictionCol="predicted_opportunity", metricName=name).evaluate(scored)
        return Trained(model, score("mae"), score("r2"))
    finally:
        rows.unpersist()
        if train is not None:
            train.unpersist()


def model_quality(spark: SparkSession, trained: Trained) -> DataFrame:
    return spark.createDataFrame([(trained.mae, trained.r2)], "mae double, r2 double")


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """The model's features, most important first."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(FEATURES, weights), key=lambda pair: (-pair[1], pair[0]))
    return spark.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(ranked)], "rank int, feature string, importance double")


def save_model(model: PipelineModel, matrix: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    matrix.write.mode("overwrite").parquet(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/features")


def scale_per_brand(predicted: DataFrame) -> DataFrame:
    """Min-max scale predictions to 0–100 within each brand; equal predictions give 50."""
    brand = Window.partitionBy("brand")
    p, low, high = F.col("predicted_opportunity"), F.min("predicted_opportunity").over(brand), F.max("predicted_opportunity").over(brand)
    return predicted.withColumn("opportunity_score", F.when(high > low, F.round((p - low) / (high - low) * 100, 1)).otherwise(50.0))


def predict_opportunities(model: PipelineModel, matrix: DataFrame, brand: str | None = None) -> DataFrame:
    """Scaled score of each domain type for every brand; an unseen domain type is scored as the first known one."""
    labels = list(model.stages[0].labels)
    rows = matrix if brand is None else matrix.filter(F.col("brand") == brand)
    encoded = _filled(rows).withColumnRenamed("domain_type", "shown").withColumn("domain_type", F.when(F.col("shown").isin(labels), F.col("shown")).otherwise(labels[0]))
    predicted = model.transform(encoded).drop("domain_type").withColumnRenamed("shown", "domain_type")
    return (scale_per_brand(predicted)
            .select("brand", "domain_type", "opportunity_score", F.col("cooccurrence").cast("long").alias("cooccurrence"), "competitor_avg_cooccurrence"))


def model_recommendations(predictions: DataFrame, top_n: int = 5) -> DataFrame:
    """The best ``top_n`` domain types per brand with priority, reason and action."""
    order = Window.partitionBy("brand").orderBy(F.desc("opportunity_score"), "domain_type")
    mean, own = F.col("competitor_avg_cooccurrence"), F.col("cooccurrence")
    reason = (F.when(mean > own, F.format_string(REASON_MODEL_GAP, fixed(mean, 1), own))
              .otherwise(F.format_string(REASON_MODEL_LEAD, own, fixed(mean, 1))))
    return (predictions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
            .select(F.col("brand").alias("target"), "rank", "domain_type", "opportunity_score",
                    score_band(F.col("opportunity_score")).alias("priority"), reason.alias("reason"),
                    action_text(F.col("domain_type")).alias("action"), F.lit("gbt").alias("model_used")))


def rule_recommendations(scores: DataFrame, top_n: int = 5) -> DataFrame:
    order = Window.partitionBy("target").orderBy(F.desc("opportunity_score"), "weight_rank")
    return (scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
            .select("target", "rank", "domain_type", "opportunity_score", "priority", "reason", "action",
                    F.lit("rule_based").alias("model_used")))


def recommend(targets: DataFrame, features: DataFrame, competitors: list[str], predictions: DataFrame | None = None,
              top_n: int = 5) -> DataFrame:
    """Recommendations for each ``targets(target)``: by model where it has rows for the brand, else by rules."""
    if predictions is None:
        ranked = rule_recommendations(opportunity_scores(features, targets, competitors), top_n)
    else:
        by_model = model_recommendations(predictions.join(targets.select(F.col("target").alias("brand")), "brand", "left_semi"), top_n)
        unscored = targets.join(predictions.select(F.col("brand").alias("target")).distinct(), "target", "left_anti")
        ranked = by_model.unionByName(rule_recommendations(opportunity_scores(features, unscored, competitors), top_n))
    return ranked.orderBy("target", "rank")
