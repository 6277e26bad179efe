"""Rule-based opportunity scores of source types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.fixed import ACTIONS, DEFAULT_ACTION, DOMAIN_WEIGHTS, REASON_AUTHORITY, REASON_FALLBACK, REASON_GAP, REASON_GENERAL
from echolens.functions.numbers import fixed, lookup, round_exact, score_band


def weight_grid(brands: DataFrame) -> DataFrame:
    """Every weighted domain type for every row of ``brands(target)``."""
    rows = [F.struct(F.lit(rank).alias("weight_rank"), F.lit(name).alias("domain_type"), F.lit(w).alias("weight"))
            for rank, (name, w) in enumerate(DOMAIN_WEIGHTS.items())]
    return brands.select("target", F.inline(F.array(*rows)))


def action_text(domain_type: Column) -> Column:
    return lookup(domain_type, ACTIONS, DEFAULT_ACTION)


def rule_reason(domain_type: Column, own: Column, rivals: Column, score: Column) -> Column:
    """Why a source type is recommended: a gap to the rivals, its authority, or its general value."""
    return (F.when(rivals > own,
                   F.format_string(REASON_GAP,
                                   fixed(rivals, 1), domain_type, fixed(own, 1)))
            .when(score >= 60, F.concat(domain_type, F.lit(REASON_AUTHORITY)))
            .otherwise(F.concat(domain_type, F.lit(REASON_GENERAL))))


def opportunity_scores(features: DataFrame, targets: DataFrame, competitors: list[str]) -> DataFrame:
    """Score every weighted domain type for each row of ``targets(target)``.

    base 40·weight, plus up to 30 for a gap to the competitors that have data for the type, up to 20 for citation
    volume and up to 10 for an early position; without own data the volume part is 0 and the position
    part 5. If ``features`` is empty all scores fall back to 100·weight with bands at 70 and 40.
    ``features`` is read three times, so pass a stored frame.
    """
    known = features.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = features.select(F.col("brand").alias("target"), "domain_type", F.col("cooccurrence_count").alias("own"),
                          "citation_count", "avg_position_with_source", F.lit(True).alias("present"))
    rivals = (features.filter(F.col("brand").isin(competitors)).groupBy("domain_type")
              .agg(F.avg("cooccurrence_count").alias("rivals")))
    grid = (weight_grid(targets).join(own, ["target", "domain_type"], "left").join(rivals, "domain_type", "left")
            .withColumn("own", F.coalesce("own", F.lit(0)))
            .withColumn("rivals", F.coalesce("rivals", F.lit(0.0)))
            .withColumn("has_data", known > 0))
    present = F.col("present").isNotNull()
    gap_part = F.least(F.lit(30.0), F.greatest(F.lit(0.0), F.col("rivals") - F.col("own")) * 10)
    volume_part = F.when(present, F.least(F.lit(20), F.col("citation_count") * 2)).otherwise(0)
    early = F.greatest(F.lit(0.0), F.lit(10) - F.col("avg_position_with_source") * 2)
    position_part = F.when(present, early).otherwise(5.0)
    rule = round_exact(F.col("weight") * 40 + gap_part + volume_part + position_part, 1)
    scored = grid.withColumn("opportunity_score",
                             F.when(F.col("has_data"), rule).otherwise(F.round(F.col("weight") * 100, 1)))
    score = F.col("opportunity_score")
    return (scored.select(
        "target", "domain_type", "opportunity_score",
        F.when(F.col("has_data"), score_band(score)).otherwise(score_band(score, 70, 40)).alias("priority"),
        F.when(F.col("has_data"), rule_reason(F.col("domain_type"), F.col("own"), F.col("rivals"), score))
        .otherwise(REASON_FALLBACK).alias("reason"),
        action_text(F.col("domain_type")).alias("action"), "weight_rank"))


def fallback_scores(targets: DataFrame) -> DataFrame:
    """Scores without any citation data: the weight alone."""
    score = F.round(F.col("weight") * 100, 1)
    return (weight_grid(targets).withColumn("opportunity_score", score)
            .select("target", "domain_type", "opportunity_score", score_band(F.col("opportunity_score"), 70, 40).alias("priority"),
                    F.lit(REASON_FALLBACK).alias("reason"), action_text(F.col("domain_type")).alias("action"),
                    "weight_rank"))
