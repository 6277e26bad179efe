"""Reshaped metric frames behind the dashboard charts and cards."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.fixed import CATEGORY_LABELS, PROVIDER_LABELS, SENTIMENTS
from echolens.functions.numbers import band_color, fixed, lookup, percent, score_band, title_label
from echolens.operators import metrics
from echolens.operators.answers import target_list


def kpi_row(visibility: DataFrame, targets: DataFrame) -> DataFrame:
    """Formatted card values for each wanted (category, brand); brands without mentions say "No data"."""
    wanted = targets.select("category", "brand").distinct()
    card = lambda c, digits, unit="": (F.when(F.col("mentions").isNull(), "No data")
                                       .otherwise(F.concat(fixed(F.col(c), digits), F.lit(unit))))
    return (wanted.join(visibility, ["category", "brand"], "left")
            .select("category", "brand",
                    card("visibility_pct", 1, "%").alias("visibility"),
                    card("avg_position", 1).alias("avg_position"),
                    card("pos_rate", 0, "%").alias("pos_rate"),
                    card("neg_rate", 0, "%").alias("neg_rate")))


def target_brands_of(prompts: DataFrame) -> DataFrame:
    """(category, brand) rows the prompts ask about."""
    return (prompts.select("category", F.explode(target_list(prompts)).alias("brand"))
            .distinct())


def sentiment_shares(visibility: DataFrame) -> DataFrame:
    rest = F.lit(100.0) - F.col("pos_rate") - F.col("neg_rate")
    keys = [c for c in ("category", "brand") if c in visibility.columns]
    return visibility.select(*keys, "pos_rate", F.greatest(F.lit(0.0), rest).alias("neutral_rate"), "neg_rate")


def gap_top(gaps: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest competitors per target (and category)."""
    keys = [c for c in ("category", "target") if c in gaps.columns]
    order = Window.partitionBy(*keys).orderBy(F.desc("appears_when_target_absent"), "brand")
    return (gaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
            .orderBy(*keys, "rank"))


def provider_sentiment_pivot(mentions: DataFrame, brand: str | None = None) -> DataFrame:
    counts = metrics.provider_breakdown(mentions, brand)
    wide = counts.groupBy("brand", "provider").pivot("sentiment", SENTIMENTS).agg(F.sum("count"))
    return (wide.select("brand", "provider", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in SENTIMENTS])
            .orderBy("brand", "provider"))


def citation_mix(counts: DataFrame) -> DataFrame:
    """Share of each domain class within its provider; small shares carry no label."""
    keys = [c for c in ("category", "provider") if c in counts.columns]
    whole = F.sum("count").over(Window.partitionBy(*keys))
    return (counts.withColumn("pct", percent(F.col("count"), whole))
            .withColumn("provider_label", lookup(F.col("provider"), PROVIDER_LABELS, F.col("provider")))
            .withColumn("label", F.when(F.col("pct") >= 5, F.concat(fixed(F.col("pct"), 0), F.lit("%"))).otherwise(""))
            .orderBy(*keys, F.desc("pct"), "domain_type"))


def global_stats(mentions: DataFrame, responses: DataFrame) -> DataFrame:
    """One row of totals; each fact table is read once."""
    said = mentions.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    said = said.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count("brand").alias("brands"))
    asked = responses.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("created_at")).alias("lo"),
                                              F.max(F.to_date("created_at")).alias("hi"))
    asked = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("responses"), F.count("provider").alias("providers"),
                      F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(metrics.MISSING_DATE))
    row = asked.select("responses", "providers", day("lo").alias("d0"), day("hi").alias("d1"),
                       said.select(F.struct("mentions", "brands").alias("said")).scalar().alias("said"))
    return row.select("said.mentions", "responses", "said.brands", "providers", "d0", "d1")


def prompt_coverage(prompts: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Prompts per category with display label and grand total; ``seeds`` stand in for an empty table."""
    rows = prompts.select("category")
    if seeds is not None:
        stored = prompts.agg(F.count(F.lit(1)).alias("n")).scalar()
        rows = rows.unionByName(seeds.select("category").filter(stored == 0))
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return (counts.select("category", title_label(F.col("category"), CATEGORY_LABELS).alias("label"), "n",
                          total.scalar().alias("total_prompts"))
            .orderBy(F.desc("n"), "category"))


def score_bands(scored: DataFrame, score: str = "opportunity_score") -> DataFrame:
    return (scored.withColumn("priority", score_band(F.col(score)))
            .withColumn("color", band_color(F.col(score))))
