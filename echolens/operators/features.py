"""Co-occurrence of cited source types and mentioned brands."""

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolens.fixed import DEFAULT_DOMAIN_WEIGHT, DOMAIN_WEIGHTS
from echolens.functions.numbers import lookup
from echolens.session import stored

#: Citations and mentions meet on the question and the provider, whatever the run.
_MEET = ["prompt_id", "provider"]
#: Sums of one task, so that a task's memory stays the same whatever their number.
TASK_ROWS = 250_000


class KeySums(NamedTuple):
    """Citations and mentions summed per question and provider, those without either included."""
    domains: DataFrame  # prompt_id, provider, domain_type, domain; cites: citations of a known type
    brands: DataFrame   # prompt_id, provider, brand; n: mentions, runs: those with the brand, p and np: sum and count of its positions
    tasks: int = 1      # that the rows of either are dealt to


def key_sums(citations: DataFrame, mentions: DataFrame) -> KeySums:
    """Sums that all features are made from. They are written out, so each fact is derived and read once however many features follow."""
    domains = (citations.filter(F.col("domain_type").isNotNull())
               .groupBy(*_MEET, "domain_type", "domain").agg(F.count(F.lit(1)).alias("cites")))
    per_run = (mentions.groupBy(*_MEET, "brand", "run_id")
               .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("position").cast("long")).alias("p"), F.count("position").alias("np")))
    brands = (per_run.groupBy(*_MEET, "brand")
              .agg(F.sum("n").alias("n"), F.count("run_id").alias("runs"), F.sum("p").alias("p"), F.sum("np").alias("np")))
    domains, brands = stored(domains, "domain-sums"), stored(brands, "brand-sums")
    rows = max(domains.count(), brands.count())  # from the files' footers
    return KeySums(domains, brands, max(domains.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))


def _dealt(rows: DataFrame, sums: KeySums, *keys: str) -> DataFrame:
    """Rows of sums dealt out by some of the keys they are then grouped by. Scans read more rows a task as the sums grow, and grouping
    there first would keep nearly all of them, as few sums share a key."""
    return rows.repartition(sums.tasks, *keys)


def cooccurrence(sums: KeySums) -> DataFrame:
    """Per (domain_type, brand): keys and run slots with both, and mean position over the fan-out.

    The plain join of the facts grows with the square of the runs per prompt. Both sides are summed to
    the join key first; a key then holds one row per source type against one per brand, and the
    fan-out mean is recovered as Σ citations·position_sum / Σ citations·position_count. The products
    are doubles: exact up to 2^53 and free of overflow beyond.
    """
    types = (_dealt(sums.domains.dropna(subset=_MEET), sums, *_MEET)
             .groupBy(*_MEET, "domain_type").agg(F.sum("cites").cast("double").alias("cites")))
    # A task's brands fit a hash table, so neither side is sorted.
    brands = _dealt(sums.brands.dropna(subset=_MEET).select(*_MEET, "brand", "runs", "p", "np"), sums, *_MEET)
    return (types.join(brands.hint("shuffle_hash"), _MEET).groupBy("domain_type", "brand")
            .agg(F.count(F.lit(1)).alias("keys"), F.sum("runs").alias("runs"),
                 F.try_divide(F.sum(F.col("cites") * F.col("p")), F.sum(F.col("cites") * F.col("np")))
                 .alias("avg_position_with_source")))


def shared_domains(sums: KeySums) -> DataFrame:
    """Distinct domains of a type cited wherever the brand is mentioned.

    The pairs of a key are deduplicated on the map side as the join makes them. Collecting a key's brands first would sort them all.
    """
    brands = _dealt(sums.brands.dropna(subset=[*_MEET, "brand"]).select(*_MEET, "brand"), sums, *_MEET)
    domains = sums.domains.dropna(subset=[*_MEET, "domain"]).select(*_MEET, "domain_type", "domain")
    return (domains.join(brands.hint("shuffle_hash"), _MEET)
            .groupBy("domain_type", "brand").agg(F.count_distinct("domain").alias("unique_domains")))


def source_features(citations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per (domain_type, brand) co-occurrence with the type's citation volume; empty if either side is."""
    return source_features_of(key_sums(citations, mentions))


def source_features_of(sums: KeySums) -> DataFrame:
    """As :func:`source_features`, from sums made once for several uses."""
    known = sums.domains
    # Two distinct counts in one pass would copy every row per count.
    volume = (known.groupBy("domain_type", "domain").agg(F.sum("cites").alias("n"))
              .groupBy("domain_type").agg(F.sum("n").alias("citation_count"), F.count("domain").alias("unique_domains")))
    spread = (_dealt(known.select("domain_type", "prompt_id"), sums, "prompt_id").distinct()
              .groupBy("domain_type").agg(F.count("prompt_id").alias("prompts_with_citations")))
    pairs = cooccurrence(sums)
    return (pairs.join(volume, "domain_type", "left").join(spread, "domain_type", "left")
            .select("domain_type", "brand", F.col("keys").alias("cooccurrence_count"), "avg_position_with_source",
                    "citation_count", "unique_domains", "prompts_with_citations"))


def brand_totals(mentions: DataFrame) -> DataFrame:
    return _totals(mentions.groupBy("brand", "prompt_id")
                   .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("position").cast("long")).alias("p"),
                        F.count("position").alias("np")))


def _totals(per_prompt: DataFrame) -> DataFrame:
    return (per_prompt.groupBy("brand")
            .agg(F.sum("n").alias("total_mentions"), F.try_divide(F.sum("p"), F.sum("np")).alias("avg_position"),
                 F.count("prompt_id").alias("prompts_mentioned")))


def brand_features(mentions: DataFrame, targets: list[str]) -> DataFrame:
    """Brand totals against each target's total; a target without mentions gives NULL gaps."""
    totals = brand_totals(mentions)
    # Counting the targets alone is a filtered scan; their totals needn't be taken from all brands' totals.
    own = (mentions.filter(F.col("brand").isin(targets)).groupBy(F.col("brand").alias("target"))
           .agg(F.count(F.lit(1)).alias("target_mentions")))
    return (totals.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
            .join(own, "target", "left")
            .select("target", "brand", "total_mentions", "avg_position", "prompts_mentioned",
                    (F.col("total_mentions") - F.col("target_mentions")).alias("gap_vs_target"))
            .orderBy("target", F.desc("total_mentions"), "brand"))


def training_matrix(citations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Model features, one row per (domain_type, brand); the type mean includes the brand itself."""
    return training_matrix_of(key_sums(citations, mentions))


def training_matrix_of(sums: KeySums) -> DataFrame:
    """As :func:`training_matrix`, from sums made once for several uses."""
    pairs = cooccurrence(sums).select(
        "domain_type", "brand", F.col("runs").alias("cooccurrence"), "avg_position_with_source")
    # A window reads the co-occurrences once; at this point a type has one row per brand.
    mean = F.avg("cooccurrence").over(Window.partitionBy("domain_type"))
    per_prompt = _dealt(sums.brands.select("brand", "prompt_id", "n", "p", "np"), sums, "prompt_id").groupBy("brand", "prompt_id").agg(*[F.sum(c).alias(c) for c in ("n", "p", "np")])
    totals = _totals(per_prompt).select("brand", "total_mentions", F.col("avg_position").alias("brand_avg_position"),
                                           F.col("prompts_mentioned").alias("brand_prompt_count"))
    position = F.col("avg_position_with_source")
    return (pairs.join(shared_domains(sums), ["domain_type", "brand"], "left")
            .withColumn("competitor_avg_cooccurrence", mean).join(totals, "brand", "left")
            .select("domain_type", "brand", "cooccurrence", "avg_position_with_source",
                    F.coalesce("unique_domains", F.lit(0)).alias("unique_domains"),
                    "competitor_avg_cooccurrence", "total_mentions", "brand_avg_position", "brand_prompt_count",
                    (F.col("competitor_avg_cooccurrence") - F.col("cooccurrence")).alias("opportunity_gap"),
                    lookup(F.col("domain_type"), DOMAIN_WEIGHTS, DEFAULT_DOMAIN_WEIGHT).alias("domain_authority_weight"),
                    F.when(position.isNotNull(), 1.0 / F.greatest(position, F.lit(0.1))).alias("position_score")))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    """Size of a training matrix: rows, brands and domain types."""
    return matrix.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("brand").alias("brands"),
                      F.count_distinct("domain_type").alias("domain_types"))
