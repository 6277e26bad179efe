"""Visibility metrics over the fact tables, for all brands and categories at once.

Facts are reduced before they meet another table: a category metric first aggregates to
(prompt, brand) grain, so a prompt or brand holding a large part of all rows is folded by the
map-side partial aggregate and no join ever sees it as more than a handful of rows.

Visibility, trends and alerts take mentions either as rows or as their daily sums, see :func:`daily_sums` and ``tables.read_days``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.fixed import PROVIDERS
from echolens.functions.numbers import at_least_one, percent
from echolens.operators.answers import target_list
from echolens.schemas import SLOT

MISSING_DATE = "—"

#: Additive parts of a mention measure; they can be summed again after a join.
_SUMS = ["mentions", "position_sum", "position_count", "positive", "negative"]


def _mention_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("mentions"),
        F.sum(F.col("position").cast("long")).alias("position_sum"),
        F.count("position").alias("position_count"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
    ]


def _resum() -> list[Column]:
    return [F.sum(name).alias(name) for name in _SUMS]


def are_daily(mentions: DataFrame) -> bool:
    return {"day", *_SUMS} <= set(mentions.columns)


def sums_of(mentions: DataFrame) -> list[Column]:
    """The additive parts, from rows or from daily sums."""
    return _resum() if are_daily(mentions) else _mention_sums()


def day_of(mentions: DataFrame) -> Column:
    return F.col("day") if are_daily(mentions) else F.to_date("created_at")


def daily_sums(mentions: DataFrame, *extra: str) -> DataFrame:
    """One row per day, prompt and brand (and ``extra`` columns) with the additive parts; sums may be summed again, so they merge in any order."""
    return mentions.groupBy(*extra, day_of(mentions).alias("day"), "prompt_id", "brand").agg(*sums_of(mentions))


def _measures(slots: Column) -> list[Column]:
    return [
        F.col("mentions"),
        F.try_divide(F.col("position_sum"), F.col("position_count")).alias("avg_position"),
        percent(F.col("positive"), F.col("mentions")).alias("pos_rate"),
        percent(F.col("negative"), F.col("mentions")).alias("neg_rate"),
        percent(F.col("mentions"), at_least_one(slots)).alias("visibility_pct"),
    ]


def only_brands(df: DataFrame, brands: list[str] | None) -> DataFrame:
    return df if brands is None else df.filter(F.col("brand").isin(brands))


def only_category(prompts: DataFrame, category: str | None) -> DataFrame:
    keep = prompts.select("prompt_id", "category")
    return keep if category is None else keep.filter(F.col("category") == category)


#: Slots of voted data: mentions are stored once for all trials of a question, so its runs count once too.
VOTED_SLOT = ["prompt_id", "provider"]


def distinct_slots(responses: DataFrame, slot: list[str] = SLOT) -> DataFrame:
    """Distinct answer slots; a slot with a missing key part doesn't count."""
    return responses.select(*slot).dropna().distinct()


def slots_by_category(responses: DataFrame, prompts: DataFrame, *extra: str, slot: list[str] = SLOT) -> DataFrame:
    per_prompt = distinct_slots(responses, slot).groupBy("prompt_id", *extra).agg(F.count(F.lit(1)).alias("slots"))
    return (per_prompt.join(only_category(prompts, None), "prompt_id")
            .groupBy("category", *extra).agg(F.sum("slots").alias("slots")))


def visibility_summary(mentions: DataFrame, responses: DataFrame,
                       brands: list[str] | None = None, slot: list[str] = SLOT) -> DataFrame:
    """Per brand: mentions, average position, sentiment rates and share of all answer slots."""
    slots = distinct_slots(responses, slot).agg(F.count(F.lit(1)).alias("slots"))
    return (only_brands(mentions, brands or None)
            .groupBy("brand").agg(*sums_of(mentions))
            .select("brand", *_measures(slots.scalar()))
            .orderBy(F.desc("mentions"), "brand"))


def visibility_by_category(mentions: DataFrame, responses: DataFrame, prompts: DataFrame,
                           category: str | None = None, brands: list[str] | None = None,
                           slot: list[str] = SLOT) -> DataFrame:
    """As :func:`visibility_summary`, but both sides only count prompts of the category.

    An empty brand list gives an empty result; ``None`` means no brand filter.
    """
    scope = only_category(prompts, category)
    per_prompt = only_brands(mentions, brands).groupBy("prompt_id", "brand").agg(*sums_of(mentions))
    per_brand = per_prompt.join(scope, "prompt_id").groupBy("category", "brand").agg(*_resum())
    return (per_brand.join(slots_by_category(responses, scope, slot=slot), "category", "left")
            .select("category", "brand", *_measures(F.col("slots")))
            .orderBy("category", F.desc("mentions"), "brand"))


def only_brand(df: DataFrame, brand: str | None) -> DataFrame:
    return df if brand is None else df.filter(F.col("brand") == brand)


def position_trend(mentions: DataFrame, brand: str | None = None) -> DataFrame:
    """Daily average position and mention count."""
    return (only_brand(mentions, brand)
            .groupBy("brand", day_of(mentions).alias("date")).agg(*sums_of(mentions))
            .select("brand", "date", F.try_divide("position_sum", "position_count").alias("avg_position"), F.col("mentions").alias("mention_count"))
            .orderBy("brand", "date"))


def sentiment_trend(mentions: DataFrame, brand: str | None = None, window: int = 7,
                    calendar: bool = False) -> DataFrame:
    """Daily mean of +1/0/−1 and its rolling mean.

    The rolling mean spans the last ``window`` days that have mentions; ``calendar=True`` spans calendar days.
    """
    daily = (only_brand(mentions, brand)
             .groupBy("brand", day_of(mentions).alias("date")).agg(*sums_of(mentions))
             .select("brand", "date", ((F.col("positive") - F.col("negative")) / F.col("mentions")).alias("sentiment_score"), "mentions"))
    if calendar:
        frame = Window.partitionBy("brand").orderBy(F.unix_date("date")).rangeBetween(1 - window, 0)
    else:
        frame = Window.partitionBy("brand").orderBy("date").rowsBetween(1 - window, 0)
    return (daily.withColumn("rolling_sentiment", F.avg("sentiment_score").over(frame))
            .orderBy("brand", "date"))


def competitor_gap(mentions: DataFrame, targets: list[str] | str, prompts: DataFrame | None = None,
                   category: str | None = None) -> DataFrame:
    """Which other brands show up in slots that hold mentions but none of the target.

    What a brand has in slots without the target is its total less what it has in slots with it. Rows are first summed per (slot, brand);
    each sum is then counted once for the total and once for each target that its slot holds, so the work follows
    the slots' contents and one scan serves any number of targets. With ``prompts`` the result is split by category.
    """
    targets = [targets] if isinstance(targets, str) else list(dict.fromkeys(targets))
    keys = ["brand"] if prompts is None else ["category", "brand"]
    # Rows lacking a slot key never join a slot.
    pairs = (mentions.dropna(subset=SLOT).groupBy(*SLOT, "brand")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("position").cast("long")).alias("p"),
                  F.count("position").alias("np")))
    if prompts is not None:
        pairs = pairs.join(only_category(prompts, category), "prompt_id")
    held = F.collect_set(F.when(F.col("brand").isin(targets), F.col("brand"))).over(Window.partitionBy(*SLOT))
    counted = F.explode(F.concat(F.array(F.lit(None).cast("string")), "held"))
    sums = (pairs.withColumn("held", held).select(*keys, "n", "p", "np", counted.alias("target"))
            .groupBy(*keys, "target").agg(*[F.sum(c).alias(c) for c in ("n", "p", "np")]))
    # A row per brand with its total and a map of its parts by target: joined to each other, the two would each scan all mentions.
    parts = F.struct("n", "p", "np")
    inside = F.map_from_entries(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", parts.alias("parts")))))
    total = sums.groupBy(*keys).agg(F.max(F.when(F.col("target").isNull(), parts)).alias("total"), inside.alias("inside"))
    wanted = total.select(*keys, "total", "inside", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    less = lambda c: F.coalesce(F.col("total")[c], F.lit(0)) - F.coalesce(F.try_element_at("inside", F.col("target"))[c], F.lit(0))
    gaps = (wanted.filter(F.col("brand") != F.col("target"))
            .select(*keys, "target", less("n").alias("n"), less("p").alias("p"), less("np").alias("np")).filter(F.col("n") > 0))
    lead = [k for k in keys if k != "brand"]
    return (gaps
            .select(*lead, "target", "brand", F.col("n").alias("appears_when_target_absent"),
                    F.try_divide(F.col("p"), F.col("np")).alias("avg_position"))
            .orderBy(*lead, "target", F.desc("appears_when_target_absent"), "brand"))


def category_stats(mentions: DataFrame, responses: DataFrame, prompts: DataFrame,
                   category: str | None = None) -> DataFrame:
    """Per category: mention rows, answer rows, brands and first/last answer day ("—" when there is none)."""
    scope = only_category(prompts, category)
    brands = (mentions.groupBy("prompt_id", "brand").agg(F.count(F.lit(1)).alias("n"))
              .join(scope, "prompt_id").groupBy("category")
              .agg(F.sum("n").alias("mentions"), F.count_distinct("brand").alias("brands")))
    answers = (responses.groupBy("prompt_id")
               .agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("created_at")).alias("lo"),
                    F.max(F.to_date("created_at")).alias("hi"))
               .join(scope, "prompt_id").groupBy("category")
               .agg(F.sum("n").alias("responses"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_DATE))
    return (scope.select("category").distinct()
            .join(brands, "category", "left").join(answers, "category", "left")
            .select("category", F.coalesce("mentions", F.lit(0)).alias("mentions"),
                    F.coalesce("responses", F.lit(0)).alias("responses"),
                    F.coalesce("brands", F.lit(0)).alias("brands"),
                    day("lo").alias("d0"), day("hi").alias("d1"),
                    F.when(F.col("lo").isNull(), MISSING_DATE)
                    .otherwise(F.concat(F.date_format("lo", "yyyy-MM"), F.lit(" → "), F.date_format("hi", "yyyy-MM")))
                    .alias("date_range"))
            .orderBy("category"))


def list_tracked_brands(mentions: DataFrame) -> DataFrame:
    return mentions.select("brand").distinct().orderBy("brand")


def provider_breakdown(mentions: DataFrame, brand: str | None = None) -> DataFrame:
    """Mentions by provider and sentiment."""
    return (only_brand(mentions, brand).groupBy("brand", "provider", "sentiment")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("brand", "provider", "sentiment"))


def brands_by_category(prompts: DataFrame) -> DataFrame:
    """Sorted union of the target brands per category; prompts whose list isn't valid JSON are skipped."""
    listed = prompts.select("category", F.explode(target_list(prompts)).alias("brand"))
    return (listed.distinct().groupBy("category")
            .agg(F.array_sort(F.collect_list("brand")).alias("brands"))
            .orderBy("category"))


def prompts_by_category(prompts: DataFrame, limit: int = 5, category: str | None = None) -> DataFrame:
    """The first ``limit`` prompt texts per category, by prompt id."""
    scope = prompts if category is None else prompts.filter(F.col("category") == category)
    order = Window.partitionBy("category").orderBy("prompt_id")
    return (scope.select("category", "prompt_id", "prompt_text", F.row_number().over(order).alias("rank"))
            .filter(F.col("rank") <= limit)
            .orderBy("category", "rank"))


def citation_type_breakdown(citations: DataFrame) -> DataFrame:
    """Citations and distinct domains per domain class."""
    return (citations.filter(F.col("domain_type").isNotNull()).groupBy("domain_type")
            .agg(F.count(F.lit(1)).alias("count"), F.count_distinct("domain").alias("unique_domains"))
            .orderBy(F.desc("count"), "domain_type"))


def llm_disagreement(mentions: DataFrame, responses: DataFrame, prompts: DataFrame,
                     category: str | None = None, providers: list[str] = PROVIDERS) -> DataFrame:
    """Visibility per brand with one column per provider, each over that provider's own slots."""
    scope = only_category(prompts, category)
    counts = (mentions.groupBy("prompt_id", "provider", "brand").agg(F.count(F.lit(1)).alias("n"))
              .join(scope, "prompt_id").groupBy("category", "provider", "brand")
              .agg(F.sum("n").alias("mentions")))
    slots = slots_by_category(responses, scope, "provider")
    rates = (counts.join(slots, ["category", "provider"], "left")
             .withColumn("visibility", percent(F.col("mentions"), at_least_one(F.col("slots")))))
    wide = rates.groupBy("category", "brand").pivot("provider", providers).agg(F.first("visibility"))
    filled = wide.select("category", "brand", *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in providers])
    total = sum((F.col(p) for p in providers), F.lit(0.0))
    return filled.orderBy("category", F.desc(total), "brand")


def citation_by_provider(citations: DataFrame, prompts: DataFrame | None = None,
                         category: str | None = None) -> DataFrame:
    """Citations by provider and domain class; with ``prompts`` also split by category."""
    known = citations.filter(F.col("domain_type").isNotNull() & F.col("provider").isNotNull())
    if prompts is None:
        return (known.groupBy("provider", "domain_type").agg(F.count(F.lit(1)).alias("count"))
                .orderBy("provider", F.desc("count"), "domain_type"))
    return (known.groupBy("prompt_id", "provider", "domain_type").agg(F.count(F.lit(1)).alias("n"))
            .join(only_category(prompts, category), "prompt_id")
            .groupBy("category", "provider", "domain_type").agg(F.sum("n").alias("count"))
            .orderBy("category", "provider", F.desc("count"), "domain_type"))
