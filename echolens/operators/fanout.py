"""Vocabulary of the search queries a provider derives from a prompt."""

from collections.abc import Callable, Iterator
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.fixed import KEYWORD_CLASSES, STOP_WORDS
from echolens.functions.numbers import percent
from echolens.functions.text import WORD
from echolens.operators.calls import ask_all

NO_BRANDS = "—"


def collect_fanout(prompts: DataFrame, client: Callable[[], Callable[[str], tuple[list[str], str]]], partitions: int,
                   width: int = 1, limit: float | None = None, retries: int = 0) -> DataFrame:
    """Ask a user client for the search queries of each prompt (id, category, original, target_brands).

    ``client()`` is called once per task and returns a function prompt → (queries, answer). ``width``, ``limit`` and ``retries`` as in
    :func:`calls.ask_all`.
    """
    def ask(batches: Iterator) -> Iterator:
        call = client()
        for batch in batches:
            replies = ask_all(call, zip(batch["original"]), width, limit, retries)
            queries, texts = [list(r.value[0]) if r.value else [] for r in replies], [(r.value[1] if r.value else "") or "" for r in replies]
            yield batch.assign(fanout_queries=queries, n_queries=[len(q) for q in queries], response_text=texts, error=[r.error for r in replies])

    rows = prompts.select("id", "category", "original", "target_brands").repartition(partitions)
    return rows.mapInPandas(ask, "id string, category string, original string, target_brands array<string>, "
                                 "fanout_queries array<string>, n_queries int, response_text string, error string")


def succeeded(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNull())


def fanout_explode(records: DataFrame) -> DataFrame:
    """One row per search query of every successful record."""
    return succeeded(records).select("id", "category", "original", F.explode("fanout_queries").alias("fanout_query"), "target_brands")


def fanout_count_stats(records: DataFrame) -> DataFrame:
    """Distribution of the number of queries per prompt."""
    n = F.col("n_queries")
    quartile = lambda q: F.round(F.percentile(n, F.lit(q)), 2)
    return succeeded(records).agg(
        F.count(n).alias("count"), F.round(F.avg(n), 2).alias("mean"), F.round(F.stddev_samp(n), 2).alias("std"),
        F.min(n).alias("min"), quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"),
        F.max(n).alias("max"))


def fanout_histogram(records: DataFrame, bins: int = 6) -> DataFrame:
    """Prompts per category and equal-width bin of the query count."""
    ok = succeeded(records)
    limits = ok.agg(F.struct(F.min("n_queries").alias("lo"), F.max("n_queries").alias("hi")).alias("limits")).scalar()
    placed = ok.select("category", "n_queries", limits.alias("l"))
    width = F.col("l.hi") - F.col("l.lo")
    bin_no = F.when(width == 0, 1).otherwise(F.least(F.floor((F.col("n_queries") - F.col("l.lo")) * bins / F.nullif(width, F.lit(0))) + 1, F.lit(bins)))
    return placed.groupBy("category", bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("prompts"))


def fanout_by_category(records: DataFrame) -> DataFrame:
    return (succeeded(records).groupBy("category")
            .agg(F.round(F.avg("n_queries"), 1).alias("mean"), F.min("n_queries").alias("min"), F.max("n_queries").alias("max"))
            .orderBy("category"))


def keyword_class(token: Column, year: int | None = None, classes: dict[str, list[str]] = KEYWORD_CLASSES) -> Column:
    """Vocabulary class of a token, first match wins; the running year counts as temporal."""
    chain = None
    for name, words in classes.items():
        listed = [*words, str(year or date.today().year)] if name == "temporal" else words
        chain = F.when(token.isin(listed), name) if chain is None else chain.when(token.isin(listed), name)
    return chain.otherwise("other")


def fanout_tokens(queries: DataFrame, year: int | None = None, classes: dict[str, list[str]] = KEYWORD_CLASSES,
                  stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Lower-cased ASCII words of more than two letters that aren't stop words, with their class."""
    runs = F.regexp_extract_all(F.lower("fanout_query"), F.lit(f"{WORD}+"), F.lit(0))
    token = F.col("token")
    return (queries.select(F.col("category").alias("prompt_category"), F.explode(runs).alias("token"))
            .filter(token.rlike(r"^[a-zA-Z0-9]{3,}\z") & ~token.isin(stop_words))
            .select("token", keyword_class(token, year, classes).alias("category"), "prompt_category"))


def top_words(tokens: DataFrame, n: int = 25) -> DataFrame:
    return (tokens.groupBy(F.col("token").alias("word"), "category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "word").limit(n))


def keyword_share(tokens: DataFrame) -> DataFrame:
    """Share of each vocabulary class among the classified tokens."""
    counts = tokens.filter(F.col("category") != "other").groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("whole"))
    return (counts.select("category", "count", percent(F.col("count"), whole.scalar()).alias("share"))
            .orderBy(F.desc("count"), "category"))


def brand_injection(queries: DataFrame) -> DataFrame:
    """Target brands named in a query (plain substring), and those the prompt didn't name."""
    query, original = F.lower("fanout_query"), F.lower("original")
    named = F.filter("target_brands", lambda b: F.contains(query, F.lower(b)))
    new = F.filter("named", lambda b: ~F.contains(original, F.lower(b)))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NO_BRANDS)
    return (queries.withColumn("named", named).withColumn("new", new)
            .select("id", "category", "original", F.concat(F.substring("original", 1, 70), F.lit("...")).alias("shown"), "fanout_query",
                    F.size("named").alias("n_brands_fanout"), joined("named").alias("brands_in_fanout"),
                    joined("new").alias("new_brands"), (F.size("new") > 0).alias("brand_injected")))


def injection_summary(injections: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    named, new = F.count_if(F.col("n_brands_fanout") > 0), F.count_if("brand_injected")
    return injections.agg(n.alias("total_queries"), named.alias("with_brand"), percent(named, n, 0).alias("with_brand_pct"),
                          new.alias("new_injection"), percent(new, n, 0).alias("new_injection_pct"))


def _has_any(query: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(query, w))


def keyword_presence(queries: DataFrame, classes: dict[str, list[str]] = KEYWORD_CLASSES) -> DataFrame:
    """Share of queries that contain an evaluation or comparison keyword anywhere, even inside a word."""
    low, n = F.lower("fanout_query"), F.count(F.lit(1))
    return queries.agg(
        percent(F.count_if(_has_any(low, classes["evaluation"])), n).alias("evaluation_pct"),
        percent(F.count_if(_has_any(low, classes["comparison"])), n).alias("comparison_pct"))


def fanout_vs_citations(queries: DataFrame, mix: DataFrame, provider: str = "openai",
                        classes: dict[str, list[str]] = KEYWORD_CLASSES) -> DataFrame:
    """Query vocabulary next to the provider's citation shares of review sites and tech media."""
    share = lambda kind: mix.filter((F.col("provider") == provider) & (F.col("domain_type") == kind)).agg(F.max("pct").alias("pct")).scalar()
    return keyword_presence(queries, classes).select(
        "evaluation_pct", "comparison_pct", share("review_site").alias("review_site_pct"), share("tech_media").alias("tech_media_pct"))
