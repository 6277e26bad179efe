"""Brand mentions in answer texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.functions.text import fold, snippet, term_pattern
from echolens.operators.answers import target_list


def prompt_terms(prompts: DataFrame) -> DataFrame:
    """(prompt_id, terms): the prepared search terms of each prompt, first spelling of a brand wins.

    ``target_brands`` may be an array or JSON text. Patterns are built once per prompt, not per answer.
    """
    brands = F.filter(target_list(prompts), lambda b: b.isNotNull() & (b != ""))
    lowered = F.transform("brands", lambda b: F.lower(b))
    first = F.filter(F.transform("brands", lambda b, i: F.struct(b.alias("brand"), i.alias("idx"))),
                     lambda t: F.array_position(F.col("lowered"), F.lower(t["brand"])) == t["idx"] + 1)
    prepared = F.transform(first, lambda t: F.struct(
        t["brand"].alias("brand"), t["idx"].alias("idx"), F.char_length(t["brand"]).alias("length"),
        fold(t["brand"]).alias("folded"), term_pattern(t["brand"]).alias("pattern")))
    return (prompts.select("prompt_id", brands.alias("brands")).withColumn("lowered", lowered)
            .select("prompt_id", prepared.alias("terms")))


def with_found_brands(responses: DataFrame, prompts: DataFrame, how: str = "left") -> DataFrame:
    """Add ``found``: the brands in an answer as (brand, position, char_offset, snippet) by first appearance.

    Positions count from 1, ties keep list order. Searched are the target brands of the answer's prompt; with a ``left``
    join answers of unknown prompts keep a NULL. A substring search in the folded text drops the brands that can't occur before a
    pattern is run over the whole text, for lists of any length. The folded text is the one element of an array because the planner moves
    a column that is read once into the lambda, where it runs once per brand. The join carries texts only if the prompts
    don't fit a broadcast, which is left to the planner's size check.
    """
    text, terms = F.col("response_text"), F.col("terms")
    likely = F.transform(F.array(fold(text)), lambda folded: F.filter(terms, lambda t: F.contains(folded, t["folded"])))[0]
    parts = F.transform(likely, lambda t: F.struct(t.alias("term"), F.split(text, t["pattern"], 2).alias("parts")))
    hits = F.transform(F.filter(parts, lambda s: F.size(s["parts"]) == 2), lambda s: F.struct(
        F.char_length(s["parts"][0]).alias("char_offset"), s["term"]["idx"].alias("idx"),
        s["term"]["brand"].alias("brand"), s["term"]["length"].alias("length")))
    found = F.transform(F.array_sort(hits), lambda m, i: F.struct(
        m["brand"].alias("brand"), (i + 1).alias("position"), m["char_offset"].alias("char_offset"),
        snippet(text, m["char_offset"], m["length"]).alias("snippet")))
    return (responses.join(prompt_terms(prompts), "prompt_id", how)
            .withColumn("found", found).drop("terms"))


def detect_brands(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row per brand found in an answer; answers of unknown prompts have none.

    An outer generator and a filter after it: from an inner one the planner infers a filter on the array and runs the whole
    detection a second time below the projection.
    """
    keep = [c for c in responses.columns if c not in ("response_text", "prompt_text", "error", "model", "latency_ms")]
    return with_found_brands(responses, prompts, "inner").select(*keep, F.inline_outer("found")).filter(F.col("brand").isNotNull())


def match_target_brands(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """Answer slots with the brand list of their prompt, empty for unknown prompts."""
    lists = prompts.select("prompt_id", target_list(prompts).alias("target_brands"))
    return (responses.select("run_id", "prompt_id", "provider").join(lists, "prompt_id", "left")
            .withColumn("target_brands", F.coalesce("target_brands", F.array().cast("array<string>"))))


def mention_counts(mentions: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most mentioned brands with their positive and negative share."""
    return (mentions.groupBy("brand")
            .agg(F.count(F.lit(1)).alias("mentions"),
                 F.count_if(F.col("sentiment") == "positive").alias("positive"),
                 F.count_if(F.col("sentiment") == "negative").alias("negative"))
            .orderBy(F.desc("mentions"), "brand").limit(n))
