"""Filters and keys on the answers themselves."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_responses(responses: DataFrame) -> DataFrame:
    """Answers without an error (NULL or empty) and with some text."""
    return responses.filter((F.coalesce("error", F.lit("")) == "") & (F.coalesce("response_text", F.lit("")) != ""))


def target_list(prompts: DataFrame) -> Column:
    """The brand list of a prompt: JSON text as stored (unreadable text gives NULL) or already an array."""
    if dict(prompts.dtypes)["target_brands"] == "string":
        return F.from_json("target_brands", "array<string>")
    return F.col("target_brands")


def base_run(run_id: Column | str = "run_id") -> Column:
    """Run id without its trial suffix."""
    return F.regexp_replace(run_id, r"-t\d+$", "")


def trial_number(run_id: Column | str = "run_id") -> Column:
    """Trial index of a run id; a run without trials counts as trial 0."""
    digits = F.regexp_extract(run_id, r"-t(\d+)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def run_summary(responses: DataFrame) -> DataFrame:
    """Per answer: latency, length in characters and state."""
    failed = F.coalesce("error", F.lit("")) != ""
    return responses.select("run_id", "provider", "prompt_id", "latency_ms",
                            F.coalesce(F.char_length("response_text"), F.lit(0)).alias("chars"),
                            F.when(failed, "ERR").otherwise("OK").alias("status"))
