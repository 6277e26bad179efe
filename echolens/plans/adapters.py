"""The product tables derived from the driver's star schema and documents."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions.numbers import lookup
from echolens.functions.text import classify_domain
from echolens.session import stored

#: Terms of the documents' invented prose that stand in for brand names.
TERMS = ["from", "than", "of the", "of", "tion", "de la"]

_STAR_DOMAINS = ["reddit.com", "stackoverflow.com", "g2.com", "techcrunch.com", "forbes.com", "medium.com", "youtube.com",
                 "en.wikipedia.org", "linkedin.com", "x.com", "asana.com", "docs.some.site.xyz", "capterra.com", "dev.to"]
_TEXT_URLS = {
    0: " See (https://www.g2.com/p/1), and HTTPS://Reddit.com/r/x.",
    1: " Sources: https://wired.com/a; https://www.wikipedia.org/b",
    2: " https://x.com:8080/t https://x.com:8080/t",
    3: " [docs](https://docs.some.site.xyz/z),",
    4: " http://asana.com",
}


_prepared: dict[tuple[str, str, str], DataFrame] = {}


def _adapter(build):
    """Use the prepared table of this data set if :func:`prepare` has written one, else derive it in the plan."""
    def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = _prepared.get((spark.sparkContext.applicationId, sf_dir, build.__name__))
        return build(spark, sf_dir) if known is None else known
    derived.__name__, derived.__doc__ = build.__name__, build.__doc__
    _ADAPTERS.append(derived)
    return derived


_ADAPTERS: list = []


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Write all derived tables once, as a user's stored tables would be."""
    for build in _ADAPTERS:
        # The raw files may be single-block; a stored table has a file per writer.
        rows = build(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
        _prepared[spark.sparkContext.applicationId, sf_dir, build.__name__] = stored(rows, build.__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Line items of one task, so that a task's memory stays the same whatever the size of the tables.
TASK_ROWS = 250_000


def _tasks(lines: DataFrame) -> int:
    """Tasks for facts of these line items; their number comes from the files' footers."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, math.ceil(lines.count() / TASK_ROWS))


def _provider(number: Column) -> Column:
    return lookup(number % 3, {0: "openai", 1: "anthropic"}, "gemini")


def _order_slot() -> list[Column]:
    key = F.col("o_orderkey")
    return [F.concat(F.lit("r"), (key % 50).cast("string")).alias("run_id"), _prompt(), _provider(key).alias("provider")]


def _prompt() -> Column:
    return F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("prompt_id")


def _slot_numbers() -> list[Column]:
    """The slot of an order with numbers for its run and provider, which are shorter to deal out and to group by."""
    return [(F.col("o_orderkey") % 50).alias("run_no"), _prompt(), lookup(F.col("o_orderkey") % 3, {0: 0, 1: 1}, 2).alias("provider_no")]


def _named_slot() -> list[Column]:
    return [F.concat(F.lit("r"), F.col("run_no").cast("string")).alias("run_id"), F.col("prompt_id"), _provider(F.col("provider_no")).alias("provider")]


@_adapter
def star_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("c_custkey") % 5 * 5
    brand = lambda i: F.concat(F.lit("Brand#"), (first + i).cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("prompt_id"),
        F.concat(F.lit("Best tool for "), "c_name", F.lit("?")).alias("prompt_text"),
        F.lower("c_mktsegment").alias("category"),
        F.to_json(F.array(brand(1), brand(2), brand(3))).alias("target_brands"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).cast("timestamp").alias("created_at"))


@_adapter
def star_answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer row per order; several orders can share a slot."""
    return table(spark, sf_dir, "orders").select(
        *_order_slot(), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_totalprice").cast("int").alias("latency_ms"),
        F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"), F.col("o_orderpriority").alias("response_text"), "o_orderkey")


@_adapter
def star_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (star_answer_rows(spark, sf_dir).groupBy("run_id", "prompt_id", "provider")
            .agg(F.min("created_at").alias("created_at"), F.max("latency_ms").alias("latency_ms"),
                 F.when(F.max(F.col("error").isNotNull()), "timeout").alias("error")))  # the only error; the largest text would have all rows sorted


def _ordered_lines(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, int]:
    """Line items with their order, and the number of tasks they are dealt to."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = _tasks(lines)
    # Both sides of this join grow with the data, so it is a shuffle join at any scale that matters.
    orders = orders.select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_orderkey").hint("merge")
    lines = lines.select("l_orderkey", *columns).repartition(tasks, "l_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), tasks


@_adapter
def star_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # The least flag as the least number of the same order: numbers are kept in hash tables, texts would have all rows sorted.
    flag = F.col("l_returnflag")
    flag = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "R", 2).when(flag == "R", 3).when(flag.isNotNull(), 4)
    lines, tasks = _ordered_lines(spark, sf_dir, "l_partkey", "l_linenumber", "l_returnflag")
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(*_slot_numbers(), F.col("p_brand").alias("brand"), "l_linenumber", flag.alias("flag"), "o_orderdate").repartition(tasks, "prompt_id")
            .groupBy("run_no", "prompt_id", "provider_no", "brand")
            .agg(F.min("l_linenumber").alias("position"), F.min("flag").alias("flag"), F.min("o_orderdate").alias("day"))
            .select(*_named_slot(), "brand", "position", lookup(F.col("flag"), {1: "positive", 3: "negative"}, "neutral").alias("sentiment"),
                    F.col("day").cast("timestamp").alias("created_at")))


@_adapter
def star_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, tasks = _ordered_lines(spark, sf_dir, "l_partkey", "l_suppkey")
    number = F.col("l_suppkey") % 14
    # Without a domain there is no URL, whatever the part.
    number, part = F.when(number >= 0, number), F.when(number >= 0, F.col("l_partkey"))
    domain = lookup(F.col("domain_no"), dict(enumerate(_STAR_DOMAINS)))
    # Types are those of the known domains: a filter on the type would else run the patterns on every line item.
    kind = lookup(F.col("domain_no"), {i: classify_domain(F.lit(d)) for i, d in enumerate(_STAR_DOMAINS)})
    return (lines.select(*_slot_numbers(), part.alias("part"), number.alias("domain_no"), "o_orderdate").repartition(tasks, "prompt_id")
            .groupBy("run_no", "prompt_id", "provider_no", "part", "domain_no").agg(F.min("o_orderdate").alias("day"))
            .select(*_named_slot(), F.concat(F.lit("https://"), domain, F.lit("/"), F.col("part").cast("string")).alias("url"),
                    domain.alias("domain"), F.col("day").cast("timestamp").alias("created_at"), kind.alias("domain_type")))


@_adapter
def text_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: three trials per prompt, URLs appended, every 17th one failed."""
    doc = F.col("doc_id")
    prompt = F.floor(doc / 3)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("base-t"), (doc % 3).cast("string")).alias("run_id"),
        F.concat(F.lit("d"), prompt.cast("string")).alias("prompt_id"), F.lit("").alias("prompt_text"),
        _provider(prompt).alias("provider"), F.lit("corpus").alias("model"),
        F.concat("text", lookup(doc % 6, _TEXT_URLS, "")).alias("response_text"), F.lit(100).alias("latency_ms"),
        F.when(doc % 17 == 0, "timeout").alias("error"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 90).cast("int")).cast("timestamp").alias("created_at"))


@_adapter
def text_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = F.to_json(F.array(*[F.lit(t) for t in TERMS]))
    return (table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 3).cast("string")).alias("prompt_id"))
            .agg(F.min("lang").alias("category"))
            .select("prompt_id", F.concat(F.lit("Prompt "), "prompt_id").alias("prompt_text"), "category", brands.alias("target_brands"),
                    F.lit("2024-01-01").cast("timestamp").alias("created_at")))


@_adapter
def fanout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fan-out records: the first line is the prompt, the other lines are its queries."""
    lines = F.split("text", "\n", -1)
    return (table(spark, sf_dir, "documents").select("doc_id", "lang", lines.alias("lines"))
            .select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.col("lines")[0].alias("original"),
                    F.array(*[F.lit(t) for t in TERMS]).alias("target_brands"),
                    F.slice("lines", F.lit(2), F.size("lines")).alias("fanout_queries"),
                    (F.size("lines") - 1).alias("n_queries"), F.when(F.col("doc_id") % 17 == 0, "timeout").alias("error")))
