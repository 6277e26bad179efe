"""One query per operator, over tables derived from the driver's data."""

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolens.fixed import PROVIDERS
from echolens.operators import (alerts, analysis, answers, boards, citations, entities, fanout, features, mentions, metrics,
                                model, requests, scoring, sentiment, voting)
from echolens.plans import adapters as a
from echolens.plans import batch
from echolens.schemas import SLOT, TABLES
from echolens.session import scratch, stored
from echolens.sources import raw_runs, tables
from echolens.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

BRANDS = [f"Brand#{i}" for i in range(1, 26)]
COMPETITORS = ["Brand#2", "Brand#7", "Brand#12", "Brand#17", "Brand#22"]
# Words of the corpus that stand in for vocabulary classes and sentiment words.
CORPUS_CLASSES = {"comparison": ["than", "que", "as"], "evaluation": ["tion", "les"], "temporal": ["2024", "2025"],
                  "commercial": ["and", "des"]}
CORPUS_STOP_WORDS = ["the", "of", "la", "de", "le"]
CORPUS_POSITIVE, CORPUS_NEGATIVE = ["the", "est", "les"], ["of", "and", "de"]
YEAR = 2026
#: Answers of one raw run file, so that a task's share stays the same whatever the size of the tables.
FILE_ROWS = 50_000

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _targets(prompts: DataFrame) -> DataFrame:
    return boards.target_brands_of(prompts)


# --- sources, sinks, table maintenance -------------------------------------------------------------------------

@query
def read_raw_runs(spark, sf):
    path = scratch(spark, "runs")
    raw_runs.write_raw_run(a.text_responses(spark, sf), f"{path}/run_base")
    rows = raw_runs.read_raw_runs(spark, path, layout="lines")
    return rows.select("run_id", "prompt_id", "provider", "response_text", "latency_ms", "error", F.to_date("created_at").alias("day"))


@query
def latest_run(spark, sf):
    path, rows = scratch(spark, "runs"), a.text_responses(spark, sf)
    for trial in range(3):
        run = f"base-t{trial}"
        raw_runs.write_raw_run(rows.filter(F.col("run_id") == run), f"{path}/run_{run}")
    return raw_runs.latest_run(spark, path, layout="lines", unit="folder").select("run_id", "prompt_id", "provider")


@query
def valid_responses(spark, sf):
    return answers.valid_responses(a.text_responses(spark, sf)).select("run_id", "prompt_id", "provider")


@query
def save_responses(spark, sf):
    root, rows = scratch(spark, "tables"), a.star_answer_rows(spark, sf)
    tables.create_tables(spark, root)
    early = F.col("created_at") < "1996-01-01"
    for load in (rows.filter(early), rows.filter(~early)):
        tables.save_responses(load, root, order=["created_at", "latency_ms", "response_text"])
    return tables.read_table(spark, root, "llm_responses").select(*SLOT, "latency_ms", "response_text", "created_at")


@query
def compact_responses(spark, sf):
    """Early and late answers, then the early ones again, which are folded in, then the late ones again, which stay changes that the read puts on top."""
    root, rows = scratch(spark, "tables"), a.star_answer_rows(spark, sf)
    tables.create_tables(spark, root)
    early = F.col("created_at") < "1996-01-01"
    for step, load in enumerate((rows.filter(early), rows.filter(~early)) * 2):
        tables.save_responses(load, root, order=["created_at", "latency_ms", "response_text"])
        if step == 2:
            tables.compact_responses(spark, root, share=0)
    return tables.read_table(spark, root, "llm_responses").select(*SLOT, "latency_ms", "response_text", "created_at")


@query
def save_mentions(spark, sf):
    root, rows = scratch(spark, "tables"), a.star_mentions(spark, sf)
    tables.create_tables(spark, root)
    tables.save_mentions(rows, root)
    tables.save_mentions(rows.filter(F.lit(False)), root)
    return tables.read_table(spark, root, "brand_mentions").select(*SLOT, "brand", "position", "sentiment", "created_at")


def _days(spark, sf) -> DataFrame:
    """Stored daily sums after a load per provider out of order, one of which first held other rows and one of which is taken out and loaded again."""
    # Stored: three loads and the search for their names read them.
    root, rows = scratch(spark, "tables"), stored(a.star_mentions(spark, sf), "mentions")
    tables.create_tables(spark, root)
    tables.save_mentions(rows.withColumn("brand", F.lit("replaced")), root, load="gemini")
    tables.save_mentions(rows, root, load=F.coalesce("provider", F.lit("none")))
    again = rows.filter(F.col("provider") == "openai")
    tables.clear_loads(spark, root, "brand_mentions", ["openai"])
    tables.save_mentions(again, root, load="openai")
    return tables.read_days(spark, root)


@query
def stored_daily_sums(spark, sf):
    return _days(spark, sf)


@query
def position_trend_from_sums(spark, sf):
    return metrics.position_trend(_days(spark, sf))


@query
def visibility_alerts_from_sums(spark, sf):
    _, responses, prompts = _star(spark, sf)
    return alerts.visibility_alerts(_days(spark, sf), responses, prompts, threshold=75.5).drop("mentions")


@query
def save_citations(spark, sf):
    root = scratch(spark, "tables")
    tables.create_tables(spark, root)
    # The second run of a load replaces the first.
    for _ in range(2):
        tables.save_citations(a.star_citations(spark, sf), root, load="star")
    return tables.read_table(spark, root, "citation_sources").select(*SLOT, "url", "domain", "domain_type")


@query
def unseen_runs(spark, sf):
    new = a.text_responses(spark, sf)
    # Stored: whatever the failed answers' runs are called without the trial, under another prefix.
    stored = a.star_responses(spark, sf).select(F.regexp_replace("run_id", "^r", "base-t").alias("run_id"))
    stored = stored.filter(F.col("run_id") != "base-t1")
    return tables.unseen_runs(new, stored).select("run_id", "prompt_id", "provider")


@query
def upsert_prompts(spark, sf):
    root, rows = scratch(spark, "tables"), a.star_prompts(spark, sf)
    tables.create_tables(spark, root)
    tables.upsert_prompts(rows, root, at=F.lit("2024-02-01"))
    changed = rows.filter(F.col("category") == "building").withColumn("prompt_text", F.upper("prompt_text"))
    tables.upsert_prompts(changed, root, at=F.lit("2024-03-01"))
    return tables.read_table(spark, root, "prompts")


@query
def seed_prompts(spark, sf):
    root, rows = scratch(spark, "tables"), a.star_prompts(spark, sf)
    tables.create_tables(spark, root)
    tables.upsert_prompts(rows.filter(F.col("category") == "building"), root, at=F.lit("2024-02-01"))
    added = tables.seed_prompts(rows.withColumn("prompt_text", F.upper("prompt_text")), root, at=F.lit("2024-03-01"))
    return tables.read_table(spark, root, "prompts").withColumn("seeded", F.lit(added))


@query
def list_prompts(spark, sf):
    return tables.list_prompts(a.star_prompts(spark, sf)).select("prompt_id", "prompt_text", "category", F.array_join("target_brands", "|").alias("target_brands"), "created_at")


@query
def get_prompt(spark, sf):
    newest = a.star_prompts(spark, sf).agg(F.max("prompt_id")).scalar()
    return tables.decode_prompts(a.star_prompts(spark, sf).filter(F.col("prompt_id") == newest)).select("prompt_id", "prompt_text", "category", F.array_join("target_brands", "|").alias("target_brands"))


@query
def create_prompt(spark, sf):
    """Prompts refused because their id exists, next to the size of the table after the rest was added."""
    root, rows = scratch(spark, "tables"), a.star_prompts(spark, sf)
    tables.create_tables(spark, root)
    tables.upsert_prompts(rows.filter(F.col("category") == "building"), root, at=F.lit("2024-02-01"))
    refused = tables.create_prompts(rows, root, at=F.lit("2024-03-01"))
    size = tables.read_table(spark, root, "prompts").agg(F.count(F.lit(1))).scalar()
    return refused.select("prompt_id", "category", size.alias("stored"))


@query
def delete_prompt(spark, sf):
    root, rows = scratch(spark, "tables"), a.star_prompts(spark, sf)
    tables.create_tables(spark, root)
    tables.upsert_prompts(rows, root, at=F.lit("2024-02-01"))
    gone = tables.delete_prompts(rows.filter(F.col("category") == "machinery").select("prompt_id"), root)
    return tables.read_table(spark, root, "prompts").select("prompt_id", "category", F.lit(gone).cast("long").alias("deleted"))


@query
def table_schemas(spark, sf):
    """Rows per table after the four declared tables were created and loaded."""
    root = scratch(spark, "tables")
    tables.create_tables(spark, root)
    tables.save_responses(a.star_responses(spark, sf), root, mode="append")
    tables.save_mentions(a.star_mentions(spark, sf), root)
    tables.save_citations(a.star_citations(spark, sf), root)
    tables.upsert_prompts(a.star_prompts(spark, sf), root)
    counts = [tables.read_table(spark, root, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"), F.count_distinct("prompt_id").alias("prompts"))
              for name in TABLES]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query
def request_plan(spark, sf):
    return requests.request_plan(a.star_prompts(spark, sf), "base", n_runs=3)


@query
def collect_responses(spark, sf):
    """Answers, characters and errors by provider, from the requests of ``collect_with_client``."""
    return collect_with_client(spark, sf).groupBy("provider").agg(
        F.count("model").alias("answers"), F.sum(F.char_length("response_text").cast("long")).alias("chars"), F.count("error").alias("errors"))


@query
def collect_with_client(spark, sf):
    """Requests answered by a client function on the executors; some of them fail."""
    def client():
        def call(provider, prompt):
            if prompt.endswith("7?"):
                raise TimeoutError("timeout")
            return f"echo-{provider}", f"{provider} says: {prompt}"
        return call

    plan = requests.request_plan(a.star_prompts(spark, sf), "base", n_runs=3)
    answered = requests.collect_responses(plan, client, spark.sparkContext.defaultParallelism)
    return answered.select("run_id", "prompt_id", "provider", "model", "response_text", "error")


@query
def run_batch(spark, sf):
    """The whole batch job with the documents as answers, three trials and a vote.

    In the first call the third trial fails throughout and is asked again by the second; the third call finds nothing to do.
    """
    root = scratch(spark, "tables")
    tables.create_tables(spark, root)
    tables.upsert_prompts(a.text_prompts(spark, sf), root, at=F.lit("2024-02-01"))
    texts = a.text_responses(spark, sf).select(*SLOT, "response_text", "error")

    def answer(fails):
        def from_documents(plan):
            error = F.when(F.col("run_id").isin(fails), "timeout").otherwise(F.when(F.col("response_text").isNull(), "no such document").otherwise(F.col("error")))
            return plan.join(texts, SLOT, "left").withColumn("error", error).withColumns({"model": F.lit("corpus"), "latency_ms": F.lit(100)})
        return from_documents

    for fails in (["base-t2"], [], []):
        batch.run_batch(spark, root, "base", answer(fails), n_runs=3, judge=_corpus_judge)
    return tables.read_table(spark, root, "brand_mentions").select(*SLOT, "brand", "position", "sentiment")


@query
def run_summary(spark, sf):
    return answers.run_summary(a.text_responses(spark, sf))


# --- text operators --------------------------------------------------------------------------------------------

def _valid_text(spark, sf):
    return answers.valid_responses(a.text_responses(spark, sf))


@query
def detect_brands(spark, sf):
    return (mentions.detect_brands(_valid_text(spark, sf), a.text_prompts(spark, sf))
            .select("run_id", "prompt_id", "provider", "brand", "position", "char_offset", "snippet"))


@query
def match_target_brands(spark, sf):
    # The star answers' prompts are unknown to the documents' prompt table.
    both = _valid_text(spark, sf).select(*SLOT).unionByName(a.star_responses(spark, sf).select(*SLOT))
    return (mentions.match_target_brands(both, a.text_prompts(spark, sf))
            .select(*SLOT, F.size("target_brands").alias("n_brands"), F.array_join("target_brands", "|").alias("target_brands")))


@query
def extract_citations(spark, sf):
    return (citations.extract_citations(_valid_text(spark, sf))
            .select("run_id", "prompt_id", "provider", F.col("url_index").cast("long").alias("url_index"), "url", "domain", "domain_type"))


@query
def classify_domain(spark, sf):
    from echolens.functions.text import url_domain
    pages = a.table(spark, sf, "pages").select("page_id", url_domain(F.col("url")).alias("domain"))
    return citations.classify_domains(pages).unionByName(
        a.star_citations(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("page_id"))
        .select("page_id", "domain").transform(citations.classify_domains))


@query
def discover_entities(spark, sf):
    return entities.discover_entities(_valid_text(spark, sf), entities.target_brand_names(a.text_prompts(spark, sf)))


@query
def judge_sentiment(spark, sf):
    found = mentions.detect_brands(_valid_text(spark, sf), a.text_prompts(spark, sf))
    judged = sentiment.judge_mentions(found, lambda s: sentiment.lexicon_sentiment(s, CORPUS_POSITIVE, CORPUS_NEGATIVE))
    return judged.select(*SLOT, "brand", "sentiment")


def _length_client():
    def call(brand, snippet):
        if len(snippet) % 5 == 0:
            raise ValueError("unreachable")
        label = ("positive", "neutral", "negative")[len(snippet) % 3]
        return '{"sentiment": "%s", "reason": "%s"}' % (label, brand)
    return call


@query
def judge_with_client(spark, sf):
    """Snippets judged by a client function on the executors; some calls fail."""
    found = mentions.detect_brands(_valid_text(spark, sf), a.text_prompts(spark, sf)).select(*SLOT, "brand", "snippet")
    return sentiment.judge_with_client(found, _length_client).select(*SLOT, "brand", "sentiment", "reason")


@query
def parse_judgement(spark, sf):
    labels = a.table(spark, sf, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    reply = (F.when((quality == 1) & (toxic == 1), '{"sentiment": "great", "reason": "odd class"}')
             .when(quality == 1, F.concat(F.lit('{"sentiment": "positive", "reason": "doc '), F.col("doc_id").cast("string"), F.lit('"}')))
             .when(toxic == 1, '{"sentiment": "negative"}')
             .when(F.col("doc_id") % 3 == 0, '{"reason": "no class"}')
             .when(F.col("doc_id") % 3 == 1, "no json").otherwise(""))
    return labels.select("doc_id", sentiment.parse_judgement(reply).alias("v")).select("doc_id", "v.sentiment", "v.reason")


@query
def majority_vote(spark, sf):
    return (voting.majority_vote(a.text_responses(spark, sf), a.text_prompts(spark, sf), n_runs=3)
            .select("run_id", "prompt_id", "provider", "brand", "position", "char_offset", "snippet", F.round("appearance_rate", 6).alias("appearance_rate")))


def _corpus_judge(snippet):
    return sentiment.lexicon_sentiment(snippet, CORPUS_POSITIVE, CORPUS_NEGATIVE)


@query
def analyze_responses(spark, sf):
    found = analysis.analyze_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf), judge=_corpus_judge)
    return found.mentions.select(*SLOT, "brand", "position", "sentiment", F.to_date("created_at").alias("day"))


@query
def analyze_voted_responses(spark, sf):
    found = analysis.analyze_voted_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf), 3, judge=_corpus_judge)
    return found.mentions.select(*SLOT, "brand", "position", "sentiment")


@query
def analyze_responses_citations(spark, sf):
    found = analysis.analyze_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf))
    return found.citations.select(*SLOT, "url", "domain", "domain_type")


@query
def analyze_responses_names(spark, sf):
    return analysis.analyze_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf)).discovered


@query
def analyze_responses_by_client(spark, sf):
    """Mentions judged by a client function inside the analysis."""
    found = analysis.analyze_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf),
                                       judge_rows=lambda rows: sentiment.judge_with_client(rows, _length_client))
    return found.mentions.select(*SLOT, "brand", "position", "sentiment")


@query
def analyze_voted_names(spark, sf):
    return analysis.analyze_voted_responses(a.text_responses(spark, sf), a.text_prompts(spark, sf), 3).discovered


@query
def vote_representatives(spark, sf):
    return voting.representatives(a.text_responses(spark, sf)).select("base_run", "prompt_id", "provider", "valid_trials", "run_id")


@query
def voted_citations(spark, sf):
    return analysis.voted_citations(a.text_responses(spark, sf))


@query
def mention_counts(spark, sf):
    return mentions.mention_counts(a.star_mentions(spark, sf))


# --- metrics ---------------------------------------------------------------------------------------------------

@query
def visibility_summary(spark, sf):
    return metrics.visibility_summary(a.star_mentions(spark, sf), a.star_responses(spark, sf))


@query
def visibility_summary_brands(spark, sf):
    return metrics.visibility_summary(a.star_mentions(spark, sf), a.star_responses(spark, sf), COMPETITORS)


@query
def position_trend(spark, sf):
    return metrics.position_trend(a.star_mentions(spark, sf))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round means of means, whose last digits depend on the order of addition."""
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


@query
def sentiment_trend(spark, sf):
    return _rounded(metrics.sentiment_trend(a.star_mentions(spark, sf)), "sentiment_score", "rolling_sentiment")


@query
def sentiment_trend_calendar(spark, sf):
    return _rounded(metrics.sentiment_trend(a.star_mentions(spark, sf), calendar=True), "sentiment_score", "rolling_sentiment")


@query
def competitor_gap(spark, sf):
    return metrics.competitor_gap(a.star_mentions(spark, sf), BRANDS)


@query
def competitor_gap_by_category(spark, sf):
    return metrics.competitor_gap(a.star_mentions(spark, sf), BRANDS, a.star_prompts(spark, sf))


@query
def visibility_by_category(spark, sf):
    return metrics.visibility_by_category(a.star_mentions(spark, sf), a.star_responses(spark, sf), a.star_prompts(spark, sf))


@query
def category_stats(spark, sf):
    return metrics.category_stats(a.star_mentions(spark, sf), a.star_responses(spark, sf), a.star_prompts(spark, sf))


@query
def list_tracked_brands(spark, sf):
    return metrics.list_tracked_brands(a.star_mentions(spark, sf))


@query
def provider_breakdown(spark, sf):
    return metrics.provider_breakdown(a.star_mentions(spark, sf))


@query
def brands_by_category(spark, sf):
    rows = a.star_prompts(spark, sf)
    # Prompts with an unreadable brand list are skipped.
    broken = rows.withColumn("target_brands", F.when(F.col("prompt_text").endswith("7?"), "[oops").otherwise(F.col("target_brands")))
    return metrics.brands_by_category(broken).select("category", F.array_join("brands", "|").alias("brands"))


@query
def prompts_by_category(spark, sf):
    return metrics.prompts_by_category(a.star_prompts(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query
def citation_type_breakdown(spark, sf):
    return metrics.citation_type_breakdown(a.star_citations(spark, sf))


@query
def llm_disagreement(spark, sf):
    return metrics.llm_disagreement(a.star_mentions(spark, sf), a.star_responses(spark, sf), a.star_prompts(spark, sf))


@query
def citation_by_provider(spark, sf):
    return metrics.citation_by_provider(a.star_citations(spark, sf))


@query
def citation_by_provider_and_category(spark, sf):
    return metrics.citation_by_provider(a.star_citations(spark, sf), a.star_prompts(spark, sf))


# --- dashboard frames ------------------------------------------------------------------------------------------

@query
def kpi_row(spark, sf):
    prompts = a.star_prompts(spark, sf)
    visible = metrics.visibility_by_category(a.star_mentions(spark, sf), a.star_responses(spark, sf), prompts)
    unknown = prompts.select("category", F.lit("Nobody").alias("brand"))
    return boards.kpi_row(visible, _targets(prompts).unionByName(unknown))


@query
def sentiment_shares(spark, sf):
    return boards.sentiment_shares(visibility_by_category(spark, sf))


@query
def gap_top10(spark, sf):
    return boards.gap_top(competitor_gap(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query
def provider_sentiment_pivot(spark, sf):
    return boards.provider_sentiment_pivot(a.star_mentions(spark, sf))


@query
def citation_mix(spark, sf):
    return boards.citation_mix(citation_by_provider(spark, sf))


@query
def global_stats(spark, sf):
    return boards.global_stats(a.star_mentions(spark, sf), a.star_responses(spark, sf))


@query
def prompt_coverage(spark, sf):
    return boards.prompt_coverage(a.star_prompts(spark, sf), a.text_prompts(spark, sf))


@query
def score_band(spark, sf):
    return boards.score_bands(opportunity_scores(spark, sf).select("target", "domain_type", "opportunity_score"))


# --- features, scoring, model ----------------------------------------------------------------------------------

@query
def source_features(spark, sf):
    return features.source_features(a.star_citations(spark, sf), a.star_mentions(spark, sf))


@query
def brand_features(spark, sf):
    return features.brand_features(a.star_mentions(spark, sf), [*COMPETITORS, "Nobody"])


def _all_targets(spark, sf, mentions: DataFrame | None = None):
    """Brands with mentions and one without; from ``mentions``, or sums of them, where those are at hand."""
    seen = metrics.list_tracked_brands(a.star_mentions(spark, sf) if mentions is None else mentions).select(F.col("brand").alias("target"))
    return seen.unionByName(a.star_prompts(spark, sf).select(F.lit("Nobody").alias("target")).distinct())


def _sums(spark, sf) -> features.KeySums:
    return features.key_sums(a.star_citations(spark, sf), a.star_mentions(spark, sf))


def _features_and_targets(spark, sf, sums: features.KeySums | None = None) -> tuple[DataFrame, DataFrame]:
    sums = sums or _sums(spark, sf)
    return stored(features.source_features_of(sums), "features"), _all_targets(spark, sf, sums.brands)


@query
def opportunity_scores(spark, sf):
    return scoring.opportunity_scores(*_features_and_targets(spark, sf), COMPETITORS).drop("weight_rank")


@query
def fallback_scores(spark, sf):
    return scoring.fallback_scores(_all_targets(spark, sf)).drop("weight_rank")


@query
def reason_action_text(spark, sf):
    """Reason and action of every rule score against all competitors at once and against none."""
    known, targets = _features_and_targets(spark, sf)
    against, alone = (scoring.opportunity_scores(known, targets, rivals) for rivals in (COMPETITORS, []))
    return against.unionByName(alone).select("target", "domain_type", "priority", "reason", "action")


@query
def training_matrix(spark, sf):
    return features.training_matrix(a.star_citations(spark, sf), a.star_mentions(spark, sf))


def _model(spark, sf, sums: features.KeySums | None = None) -> tuple[model.Trained, str]:
    """The model of a data set, saved with its matrix. Every query trains its own, so none lives on what another has left."""
    path, matrix = scratch(spark, "model"), stored(features.training_matrix_of(sums or _sums(spark, sf)), "matrix")
    trained = model.train_model(matrix)
    model.save_model(trained.model, matrix, path)
    return trained, path


@query
def train_model(spark, sf):
    """Rows learned from and tested on, and whether the errors on the test rows are in bounds."""
    trained, path = _model(spark, sf)
    learned, tested = model.split(model.load_model(spark, path)[1])
    quality = model.model_quality(spark, trained).select((F.col("mae") >= 0).alias("mae_defined"), (F.col("r2") <= 1).alias("r2_defined"),
                                                         (F.col("r2") > 0).alias("better_than_mean"))
    count = lambda rows: rows.agg(F.count(F.lit(1))).scalar()
    return quality.select("*", count(learned).alias("train_rows"), count(tested).alias("test_rows"))


@query
def feature_importance(spark, sf):
    """The features with their weights' sum; the ranks run from 1 without a gap."""
    ranked = model.feature_importance(spark, _model(spark, sf)[0].model)
    total, ranks = ranked.agg(F.round(F.sum("importance"), 6)).scalar(), ranked.agg(F.count_distinct("rank")).scalar()
    return ranked.select("feature", (F.col("importance") >= 0).alias("weighted"), total.alias("total"), ranks.alias("ranks"))


@query
def save_and_load_model(spark, sf):
    """The feature rows stored with the model."""
    return model.load_model(spark, _model(spark, sf)[1])[1]


@query
def predict_opportunities(spark, sf):
    """Every (brand, domain type) of the matrix, with the bounds of the brand's scores."""
    of_brand = Window.partitionBy("brand")
    return _predicted(spark, sf).select("brand", "domain_type", "cooccurrence", F.min("opportunity_score").over(of_brand).alias("low"),
                                        F.max("opportunity_score").over(of_brand).alias("high"))


def _predicted(spark, sf, sums: features.KeySums | None = None):
    return model.predict_opportunities(*model.load_model(spark, _model(spark, sf, sums)[1]))


@query
def scale_per_brand(spark, sf):
    """The 0–100 scaling of predictions, with the true gap in place of a prediction."""
    rows = training_matrix(spark, sf).withColumn("predicted_opportunity", F.col("opportunity_gap"))
    return model.scale_per_brand(rows).select("brand", "domain_type", "opportunity_score")


@query
def recommend(spark, sf):
    """The ranks each target gets, the way they were found, and whether scores fall with the rank."""
    sums = _sums(spark, sf)
    found, targets = _features_and_targets(spark, sf, sums)
    ranked = model.recommend(targets, found, COMPETITORS, _predicted(spark, sf, sums))
    before = F.lag("opportunity_score").over(Window.partitionBy("target").orderBy("rank"))
    return ranked.select("target", F.col("rank").cast("long").alias("rank"), "model_used", F.coalesce(before >= F.col("opportunity_score"), F.lit(True)).alias("ordered"))


@query
def recommend_by_rules(spark, sf):
    found, targets = _features_and_targets(spark, sf)
    ranked = model.recommend(targets, found, COMPETITORS)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@query
def retrain_stats(spark, sf):
    return features.matrix_stats(training_matrix(spark, sf))


# --- alerts ----------------------------------------------------------------------------------------------------

def _star(spark, sf):
    return a.star_mentions(spark, sf), a.star_responses(spark, sf), a.star_prompts(spark, sf)


@query
def visibility_alerts(spark, sf):
    return alerts.visibility_alerts(*_star(spark, sf), threshold=75.5).drop("mentions")


@query
def visibility_alerts_by_slot(spark, sf):
    return alerts.visibility_alerts(*_star(spark, sf), threshold=75.5, mode="slots").drop("mentions")


@query
def alert_message(spark, sf):
    return alerts.alert_message(alerts.visibility_alerts(*_star(spark, sf), threshold=75.5), threshold=75.5).withColumn("n_alerts", F.col("n_alerts").cast("long"))


# --- fan-out vocabulary ----------------------------------------------------------------------------------------

def _exploded(spark, sf):
    return fanout.fanout_explode(a.fanout_records(spark, sf))


def _tokens(spark, sf):
    return fanout.fanout_tokens(_exploded(spark, sf), YEAR, CORPUS_CLASSES, CORPUS_STOP_WORDS)


@query
def collect_fanout(spark, sf):
    """Search queries a client function derives from each document's text; some calls fail."""
    def client():
        def call(prompt):
            if prompt.startswith("A"):
                raise TimeoutError("timeout")
            return prompt.split(". "), prompt
        return call

    asked = a.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"),
                                                   F.col("text").alias("original"), F.array(F.lit("from")).alias("target_brands"))
    records = fanout.collect_fanout(asked, client, spark.sparkContext.defaultParallelism)
    return records.select("id", "category", F.array_join("fanout_queries", "|").alias("fanout_queries"), "n_queries", "error")


@query
def fanout_explode(spark, sf):
    return _exploded(spark, sf).select("id", "category", "fanout_query")


@query
def fanout_count_stats(spark, sf):
    return fanout.fanout_count_stats(a.fanout_records(spark, sf))


@query
def fanout_histogram(spark, sf):
    return fanout.fanout_histogram(a.fanout_records(spark, sf))


@query
def fanout_by_category(spark, sf):
    return fanout.fanout_by_category(a.fanout_records(spark, sf))


@query
def fanout_tokens(spark, sf):
    return _tokens(spark, sf).groupBy("token", "category", "prompt_category").agg(F.count(F.lit(1)).alias("n"))


@query
def top_words(spark, sf):
    return fanout.top_words(_tokens(spark, sf))


@query
def keyword_share(spark, sf):
    return fanout.keyword_share(_tokens(spark, sf))


@query
def brand_injection(spark, sf):
    return fanout.brand_injection(_exploded(spark, sf))


@query
def injection_summary(spark, sf):
    return fanout.injection_summary(brand_injection(spark, sf))


@query
def keyword_presence(spark, sf):
    return fanout.keyword_presence(_exploded(spark, sf), CORPUS_CLASSES)


@query
def fanout_vs_citations(spark, sf):
    return fanout.fanout_vs_citations(_exploded(spark, sf), citation_mix(spark, sf), PROVIDERS[0], CORPUS_CLASSES)


# --- incremental -----------------------------------------------------------------------------------------------

def _run(writer) -> None:
    running = writer.start()
    running.awaitTermination()


@query
def ingest_runs(spark, sf):
    """Mentions stored by a stream over raw run files in several micro-batches; every run is spread over them."""
    return tables.read_table(spark, _ingested(spark, sf), "brand_mentions").select(*SLOT, "brand", "position")


def _ingested(spark, sf, n_runs: int = 1) -> str:
    """Root of the tables after a stream has read eight files three at a time, and a second start has found nothing new.

    Of more answers than eight files hold there are more files, and as many more at a time.
    """
    path, root, rows = scratch(spark, "raw"), scratch(spark, "tables"), a.text_responses(spark, sf)
    tables.create_tables(spark, root)
    more = math.ceil(rows.count() / (8 * FILE_ROWS)) or 1  # counted from the files' footers
    raw_runs.write_raw_run(rows.repartition(8 * more, F.xxhash64(*SLOT)), f"{path}/run_base")
    for _ in range(2):
        _run(jobs.ingest_runs(spark, path, root, a.text_prompts(spark, sf), f"{root}/_checkpoint", n_runs, max_files=3 * more))
    return root


@query
def ingest_runs_citations(spark, sf):
    return tables.read_table(spark, _ingested(spark, sf), "citation_sources").select(*SLOT, "url", "domain", "domain_type")


@query
def ingest_voted_runs(spark, sf):
    """Mentions after a voted ingest: the vote over trials that arrived in different micro-batches."""
    return tables.read_table(spark, _ingested(spark, sf, 3), "brand_mentions").select(*SLOT, "brand", "position")


@query
def daily_metrics_stream(spark, sf):
    """Closed days of the mention stream. A day of far-future rows first moves the watermark past all of them."""
    path, out = scratch(spark, "mentions"), scratch(spark, "daily")
    rows = a.star_mentions(spark, sf)
    rows.write.parquet(f"{path}/load=1")
    flush = rows.groupBy().agg(F.lit("_flush").alias("brand"), F.lit(1).alias("position"), F.lit("neutral").alias("sentiment"),
                               F.date_add(F.max("created_at").cast("date"), 30).cast("timestamp").alias("created_at"))
    flush.write.parquet(f"{path}/load=2")
    stream = spark.readStream.schema("brand string, position int, sentiment string, created_at timestamp").parquet(f"{path}/load=*")
    _run(jobs.daily_metrics_stream(stream).writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True))
    return spark.read.parquet(out).select("brand", "date", "avg_position", "mention_count", F.round("sentiment_score", 6).alias("sentiment_score"))


@query
def alert_stream(spark, sf):
    root, out = scratch(spark, "tables"), scratch(spark, "alerts")
    tables.create_tables(spark, root)
    found, responses, prompts = _star(spark, sf)
    tables.save_mentions(found, root)
    tables.save_responses(responses, root, mode="append")
    tables.upsert_prompts(prompts, root)
    stream = spark.readStream.schema(TABLES["llm_responses"]).option("recursiveFileLookup", True).parquet(tables.table_path(root, "llm_responses"))
    _run(jobs.alert_stream(stream, root, out, f"{root}/_checkpoint"))
    # With a schema, as a stream that raises no alert writes no file to tell it from.
    return spark.read.schema("category string, brand string, current double, previous double, reason string").parquet(out).select("category", "brand", "current", "previous", "reason")
