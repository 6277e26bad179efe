import pytest

from echolens.fixed import DOMAIN_WEIGHTS
from echolens.operators import alerts, features, model, scoring
from echolens.plans import adapters, registry

FEATURES = "domain_type string, brand string, cooccurrence_count bigint, avg_position_with_source double, citation_count bigint, unique_domains bigint"


def score(spark, rows, target="Asana", competitors=("Jira",)):
    targets = spark.createDataFrame([(target,)], "target string")
    got = scoring.opportunity_scores(spark.createDataFrame(rows, FEATURES), targets, list(competitors)).collect()
    return {r.domain_type: r for r in got}


def test_gap_raises_the_score(spark):
    got = score(spark, [("review_site", "Asana", 1, 2.0, 5, 3), ("review_site", "Jira", 5, 1.5, 10, 5)])
    assert got["review_site"].opportunity_score == 86.0
    assert got["review_site"].reason == "Competitors appear 5.0× in review_site sources vs your 1.0× — high gap opportunity"
    assert got["tech_media"].opportunity_score == 41.0 and got["tech_media"].priority == "MEDIUM"
    assert set(got) == set(DOMAIN_WEIGHTS)


def test_no_gap_and_caps(spark):
    assert score(spark, [("review_site", "Asana", 5, 2.0, 5, 3), ("review_site", "Jira", 5, 2.0, 5, 3)])["review_site"].opportunity_score < 70
    best = score(spark, [("review_site", "Asana", 0, 1.0, 100, 50), ("review_site", "Jira", 100, 1.0, 100, 50)])["review_site"]
    assert best.opportunity_score == 98.0
    assert score(spark, [("review_site", "Asana", 0, 1.0, 100, 50)], competitors=())["review_site"].opportunity_score == 68.0


def test_fallback_without_features(spark):
    got = score(spark, [])
    ranked = sorted(got.values(), key=lambda r: (-r.opportunity_score, r.weight_rank))
    assert [r.domain_type for r in ranked][:4] == ["review_site", "tech_media", "business_media", "community"]
    assert (got["review_site"].priority, got["blog_platform"].priority, got["other"].priority) == ("HIGH", "MEDIUM", "LOW")
    targets = spark.createDataFrame([("Asana",)], "target string")
    assert sorted(scoring.fallback_scores(targets).collect()) == sorted(got.values())
    assert all(r.action for r in got.values())


def test_reasons_are_given_against_all_competitors_and_against_none(spark):
    rows = registry.reason_action_text(spark, "/root/testdata/sf0.001").collect()
    gaps = [r for r in rows if r.reason.startswith("Competitors appear")]
    keys = [(r.target, r.domain_type) for r in rows]
    assert gaps and len(gaps) < len(rows) and all(keys.count(k) == 2 for k in keys)


@pytest.fixture(scope="module")
def demo(spark):
    sf = "/root/testdata/sf0.001"
    return {"brand_mentions": adapters.star_mentions(spark, sf).cache(), "citation_sources": adapters.star_citations(spark, sf).cache()}


@pytest.fixture(scope="module")
def matrix(demo):
    return features.training_matrix(demo["citation_sources"], demo["brand_mentions"]).cache()


@pytest.fixture(scope="module")
def trained(matrix):
    return model.train_model(matrix, trees=15)


def test_split_is_stable(matrix):
    train, test = model.split(matrix)
    assert train.count() + test.count() == matrix.count()
    again = model.split(matrix.repartition(5))[1]
    assert again.select("domain_type", "brand").exceptAll(test.select("domain_type", "brand")).isEmpty()


def test_model_learns_and_survives_storage(spark, matrix, trained, tmp_path):
    assert trained.mae > 0 and trained.r2 > 0.3
    ranked = model.feature_importance(spark, trained.model).collect()
    assert {r.feature for r in ranked} == set(model.FEATURES) and ranked[0].importance >= ranked[-1].importance
    model.save_model(trained.model, matrix, str(tmp_path / "m"))
    loaded, stored = model.load_model(spark, str(tmp_path / "m"))
    assert sorted(model.predict_opportunities(loaded, stored).collect()) == sorted(model.predict_opportunities(trained.model, matrix).collect())


def test_predictions_are_scaled_per_brand(matrix, trained):
    rows = model.predict_opportunities(trained.model, matrix).collect()
    by_brand = {}
    for r in rows:
        by_brand.setdefault(r.brand, []).append(r.opportunity_score)
    assert all(min(s) == 0.0 and max(s) == 100.0 for s in by_brand.values() if len(set(s)) > 1)


def test_unseen_domain_type_and_equal_predictions(spark, matrix, trained):
    from pyspark.sql import functions as F
    unseen = matrix.filter("brand = 'Brand#3'").limit(1).withColumn("domain_type", F.lit("brand_new"))
    (row,) = model.predict_opportunities(trained.model, unseen).collect()
    assert (row.domain_type, row.opportunity_score) == ("brand_new", 50.0)


def test_recommendations_fall_back_to_rules(spark, demo, matrix, trained):
    targets = spark.createDataFrame([("Brand#3",), ("Nobody",)], "target string")
    base = features.source_features(demo["citation_sources"], demo["brand_mentions"]).cache()
    rows = model.recommend(targets, base, ["Brand#8"], model.predict_opportunities(trained.model, matrix), top_n=3).collect()
    assert [(r.target, r["rank"], r.model_used) for r in rows] == [("Brand#3", i, "gbt") for i in (1, 2, 3)] + [("Nobody", i, "rule_based") for i in (1, 2, 3)]
    assert {r.model_used for r in model.recommend(targets, base, ["Brand#8"]).collect()} == {"rule_based"}


def test_no_rows_to_train_on(matrix):
    with pytest.raises(ValueError):
        model.train_model(matrix.limit(0))


def alert_frames(spark, said):
    prompts = spark.createDataFrame([("p", "t", "crm", "[]"), ("q", "t", "other", "[]")], "prompt_id string, prompt_text string, category string, target_brands string")
    answers = spark.createDataFrame([(f"r{i}", "p", "x", "2026-01-01") for i in range(10)], "run_id string, prompt_id string, provider string, d string")
    rows = spark.createDataFrame(said, "run_id string, prompt_id string, brand string, d string")
    from pyspark.sql import functions as F
    at = F.col("d").cast("timestamp").alias("created_at")
    return (rows.select("run_id", "prompt_id", F.lit("x").alias("provider"), "brand", F.lit(1).alias("position"), F.lit("neutral").alias("sentiment"), at),
            answers.select("run_id", "prompt_id", "provider", at), prompts)


def test_alert_reasons_and_message(spark):
    said = [("r0", "p", "Low", "2026-01-02")] + [(f"r{i}", "p", "Fell", "2026-01-01") for i in range(3)] + [(f"r{i}", "p", "Fine", "2026-01-02") for i in range(9)]
    frames = alert_frames(spark, said)
    rows = {r.brand: r for r in alerts.visibility_alerts(*frames).collect()}
    assert (rows["Low"].current, rows["Low"].previous, rows["Low"].reason) == (10.0, None, "below threshold")
    assert (rows["Fell"].current, rows["Fell"].previous, rows["Fell"].reason) == (30.0, 100.0, "significant drop")
    assert (rows["Fine"].triggered, rows["Fine"].reason) == (False, "")
    (message,) = alerts.alert_message(alerts.visibility_alerts(*frames)).collect()
    assert message.message == (":warning: *Brand Visibility Alert* — category: `crm`\n\n• *Fell*: visibility fell *70.0pp* (100.0% → 30.0%)\n"
                               "• *Low*: visibility dropped to *10.0%* (threshold: 15%)")


def test_alerts_with_a_single_day_have_no_previous(spark):
    rows = alerts.visibility_alerts(*alert_frames(spark, [("r0", "p", "A", "2026-01-02"), ("r1", "q", "B", "2026-01-02")])).collect()
    assert [(r.category, r.brand, r.previous) for r in rows] == [("crm", "A", None), ("other", "B", None)]
