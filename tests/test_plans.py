"""Plans that have to hold at any scale: pruned and filtered scans, no nested loops, no unbounded single task."""

import re

import pytest
from pyspark.sql import functions as F

from echolens.operators import alerts, analysis, citations, entities, features, mentions, metrics
from echolens.plans import adapters as a
from echolens.plans import registry
from echolens.session import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return tuple(stored(build(spark, SF), "plan") for build in (a.star_mentions, a.star_responses, a.star_prompts, a.star_citations))


@pytest.fixture
def shuffled(spark):
    """Joins as they are planned when no side is small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(star):
    said, answers, prompts, _ = star
    text = plan(metrics.visibility_by_category(said, answers, prompts, "building", ["Brand#1", "Brand#2"]))
    assert re.search(r"PushedFilters: \[[^\]]*In\(brand, \[Brand#1,Brand#2\]\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(category,building\)", text)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert "run_id:string,prompt_id:string,provider:string" in schemas
    assert all("target_brands" not in s and "latency_ms" not in s for s in schemas)
    assert "created_at" not in plan(metrics.citation_type_breakdown(star[3]))


def test_no_nested_loops_and_no_forced_broadcasts(star, shuffled):
    said, answers, prompts, cites = star
    for df in (metrics.visibility_by_category(said, answers, prompts), metrics.competitor_gap(said, ["Brand#1"], prompts),
               metrics.category_stats(said, answers, prompts), metrics.llm_disagreement(said, answers, prompts),
               features.training_matrix(cites, said), alerts.visibility_alerts(said, answers, prompts)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastExchange" not in text


def test_top_rows_per_group_are_limited_before_the_shuffle(star):
    assert "WindowGroupLimit" in plan(metrics.prompts_by_category(star[2]))
    assert "TakeOrderedAndProject" in plan(mentions.mention_counts(star[0]))


def test_joins_see_aggregated_facts(star, shuffled):
    """A hot prompt reaches the join with the prompts as one row per brand."""
    text = plan(metrics.visibility_by_category(*star[:3]))
    join = text.index("SortMergeJoin [prompt_id")
    assert "HashAggregate(keys=[prompt_id" in text[join:]


def test_adding_a_hot_slot_changes_only_its_counts(spark, star):
    """Half a million copies of one mention."""
    said = star[0]
    hot = spark.range(500_000).select(F.lit("r0").alias("run_id"), F.lit("p1").alias("prompt_id"), F.lit("openai").alias("provider"),
                                      F.lit("Hot").alias("brand"), F.lit(1).alias("position"), F.lit("positive").alias("sentiment"),
                                      F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    both = said.unionByName(hot)
    rows = {r.brand: r.mentions for r in metrics.visibility_summary(both, star[1]).collect()}
    assert rows.pop("Hot") == 500_000
    assert rows == {r.brand: r.mentions for r in metrics.visibility_summary(said, star[1]).collect()}
    gap = {r.brand: r.appears_when_target_absent for r in metrics.competitor_gap(both, "Brand#1").collect()}
    in_slot = said.filter("run_id = 'r0' AND prompt_id = 'p1' AND provider = 'openai' AND brand = 'Brand#1'").count()
    assert gap.get("Hot", 0) == (0 if in_slot else 500_000)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_stand_once_in_the_plan(spark):
    texts, lists = a.text_responses(spark, SF), a.text_prompts(spark, SF)
    assert optimized(citations.extract_citations(texts)).count("regexp_extract_all(") == 1
    assert optimized(analysis.voted_citations(texts)).count("regexp_extract_all(") == 1
    assert optimized(entities.discover_entities(texts, entities.target_brand_names(lists))).count("regexp_extract_all(") == 1
    assert optimized(mentions.detect_brands(texts, lists)).count("split(") == 1


@pytest.mark.parametrize("found", [mentions.detect_brands, mentions.with_found_brands, analysis.parse_answers])
def test_a_text_is_folded_once_and_not_per_brand(spark, found):
    text = optimized(found(a.text_responses(spark, SF).select("run_id", "prompt_id", "provider", "response_text", "error"), a.text_prompts(spark, SF)))
    assert text.count("lambdafunction(Contains(") == 1 and "lambdafunction(Contains(upper(" not in text


def test_gap_of_many_targets_reads_the_facts_once(star, shuffled):
    text = plan(metrics.competitor_gap(star[0], [f"Brand#{i}" for i in range(125)]))
    initial = text.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan") <= 2  # the total and the part inside share one exchange at run time


def test_types_of_citations_run_no_pattern_on_line_items(spark):
    """A filter on the type reaches the line items; it compares numbers there."""
    assert "rlike" not in optimized(a.star_citations(spark, SF).filter(F.col("domain_type").isNotNull())).lower()


def test_facts_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(a, "TASK_ROWS", 100, raising=False)
    assert a.star_mentions(spark, SF).rdd.getNumPartitions() >= 60


def test_gap_scans_the_mentions_once(star, shuffled):
    text = plan(metrics.competitor_gap(star[0], ["Brand#1", "Brand#2"])).split("== Initial Plan ==")[-1]
    assert text.count("FileScan") == 1


def test_features_read_sums_in_place_of_facts(star):
    said, _, _, cites = star
    for found in (features.source_features(cites, said), features.training_matrix(cites, said)):
        assert not {*said.inputFiles(), *cites.inputFiles()} & set(found.inputFiles())


def test_sums_are_dealt_to_more_tasks_as_they_grow(star, shuffled, monkeypatch):
    monkeypatch.setattr(features, "TASK_ROWS", 100)
    sums = features.key_sums(star[3], star[0])
    assert sums.tasks == -(-max(sums.domains.count(), sums.brands.count()) // 100) > 8
    for df, dealt in ((features.cooccurrence(sums), 2), (features.source_features_of(sums), 3), (features.training_matrix_of(sums), 4)):
        assert len(re.findall(rf"hashpartitioning\(prompt_id#\d+(?:, provider#\d+)?, {sums.tasks}\), REPARTITION_BY_NUM", plan(df))) == dealt


def test_sums_meet_in_hash_tables_without_a_sort(star, shuffled):
    """Neither side of a join on questions is sorted, nor are brands collected into lists, which sorts them beyond a few keys."""
    text = plan(features.training_matrix_of(features.key_sums(star[3], star[0])))
    assert len(re.findall(r"ShuffledHashJoin \[prompt_id", text)) == 2
    assert "SortMergeJoin [prompt_id" not in text and "collect_list" not in text


def test_facts_are_summed_without_a_sort(spark):
    """Texts as measures would have all rows sorted."""
    assert "SortAggregate" not in plan(a.star_mentions(spark, SF)) + plan(a.star_responses(spark, SF))


def test_least_flag_is_that_of_the_texts(spark, tmp_path):
    """Flags of any text: the least of a slot says the sentiment."""
    import os
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", tmp_path / name)
    flags = F.element_at(F.array(*[F.lit(x) for x in ("0", "A", "AB", "N", "R", "RR", "z")], F.lit(None)), (F.xxhash64("l_orderkey", "l_linenumber") % 8 + 8).cast("int") % 8 + 1)
    os.remove(tmp_path / "lineitem.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_returnflag", flags).write.parquet(str(tmp_path / "lineitem.parquet"))
    sf = str(tmp_path)
    lines = a.table(spark, sf, "lineitem").join(a.table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(a.table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    least = lines.groupBy((F.col("o_orderkey") % 50).alias("r"), "o_custkey", (F.col("o_orderkey") % 3).alias("p"), "p_brand").agg(F.min("l_returnflag").alias("f"))
    want = {r[0]: r[1] for r in least.groupBy(F.when(F.col("f") == "A", "positive").when(F.col("f") == "R", "negative").otherwise("neutral")).count().collect()}
    assert {r[0]: r[1] for r in a.star_mentions(spark, sf).groupBy("sentiment").count().collect()} == want


def test_recommendations_derive_the_mentions_once(spark, monkeypatch):
    derived, calls = a.star_mentions, []
    monkeypatch.setattr(a, "star_mentions", lambda *args: calls.append(args) or derived(*args))
    assert registry.recommend_by_rules(spark, SF).count() and len(calls) == 1


def test_model_queries_train_anew_on_facts_derived_once(spark, monkeypatch):
    train, derived, trained, calls = registry.model.train_model, a.star_mentions, [], []
    monkeypatch.setattr(registry.model, "train_model", lambda matrix: trained.append(matrix) or train(matrix, trees=2))
    monkeypatch.setattr(a, "star_mentions", lambda *args: calls.append(args) or derived(*args))
    for _ in range(2):
        assert registry.recommend(spark, SF).count()
    assert len(trained) == 2 and len(calls) == 2
