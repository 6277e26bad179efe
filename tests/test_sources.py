import json
from datetime import datetime
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F

from echolens.operators import fanout, requests
from echolens.operators.numbering import number_rows
from echolens.plans.batch import run_batch
from echolens.schemas import TABLES
from echolens.session import scratch
from echolens.sources import raw_runs, tables
from echolens.streaming import jobs

ANSWER = "run_id string, prompt_id string, provider string, response_text string, latency_ms int, created_at timestamp"
BRANDS = json.dumps(["Asana", "Jira", "Monday.com"])


@pytest.fixture
def root(spark):
    path = scratch(spark, "tables")
    tables.create_tables(spark, path)
    return path


def answer(run, text, day=1, prompt="p"):
    return (run, prompt, "openai", text, 5, datetime(2026, 1, day))


def prompts(spark, *ids, category="crm"):
    return spark.createDataFrame([(i, f"text {i}", category, BRANDS) for i in ids], "prompt_id string, prompt_text string, category string, target_brands string")


def test_created_tables_are_empty_and_typed(spark, root):
    for name, schema in TABLES.items():
        table = tables.read_table(spark, root, name)
        assert table.schema.fieldNames() == schema.fieldNames() and table.isEmpty()
    tables.create_tables(spark, root)


def test_upsert_keeps_the_last_answer_per_slot(spark, root):
    tables.save_responses(spark.createDataFrame([answer("r1", "old"), answer("r2", "kept"), answer("r3", "a", 1), answer("r3", "b", 2)], ANSWER), root)
    tables.save_responses(spark.createDataFrame([answer("r1", "new", 1)], ANSWER), root)
    tables.save_responses(spark.createDataFrame([], ANSWER), root)
    assert {(r.run_id, r.response_text) for r in tables.read_table(spark, root, "llm_responses").collect()} == {("r1", "new"), ("r2", "kept"), ("r3", "b")}


def test_append_keeps_all_answers(spark, root):
    for _ in range(2):
        tables.save_responses(spark.createDataFrame([answer("r1", "x")], ANSWER), root, mode="append")
    assert tables.read_table(spark, root, "llm_responses").count() == 2


def answer_files(root, name="llm_responses"):
    return {str(p): p.stat().st_mtime_ns for p in Path(tables.table_path(root, name)).rglob("*.parquet")}


def texts(spark, root, **bounds):
    rows = tables.read_table(spark, root, "llm_responses", **bounds).collect()
    return sorted((r.run_id or "", r.prompt_id or "", r.response_text, r.created_at.day) for r in rows)


def test_an_answer_sent_again_writes_one_small_file(spark, root):
    tables.save_responses(spark.createDataFrame([answer("r1", f"t{i}", prompt=f"p{i}") for i in range(500)], ANSWER), root)
    before = answer_files(root)
    tables.save_responses(spark.createDataFrame([answer("r1", "again", 2, "p7")], ANSWER), root)
    assert answer_files(root) == before  # nothing rewritten
    assert len(answer_files(root, tables.CHANGES)) == 1
    got = texts(spark, root)
    assert len(got) == 500 and ("r1", "p7", "again", 2) in got


def test_upserts_and_compactions_in_any_order_equal_a_plain_dictionary(spark, root):
    random, expected = Random(5), {}
    for step in range(6):
        rows = [(random.choice(["a", "a-t0", "a-t1", "b:1", "c d/e%", "", None]), random.choice(["p", "q", None]), "openai", f"s{step}-{i}", i,
                 datetime(2026, 1, 1 + random.randrange(28))) for i in range(12)]
        for row in sorted(rows, key=lambda r: (r[5], r[4])):
            expected[row[:3]] = row
        tables.save_responses(spark.createDataFrame(rows, ANSWER), root, order=["created_at", "latency_ms"])
        if step in (2, 4):
            tables.compact_responses(spark, root, share=0 if step == 2 else 0.8)
        assert texts(spark, root) == sorted((r[0] or "", r[1] or "", r[3], r[5].day) for r in expected.values())
    for run in ("a", "b:1", "c d/e%"):
        mine = sorted((r[0], r[1] or "", r[3], r[5].day) for r in expected.values() if r[0] and r[0].split("-t")[0] == run)
        assert texts(spark, root, runs=[run]) == mine
    late = sorted((r[0] or "", r[1] or "", r[3], r[5].day) for r in expected.values() if r[5].day >= 15)
    assert texts(spark, root, since="2026-01-15") == late  # a change may have moved an answer into or out of the range


def test_compaction_folds_what_is_large_and_reads_are_plain_again(spark, root):
    rows = [answer(run, "old", prompt=f"p{i}") for run in ("few", "many") for i in range(20)]
    tables.save_responses(spark.createDataFrame(rows, ANSWER), root)
    sent = [answer("few", "new", 2, "p0"), *[answer("many", "new", 2, f"p{i}") for i in range(10)]]
    tables.save_responses(spark.createDataFrame(sent, ANSWER), root)
    seen = texts(spark, root)
    assert [text for *_, text, _ in seen].count("new") == 11
    kept = {p: t for p, t in answer_files(root).items() if "=few" in p}
    assert tables.compact_responses(spark, root, share=0.3) == 1 and texts(spark, root) == seen
    assert {p: t for p, t in answer_files(root).items() if "=few" in p} == kept
    assert tables.compact_responses(spark, root, share=0) == 1 and texts(spark, root) == seen
    assert tables.compact_responses(spark, root, share=0) == 0
    plan = tables.read_table(spark, root, "llm_responses")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    assert tables.sweep_loads(spark, root, tables.CHANGES, older_than=0) == 2 and not answer_files(root, tables.CHANGES)


def test_runs_without_changes_are_read_without_a_join(spark, root):
    tables.save_responses(spark.createDataFrame([answer("a", "x"), answer("b", "x")], ANSWER), root)
    tables.save_responses(spark.createDataFrame([answer("a", "y")], ANSWER), root)
    plan = tables.read_table(spark, root, "llm_responses", runs=["b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and texts(spark, root, runs=["b"]) == [("b", "p", "x", 1)]


@pytest.mark.parametrize("broken", ["publish", "withdraw"])
def test_a_broken_off_upsert_or_compaction_is_made_up_for(spark, root, monkeypatch, broken):
    old, new = ([answer("r", t, d, f"p{i}") for i in range(n)] for t, d, n in (("old", 1, 2), ("new", 2, 3)))
    def lost(*_):
        raise OSError("lost")
    tables.save_responses(spark.createDataFrame(old, ANSWER), root)
    with monkeypatch.context() as patch:
        patch.setattr(tables.ledger, broken, lost)
        with pytest.raises(OSError):
            tables.save_responses(spark.createDataFrame(new, ANSWER), root)
            tables.compact_responses(spark, root, share=0)
    expected = [("r", f"p{i}", "new", 2) for i in range(3)]
    if broken == "publish":
        assert texts(spark, root) == [("r", "p0", "old", 1), ("r", "p1", "old", 1), expected[2]]
        tables.save_responses(spark.createDataFrame(new, ANSWER), root)
    assert texts(spark, root) == expected
    tables.compact_responses(spark, root, share=0)
    assert texts(spark, root) == expected


def test_latest_rows_of_a_hot_key(spark):
    rows = spark.range(100_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS at", "concat('v', id) AS v")
    got = tables.latest_rows(rows, ["k"], ["at"])
    assert got.count() == 66_667 and got.filter("k = 'hot'").first().v == "v99999"


def test_loads_append_or_replace(spark, root):
    rows = spark.createDataFrame([("r", "p", "x", "Asana", 1, "neutral", "s", datetime(2026, m, 1)) for m in (1, 2)], TABLES["brand_mentions"])
    tables.save_mentions(rows, root)
    tables.save_mentions(rows, root)
    tables.save_mentions(rows, root, load="l")
    tables.save_mentions(rows, root, load="l")
    tables.save_mentions(rows.limit(0), root)
    assert tables.read_table(spark, root, "brand_mentions").count() == 6


def test_unseen_runs(spark):
    stored = spark.createDataFrame([("a",), ("b-t0",)], "run_id string")
    new = spark.createDataFrame([("a-t0",), ("a",), ("b-t0",), ("b-t1",), ("my-test",)], "run_id string")
    assert sorted(r.run_id for r in tables.unseen_runs(new, stored).collect()) == ["b-t1", "my-test"]


def test_prompt_life_cycle(spark, root):
    first, second = F.lit("2026-01-01"), F.lit("2026-01-02")
    assert tables.seed_prompts(prompts(spark, "a", "b", "c"), root, first) == 3
    assert tables.seed_prompts(prompts(spark, "b", "c", "d"), root, second) == 1
    tables.upsert_prompts(prompts(spark, "a", category="new"), root, F.lit("2026-01-03"))
    listed = tables.list_prompts(tables.read_table(spark, root, "prompts")).collect()
    assert [(r.prompt_id, r.category) for r in listed] == [("b", "crm"), ("c", "crm"), ("d", "crm"), ("a", "new")]
    assert listed[0].target_brands == ["Asana", "Jira", "Monday.com"]

    refused = tables.create_prompts(prompts(spark, "a", "e").unionByName(prompts(spark, "x").withColumn("prompt_id", F.lit(None).cast("string"))), root)
    assert [r.prompt_id for r in refused.collect()] == ["a"]
    now = {r.prompt_id for r in tables.read_table(spark, root, "prompts").collect()}
    assert len(now) == 6 and any(i.startswith("custom_") and len(i) == 15 for i in now)

    ids = spark.createDataFrame([("b",), ("nope",)], "prompt_id string")
    assert tables.delete_prompts(ids, root) == 1 and tables.delete_prompts(ids, root) == 0
    assert tables.get_prompt(tables.read_table(spark, root, "prompts"), "b").isEmpty()
    assert tables.seed_prompts(prompts(spark, "b"), root) == 1
    assert tables.get_prompt(tables.read_table(spark, root, "prompts"), "b").count() == 1


def write_array(path, run, texts):
    rows = [{"run_id": run, "prompt_id": "p", "prompt_text": "q", "provider": "openai", "model": "m", "response_text": t,
             "latency_ms": 3, "created_at": "2026-01-01T00:00:00", "error": None} for t in texts]
    path.write_text(json.dumps(rows, indent=2))


def test_raw_array_files_and_latest_run(spark, tmp_path):
    import os
    write_array(tmp_path / "run_a.json", "a", ["one", "two"])
    write_array(tmp_path / "run_b.json", "b", ["three"])
    os.utime(tmp_path / "run_b.json", (1, 1))
    assert sorted(r.response_text for r in raw_runs.read_raw_runs(spark, str(tmp_path)).collect()) == ["one", "three", "two"]
    assert {r.run_id for r in raw_runs.latest_run(spark, str(tmp_path)).collect()} == {"a"}


@pytest.mark.parametrize("n, slices", [(1000, 8), (3, 64), (1, 4)])
def test_rows_are_numbered_in_order(spark, n, slices):
    rows = spark.range(n).selectExpr("int(id % 7) AS a", "concat('k', id) AS b").repartition(5)
    got = [(r.a, r.b) for r in number_rows(rows, ["a", "b"], slices=slices).orderBy("row_number").collect()]
    assert got == sorted(got) and len(got) == n
    assert [r.row_number for r in number_rows(rows, ["a", "b"], slices=slices).orderBy("row_number").collect()] == list(range(1, n + 1))


def test_request_plan(spark):
    stored = prompts(spark, *[f"p{i:02d}" for i in range(25)]).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    plan = requests.request_plan(stored, "base", ["openai", "gemini"], n_runs=3)
    assert plan.count() == 25 * 2 * 3
    assert {(r.batch, r.n) for r in plan.groupBy("batch").agg(F.count_distinct("prompt_id").alias("n")).collect()} == {(0, 10), (1, 10), (2, 5)}
    assert {r.run_id for r in plan.collect()} == {"base-t0", "base-t1", "base-t2"}
    assert {r.run_id for r in requests.request_plan(stored, "base").collect()} == {"base"}


def test_client_failures_become_error_rows(spark):
    plan = spark.createDataFrame([("r", "p", "good", "openai"), ("r", "q", "bad", "openai")], "run_id string, prompt_id string, prompt_text string, provider string")

    def client():
        def call(provider, prompt):
            if prompt == "bad":
                raise TimeoutError("timeout")
            return "m1", f"{provider} says {prompt}"
        return call

    rows = {r.prompt_id: r for r in requests.collect_responses(plan, client, 2).collect()}
    assert (rows["p"].response_text, rows["p"].model, rows["p"].error) == ("openai says good", "m1", None)
    assert (rows["q"].response_text, rows["q"].error) == ("", "timeout") and rows["q"].latency_ms >= 0


def test_fanout_client(spark):
    rows = spark.createDataFrame([("1", "crm", "best crm?", ["HubSpot"]), ("2", "crm", "bad", ["HubSpot"])], "id string, category string, original string, target_brands array<string>")

    def client():
        def call(prompt):
            if prompt == "bad":
                raise ValueError("no")
            return ["best crm 2026 review", "HubSpot vs others"], "y" * 700
        return call

    records = fanout.collect_fanout(rows, client, 2).cache()
    by_id = {r.id: r for r in records.collect()}
    assert (by_id["1"].n_queries, len(by_id["1"].response_text), by_id["2"].error, by_id["2"].fanout_queries) == (2, 700, "no", [])
    queries = fanout.fanout_explode(records)
    assert {(r.token, r.category) for r in fanout.fanout_tokens(queries, 2026).collect()} == {
        ("best", "comparison"), ("crm", "other"), ("2026", "temporal"), ("review", "evaluation"), ("hubspot", "other"), ("others", "other")}
    (first, second) = fanout.brand_injection(queries).orderBy("fanout_query").collect()
    assert (first.new_brands, first.brand_injected, second.new_brands) == ("HubSpot", True, "—")
    summary = fanout.injection_summary(fanout.brand_injection(queries)).first()
    assert (summary.total_queries, summary.with_brand, summary.with_brand_pct) == (2, 1, 50.0)
    presence = fanout.keyword_presence(queries).first()
    assert (presence.evaluation_pct, presence.comparison_pct) == (50.0, 100.0)


TEXTS = {"openai": "Asana, then Jira https://g2.com/a", "anthropic": "Jira https://dev.to/b", "gemini": "Try Trello or Asana"}


def answering(fails=(), asked=None):
    """Answers by provider; the trials in ``fails`` time out."""
    def answer_plan(plan):
        if asked is not None:
            asked.extend(tuple(r) for r in plan.select("run_id", "prompt_id", "provider").collect())
        text = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])[F.col("provider")]
        failed = F.col("run_id").isin(list(fails))
        return plan.withColumns({"model": F.lit("m"), "response_text": F.when(~failed, text), "latency_ms": F.lit(1), "error": F.when(failed, "timeout")})
    return answer_plan


def stored_rows(spark, root):
    mentions = sorted((r.run_id, r.prompt_id, r.provider, r.brand, r.position) for r in tables.read_table(spark, root, "brand_mentions").collect())
    cites = sorted((r.prompt_id, r.provider, r.url) for r in tables.read_table(spark, root, "citation_sources").collect())
    return mentions, cites, tables.read_table(spark, root, "llm_responses").count()


def test_batch_run_is_stored_once(spark, root):
    tables.upsert_prompts(prompts(spark, "a", "b"), root)
    done = run_batch(spark, root, "base", answering(), category="crm", n_runs=3)
    assert {(r.brand, r.mentions) for r in done.counts.collect()} == {("Asana", 4), ("Jira", 4)}
    assert tables.read_table(spark, root, "llm_responses").count() == 2 * 3 * 3
    assert {r.brand for r in done.alerts.collect()} == {"Asana", "Jira"} and "Try Trello" in {r.entity for r in done.discovered.collect()}
    before = stored_rows(spark, root)
    assert run_batch(spark, root, "base", answering(), n_runs=3).mentions.isEmpty() and stored_rows(spark, root) == before
    assert run_batch(spark, root, "other", answering()).mentions.count() == 8


def test_a_failed_trial_is_asked_again_and_voted_with_the_stored_ones(spark, root, tmp_path):
    tables.upsert_prompts(prompts(spark, "a"), root)
    run_batch(spark, root, "base", answering(["base-t1"]), n_runs=2)
    asked = []
    run_batch(spark, root, "base", answering(asked=asked), n_runs=2)
    assert {run for run, _, _ in asked} == {"base-t1"} and len(asked) == 3
    whole = scratch(spark, "tables")
    tables.create_tables(spark, whole)
    tables.upsert_prompts(prompts(spark, "a"), whole)
    run_batch(spark, whole, "base", answering(), n_runs=2)
    assert stored_rows(spark, root) == stored_rows(spark, whole)


def test_a_batch_that_broke_off_is_made_up_for(spark, root, monkeypatch):
    tables.upsert_prompts(prompts(spark, "a"), root)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "save_responses", broken)
        with pytest.raises(RuntimeError):
            run_batch(spark, root, "base", answering())
    run_batch(spark, root, "base", answering())
    mentions, cites, answers = stored_rows(spark, root)
    assert (len(mentions), len(cites), answers) == (4, 2, 3)


def test_a_load_is_replaced_in_every_month(spark, root):
    rows = spark.createDataFrame([("r", "p", "openai", "Asana", 1, "neutral", "s", datetime(2026, 1, 31))], TABLES["brand_mentions"])
    tables.save_mentions(rows, root, load="x")
    tables.save_mentions(rows.withColumn("created_at", F.lit("2026-02-01").cast("timestamp")), root, load="x")
    assert [str(r.created_at.date()) for r in tables.read_table(spark, root, "brand_mentions").collect()] == ["2026-02-01"]


def partition_filters(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PartitionFilters: "):text.index("PushedFilters: ")]


def test_reads_are_pruned_by_month_and_run(spark, root):
    rows = spark.createDataFrame([(f"r{m}-t0", "p", "openai", "Asana", 1, "neutral", "s", datetime(2026, m, 5)) for m in (1, 2, 3)], TABLES["brand_mentions"])
    tables.save_mentions(rows, root)
    tables.save_responses(spark.createDataFrame([answer("r1-t0", "x"), answer("r2-t1", "y")], ANSWER), root)
    part = tables.read_table(spark, root, "brand_mentions", since="2026-02-05", until="2026-02-05")
    assert [r.run_id for r in part.collect()] == ["r2-t0"] and partition_filters(part).count("event_month") >= 2
    part = tables.read_table(spark, root, "llm_responses", runs=["r2"])
    assert [r.run_id for r in part.collect()] == ["r2-t1"] and "part_key" in partition_filters(part)


def run_stream(writer):
    query = writer.start()
    query.awaitTermination()
    return query


def test_ingested_stream_equals_batch_and_survives_replay(spark, root, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"r{i % 4}", f"p{i}", "openai", "Asana and Jira https://g2.com/a", 3, datetime(2026, 1, 1)) for i in range(20)], ANSWER)
    known = prompts(spark, *[f"p{i}" for i in range(20)])
    early, late = rows.filter("run_id < 'r2'"), rows.filter("run_id >= 'r2'")
    for part in (early, late):
        raw_runs.write_raw_run(part, str(tmp_path / "raw" / part.first().run_id))
        run_stream(jobs.ingest_runs(spark, str(tmp_path / "raw"), root, known, str(tmp_path / "cp")))
    assert tables.read_table(spark, root, "llm_responses").count() == 20
    assert tables.read_table(spark, root, "brand_mentions").count() == 40
    assert tables.read_table(spark, root, "citation_sources").count() == 20
    # A batch that failed after its mentions were written is run again.
    other = scratch(spark, "tables")
    tables.create_tables(spark, other)
    full = tables.conform(early, "llm_responses")
    with monkeypatch.context() as m:
        m.setattr(tables, "save_responses", lost)
        with pytest.raises(RuntimeError):
            jobs.ingest_batch(full, 0, other, known)
    assert tables.read_table(spark, other, "brand_mentions").count() == 20
    jobs.ingest_batch(full.repartition(3), 0, other, known)
    assert tables.read_table(spark, other, "brand_mentions").count() == 20


def lost(*args, **kwargs):
    raise RuntimeError("lost")


def test_streams_and_fresh_checkpoints_leave_each_others_loads_alone(spark, root):
    """Batches of equal number from two streams, or from a checkpoint that starts again, are different loads."""
    known = prompts(spark, "p0", "p1")
    for run in ("weekA", "weekB"):
        rows = spark.createDataFrame([(run, f"p{i}", "openai", "Asana https://g2.com/a", 3, datetime(2026, 1, 1)) for i in range(2)], ANSWER)
        jobs.ingest_batch(tables.conform(rows, "llm_responses"), 0, root, known)
        jobs.ingest_batch(tables.conform(rows, "llm_responses"), 0, root, known)
    mentions, cites, answers = stored_rows(spark, root)
    assert [m[:2] for m in mentions] == [(r, p) for r in ("weekA", "weekB") for p in ("p0", "p1")] and (len(cites), answers) == (4, 4)


NAMES = ["run-2024 01%", "week*", "week1", "a:b", "a/b", "{x}[y]", "", "é😀", "..", "event_month=2026-01"]


def mention_rows(spark, run, n=3):
    return spark.createDataFrame([(run, f"p{i}", "openai", "Asana", 1, "neutral", "s", datetime(2026, 1 + i, 28)) for i in range(n)], TABLES["brand_mentions"])


def test_any_text_names_a_load(spark, root):
    runs = lambda: sorted(r.run_id for r in tables.read_table(spark, root, "brand_mentions").collect())
    for name in NAMES:
        tables.save_mentions(mention_rows(spark, name), root, load=name)
    assert runs() == sorted(NAMES * 3)
    for name in NAMES[:4]:
        tables.save_mentions(mention_rows(spark, name + "'", 2), root, load=name)
    assert runs() == sorted([n + "'" for n in NAMES[:4] * 2] + NAMES[4:] * 3)
    tables.clear_loads(spark, root, "brand_mentions", ["week*", "unknown", "a/b"])
    assert runs() == sorted([n + "'" for n in NAMES[:4] * 2 if n != "week*"] + [n for n in NAMES[4:] * 3 if n != "a/b"])


def test_named_rows_replace_their_own_loads_even_by_nothing(spark, root):
    rows = mention_rows(spark, "r1").unionAll(mention_rows(spark, "r2 %")).unionAll(mention_rows(spark, "r:3"))
    tables.append_rows(rows, root, "brand_mentions", F.col("run_id"))
    tables.append_rows(mention_rows(spark, "r:3", 1), root, "brand_mentions", F.col("run_id"), ["r1", "r:3"])
    assert sorted(r.run_id for r in tables.read_table(spark, root, "brand_mentions").collect()) == ["r2 %"] * 3 + ["r:3"]


@pytest.mark.parametrize("broken", ["publish", "rename"])
def test_a_killed_writer_leaves_the_old_load(spark, root, monkeypatch, broken):
    from echolens.sources import ledger
    tables.save_mentions(mention_rows(spark, "old"), root, load="l")
    with monkeypatch.context() as m:
        if broken == "publish":  # killed when all rows are written
            m.setattr(ledger, "publish", lost)
        else:                    # killed with the ledger's draft written
            m.setattr(ledger, "entry_path", lost)
        with pytest.raises(RuntimeError):
            tables.save_mentions(mention_rows(spark, "new"), root, load="l")
    read = lambda: {r.run_id for r in tables.read_table(spark, root, "brand_mentions").collect()}
    assert read() == {"old"}
    tables.save_mentions(mention_rows(spark, "newer"), root, load="l")
    assert read() == {"newer"}
    assert tables.sweep_loads(spark, root, "brand_mentions") == 0 and tables.sweep_loads(spark, root, "brand_mentions", older_than=0) == 6
    assert read() == {"newer"} and tables.read_table(spark, root, "brand_mentions", since="2026-02-01").count() == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_over_any_split_equal_the_vote_at_once_and_read_no_text_again(spark, root, monkeypatch):
    texts = ["Asana, Jira https://g2.com/a", "Jira https://dev.to/b", "Asana and Trello Boards https://g2.com/a"]
    rows = [(f"r{i % 2}-t{t}", f"p{i}", "openai", texts[(i + t) % 3], 3, datetime(2026, 1, 1 + t)) for i in range(4) for t in range(3)]
    known = prompts(spark, *[f"p{i}" for i in range(4)])
    whole = scratch(spark, "tables")
    tables.create_tables(spark, whole)
    jobs.ingest_batch(tables.conform(spark.createDataFrame(rows, ANSWER), "llm_responses"), 0, whole, known, 3)
    parsed = []
    parse = jobs.parse_answers
    monkeypatch.setattr(jobs, "parse_answers", lambda answers, *rest: parsed.append(answers.count()) or parse(answers, *rest))
    for batch in range(4):  # trials of a group come in different batches, and some come twice
        part = [r for k, r in enumerate(rows) if k % 4 == batch or (batch and k % 4 == batch - 1)]
        jobs.ingest_batch(tables.conform(spark.createDataFrame(part, ANSWER), "llm_responses"), 0, root, known, 3)
    assert stored_rows(spark, root) == stored_rows(spark, whole) and sum(parsed) == len(rows)
    # Answers stored without what was found in them, as by an older table, are parsed once.
    older = scratch(spark, "tables")
    tables.create_tables(spark, older)
    tables.save_responses(spark.createDataFrame(rows[:6], ANSWER), older)
    jobs.ingest_batch(tables.conform(spark.createDataFrame(rows[6:], ANSWER), "llm_responses"), 0, older, known, 3)
    assert [m[1:] for m in stored_rows(spark, older)[0] if m[1] in ("p2", "p3")] == [m[1:] for m in stored_rows(spark, whole)[0] if m[1] in ("p2", "p3")]


def test_the_latest_trials_are_looked_for_once_a_batch(spark, root, monkeypatch):
    """The vote, the times and the citations of a batch read them from storage, and no copy is left behind."""
    from echolens.session import shared_root
    kept = lambda: set(Path(shared_root(spark).removeprefix("file:")).glob("trials-*"))
    before, read, vote = kept(), [], jobs.vote_parsed
    monkeypatch.setattr(jobs, "vote_parsed", lambda trials, *args, **judging: read.append(trials._jdf.queryExecution().analyzed().toString()) or vote(trials, *args, **judging))
    rows = [answer(f"r-t{i}", "Asana https://g2.com/a") for i in range(2)]
    jobs.ingest_batch(tables.conform(spark.createDataFrame(rows, ANSWER), "llm_responses"), 0, root, prompts(spark, "p"), 2)
    assert len(read) == 1 and "max_by" not in read[0] and kept() == before
    assert [len(found) for found in stored_rows(spark, root)[:2]] == [1, 1]


def test_slots_are_looked_up_in_the_runs_met_alone(spark, root):
    tables.save_responses(spark.createDataFrame([answer(f"old{i}", "x") for i in range(5)], ANSWER), root)
    new = tables.conform(spark.createDataFrame([answer("old1", "y"), answer("new", "z")], ANSWER), "llm_responses")
    unseen = tables.unseen_slots(new, tables.read_table(spark, root, "llm_responses", runs=jobs._runs(new)))
    assert [r.run_id for r in unseen.collect()] == ["new"]
    assert "part_key" in partition_filters(tables.read_table(spark, root, "llm_responses", runs=["new"]).select("run_id"))


@pytest.mark.parametrize("n_runs", [1, 2])
def test_a_run_spread_over_micro_batches_is_kept_whole(spark, root, tmp_path, n_runs):
    """One run in four files, one file per trigger, with two more files added between two starts."""
    rows = spark.createDataFrame([(f"r-t{i % 2}", f"p{i // 2}", "openai", "Asana https://g2.com/a", 3, datetime(2026, 1, 1)) for i in range(40)], ANSWER)
    known = prompts(spark, *[f"p{i}" for i in range(20)])
    for part in range(2):
        raw_runs.write_raw_run(rows.filter((F.crc32(F.concat("run_id", "prompt_id").cast("binary")) % 2) == part).repartition(2), str(tmp_path / "raw" / f"part{part}"))
        run_stream(jobs.ingest_runs(spark, str(tmp_path / "raw"), root, known, str(tmp_path / "cp"), n_runs, max_files=1))
    mentions, cites, answers = stored_rows(spark, root)
    assert answers == 40
    if n_runs == 1:
        assert len(mentions) == len(cites) == 40
    else:
        assert [m[1:] for m in mentions] == sorted((f"p{i}", "openai", "Asana", 1) for i in range(20)) and len(cites) == 20


def test_ingest_leaves_no_copies_behind(spark, root):
    from pathlib import Path

    from echolens.session import shared_root
    kept = lambda: {p.name for p in Path(shared_root(spark).removeprefix("file:")).glob("ingest-*")} | {p.name for p in Path(shared_root(spark).removeprefix("file:")).glob("*-merged-*")}
    before = kept()
    jobs.ingest_batch(tables.conform(spark.createDataFrame([answer("r", "Asana")], ANSWER), "llm_responses"), 7, root, prompts(spark, "p"))
    assert kept() == before


def left(spark, pattern):
    from echolens.session import shared_root
    return set(Path(shared_root(spark).removeprefix("file:")).glob(pattern))


@pytest.mark.parametrize("n_runs", [1, 2])
def test_new_answers_are_compared_once_and_leave_no_copies(spark, root, monkeypatch, n_runs):
    """The upsert of answers that are known to be new looks at their slots; what was found in them goes with the batch."""
    compared, latest, before = [], tables.latest_rows, left(spark, "parsed-*") | left(spark, "voted-*") | left(spark, "answers-*")
    monkeypatch.setattr(tables, "latest_rows", lambda rows, *args: compared.append("response_text" in rows.columns) or latest(rows, *args))
    rows = [answer(f"r-t{i}", "Asana https://g2.com/a") for i in range(2)]
    jobs.ingest_batch(tables.conform(spark.createDataFrame(rows, ANSWER), "llm_responses"), 0, root, prompts(spark, "p"), n_runs)
    assert sum(compared) == 1 and left(spark, "parsed-*") | left(spark, "voted-*") | left(spark, "answers-*") == before
    # Stored slots among new ones: those alone leave the batch.
    rows.append(answer("r-t2", "Jira"))
    jobs.ingest_batch(tables.conform(spark.createDataFrame(rows, ANSWER), "llm_responses"), 1, root, prompts(spark, "p"), n_runs)
    assert sorted(r.run_id for r in tables.read_table(spark, root, "llm_responses").collect()) == ["r-t0", "r-t1", "r-t2"]


def test_kept_answers_are_upserted_like_any(spark, root):
    """With slots that come twice, are stored or null, whether or not the rows are known to be on storage."""
    other = scratch(spark, "tables")
    tables.create_tables(spark, other)
    loads = [[answer("r1", "a"), answer(None, "b")], [answer("r2", "c", 1), answer("r2", "d", 2)], [answer("r1", "e"), answer("r3", "f"), answer(None, "g")]]
    for load in loads:
        for place, kept in ((root, True), (other, False)):
            tables.save_responses(spark.createDataFrame(load, ANSWER), place, kept=kept)
    read = lambda place: sorted((r.run_id or "", r.response_text) for r in tables.read_table(spark, place, "llm_responses").collect())
    assert read(root) == read(other) == [("", "g"), ("r1", "e"), ("r2", "d"), ("r3", "f")]


def test_the_text_that_orders_is_shuffled_once(spark):
    rows = spark.createDataFrame([answer("r", "x"), answer("r", "y")], ANSWER)
    newest = tables.latest_rows(rows, ["run_id", "prompt_id", "provider"], ["created_at", "response_text"])
    assert [r.response_text for r in newest.collect()] == ["y"] and newest.columns == rows.columns
    assert "max_by" not in plan_of(newest)  # which holds the value and what orders it apart


def test_a_batch_run_leaves_no_texts_behind(spark, root):
    tables.upsert_prompts(prompts(spark, "a"), root)
    before = left(spark, "batch-*/answers")
    done = run_batch(spark, root, "base", answering(), n_runs=2)
    assert left(spark, "batch-*/answers") == before and done.mentions.count() and done.citations.count() and done.discovered.count()


def test_terms_of_stored_prompts_are_not_broadcast_by_the_size_of_their_files(spark, root, monkeypatch):
    from echolens.plans import batch
    tables.upsert_prompts(prompts(spark, "a"), root)
    plans, analyse = [], batch.analyze_responses
    monkeypatch.setattr(batch, "analyze_responses", lambda rows, known: plans.append(plan_of(batch_parse(rows, known))) or analyse(rows, known))
    run_batch(spark, root, "base", answering())
    assert len(plans) == 1 and "SortMergeJoin [prompt_id" in plans[0] and "BroadcastHashJoin" not in plans[0]


def batch_parse(rows, known):
    from echolens.operators.analysis import parse_answers
    return parse_answers(rows.drop("created_at"), known)


def test_raw_files_hold_so_many_answers_at_most(spark, monkeypatch):
    from echolens.plans import registry
    written = []

    def count(rows, path):
        written.append(rows.rdd.getNumPartitions())
        raise RuntimeError("counted")

    monkeypatch.setattr(registry, "FILE_ROWS", 10, raising=False)
    monkeypatch.setattr(registry.raw_runs, "write_raw_run", count)
    with pytest.raises(RuntimeError):
        registry.ingest_runs(spark, "/root/testdata/sf0.001")
    assert written == [24]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from echolens.session import shared_root
    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(RuntimeError):
        shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))))


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    schema = "brand string, position int, sentiment string, created_at timestamp"
    path = str(tmp_path / "in")
    def load(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        run_stream(jobs.daily_metrics_stream(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
                   .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True))
    load(("A", 1, "positive", datetime(2026, 1, 1, 5)), ("A", 2, "negative", datetime(2026, 1, 1, 9)))
    load(("A", 1, "neutral", datetime(2026, 1, 20)))
    load(("A", 9, "neutral", datetime(2026, 1, 1, 7)), ("A", 1, "neutral", datetime(2026, 2, 20)))
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("date").collect()
    assert [(str(r.date), r.mention_count, r.avg_position, r.sentiment_score) for r in rows] == [("2026-01-01", 2, 1.5, 0.0), ("2026-01-20", 1, 1.0, 0.0)]


def test_alert_stream_follows_the_tables(spark, root, tmp_path):
    tables.upsert_prompts(prompts(spark, "p"), root)
    tables.save_responses(spark.createDataFrame([answer(f"r{i}", "x") for i in range(10)], ANSWER), root, mode="append")
    tables.save_mentions(spark.createDataFrame([("r0", "p", "openai", "Asana", 1, "neutral", "s", datetime(2026, 1, 1))], TABLES["brand_mentions"]), root)
    stream = spark.readStream.schema(TABLES["llm_responses"]).option("recursiveFileLookup", True).parquet(tables.table_path(root, "llm_responses"))
    run_stream(jobs.alert_stream(stream, root, str(tmp_path / "alerts"), str(tmp_path / "cp")))
    (row,) = spark.read.parquet(str(tmp_path / "alerts")).collect()
    assert (row.brand, row.current, row.reason) == ("Asana", 10.0, "below threshold")


def test_alerts_of_a_batch_broadcast_no_prompts_and_sum_days_once(spark, root, tmp_path, monkeypatch):
    tables.upsert_prompts(prompts(spark, *[f"p{i}" for i in range(5)]), root)
    rows = [(*answer("r", "Asana", day, f"p{day}"), "Asana", 1, "positive") for day in range(1, 5)]
    said = spark.createDataFrame(rows, f"{ANSWER}, brand string, position int, sentiment string")
    for load in range(2):
        tables.save_mentions(said.drop("response_text", "latency_ms"), root, load=f"load{load}")
    tables.save_responses(spark.createDataFrame([row[:6] for row in rows], ANSWER), root)
    seen, alerts = [], jobs.visibility_alerts
    monkeypatch.setattr(jobs, "visibility_alerts", lambda *given: seen.append((given, alerts(*given))) or seen[-1][1])
    jobs.alert_batch(tables.read_table(spark, root, "llm_responses"), 0, root, str(tmp_path / "out"))
    (days, responses, scope), found = seen[0]
    assert "Aggregate" not in days._jdf.queryExecution().optimizedPlan().toString() and days.count() == 8
    # Answers, mentions, slots and the previous day each meet the prompts; only those of the batch may be few enough to broadcast.
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin [prompt_id") >= 4
    assert found.collect() == alerts(tables.read_days(spark, root), responses, tables.read_table(spark, root, "prompts")).collect()


def test_alerts_from_the_latest_months_equal_those_from_all(spark, root):
    from echolens.operators.alerts import visibility_alerts
    days = [datetime(2026, 1, 5), datetime(2026, 3, 30), datetime(2026, 5, 1), datetime(2026, 5, 1)]
    said = [(f"r{i}", "p", "openai", brand, 1, "neutral", "s", day) for i, day in enumerate(days) for brand in ("Asana", "Jira")[: 1 + i % 2]]
    tables.save_mentions(spark.createDataFrame(said, TABLES["brand_mentions"]), root)
    tables.save_responses(spark.createDataFrame([answer(f"r{i}", "x") for i in range(40)], ANSWER), root)
    tables.upsert_prompts(prompts(spark, "p"), root)
    recent = tables.latest_days(spark, root, "brand_mentions")
    assert recent.count() == 5  # March to May
    all_rows = [tables.read_table(spark, root, t) for t in ("brand_mentions", "llm_responses", "prompts")]
    assert visibility_alerts(*all_rows, recent=recent).collect() == visibility_alerts(*all_rows).collect()


def test_daily_sums_equal_a_recount_after_any_order_of_loads(spark, root):
    from echolens.operators import metrics
    from echolens.operators.alerts import visibility_alerts
    random = Random(3)
    def load(name, n):
        rows = [(f"r{random.randrange(9)}", random.choice(["p", "q"]), "openai", random.choice(["Asana", "Jira", None]), random.choice([1, 2, 7, None]),
                 random.choice(["positive", "negative", "neutral", None]), "s", random.choice([None, *[datetime(2026, m, d, 23) for m in (1, 2) for d in (1, 2, 28)]])) for _ in range(n)]
        tables.save_mentions(spark.createDataFrame(rows, TABLES["brand_mentions"]), root, load=name)
    key = lambda df: sorted(map(str, df.collect()))
    def compare():
        for bounds in ({}, {"since": "2026-01-28", "until": "2026-02-01"}):
            rows, days = tables.read_table(spark, root, "brand_mentions", **bounds), tables.read_days(spark, root, **bounds)
            assert key(days) == key(metrics.daily_sums(rows).select(*days.columns)) and days.columns == metrics.daily_sums(rows).columns
        return rows
    compare()
    for name, n in (("x", 40), ("y", 30), ("x", 25), (None, 10), ("y", 0)):
        load(name, n)
        compare()
    tables.clear_loads(spark, root, "brand_mentions", ["x"])
    load("late", 20)
    compare()
    tables.sweep_loads(spark, root, "brand_mentions", older_than=0)
    compare()
    tables.save_responses(spark.createDataFrame([answer(f"r{i}", "x", 1 + i, p) for i in range(12) for p in "pq"], ANSWER), root)
    tables.upsert_prompts(prompts(spark, "p", "q"), root)
    rows, days = tables.read_table(spark, root, "brand_mentions"), tables.read_days(spark, root)
    answers, known = (tables.read_table(spark, root, t) for t in ("llm_responses", "prompts"))
    for mode in ("compat", "slots"):
        assert visibility_alerts(rows, answers, known, mode=mode).collect() == visibility_alerts(days, answers, known, mode=mode).collect()
    assert metrics.visibility_summary(rows, answers).collect() == metrics.visibility_summary(days, answers).collect()
    for trend in (metrics.position_trend, metrics.sentiment_trend):
        assert trend(rows).collect() == trend(days).collect() and trend(rows, "Asana").collect() == trend(days, "Asana").collect()
    assert all(f"/{tables.DAYS}/" in f or "/loads/" in f for f in days.inputFiles())


def test_a_writer_lost_before_it_publishes_leaves_the_old_sums(spark, root, monkeypatch):
    tables.save_mentions(mention_rows(spark, "old"), root, load="l")
    before = sorted(tables.read_days(spark, root).collect())
    def lost(*_):
        raise OSError("lost")
    with monkeypatch.context() as patch:
        patch.setattr(tables.ledger, "publish", lost)
        with pytest.raises(OSError):
            tables.save_mentions(mention_rows(spark, "new").unionByName(mention_rows(spark, "more")), root, load="l")
    assert sorted(tables.read_days(spark, root).collect()) == before
