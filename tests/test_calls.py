"""Calls from inside a task: order, width, retries, time limit, and the three operators that make them."""

import threading
import time

from pyspark.sql import functions as F

from echolens.operators import fanout, numbering, requests, sentiment
from echolens.operators.calls import ask_all


def test_replies_keep_their_order_and_width_is_kept_to():
    busy, most, lock = 0, 0, threading.Lock()

    def call(i):
        nonlocal busy, most
        with lock:
            busy += 1
            most = max(most, busy)
        time.sleep(0.02 * (1 + i % 3))
        with lock:
            busy -= 1
        return i * i

    began = time.monotonic()
    replies = ask_all(call, [(i,) for i in range(60)], width=12)
    assert [r.value for r in replies] == [i * i for i in range(60)] and 6 <= most <= 12
    assert time.monotonic() - began < 1.2 and all(r.error is None and r.seconds >= 0.02 for r in replies)
    assert ask_all(call, [], width=3) == []


def test_failures_are_tried_again_within_the_budget():
    tries = {}

    def call(name, needed):
        tries[name] = tries.get(name, 0) + 1
        if tries[name] < needed:
            raise ValueError(f"{name} failed")
        return name

    for width in (1, 4):
        tries.clear()
        replies = ask_all(call, [("a", 1), ("b", 3), ("c", 4)], width=width, retries=2)
        assert [(r.value, r.error) for r in replies] == [("a", None), ("b", None), (None, "c failed")] and tries == {"a": 1, "b": 3, "c": 3}


def test_a_hanging_call_is_an_error_and_holds_nobody_up():
    def call(i):
        time.sleep(60 if i == 3 else 0.01)
        return i

    for width in (1, 2):
        began = time.monotonic()
        replies = ask_all(call, [(i,) for i in range(8)], width=width, limit=0.4)
        assert time.monotonic() - began < 2
        assert [r.value for r in replies] == [0, 1, 2, None, 4, 5, 6, 7] and replies[3].error == "no answer within 0.4 s"


def test_operators_ask_several_at_a_time(spark):
    n = 100
    plan = spark.createDataFrame([("r", f"p{i:03d}", f"question {i}", "openai") for i in range(n)], "run_id string, prompt_id string, prompt_text string, provider string")

    def client():
        began = time.monotonic()

        def call(provider, prompt):
            time.sleep(30 if prompt == "question 7" else 0.1)
            return f"{time.monotonic() - began:.3f}", f"{provider}: {prompt}"
        return call

    rows = {r.prompt_id: r for r in requests.collect_responses(plan, client, 1, width=10, limit=1.0).collect()}
    assert rows["p007"].error == "no answer within 1 s" and rows["p007"].response_text == "" and 1000 <= rows["p007"].latency_ms < 5000
    answered = [r for p, r in rows.items() if p != "p007"]
    # The model column tells when a call ended: one task, all within two seconds of its start.
    assert len(answered) == n - 1 and all(r.response_text == f"openai: {r.prompt_text}" and float(r.model) < 2 for r in answered)

    mentions = spark.createDataFrame([(f"b{i}", f"text {i}") for i in range(20)], "brand string, snippet string")

    def judge():
        def call(brand, text):
            if brand == "b3":
                raise OSError("gone")
            return '{"sentiment": "positive", "reason": "%s"}' % text
        return call

    found = {r.brand: r for r in sentiment.judge_with_client(mentions, judge, 1, width=5, limit=5).collect()}
    assert (found["b3"].sentiment, found["b3"].reason) == ("neutral", "judge_error") and found["b4"].reason == "text 4" and len(found) == 20

    asked = spark.createDataFrame([(str(i), "crm", f"best {i}", ["X"]) for i in range(20)], "id string, category string, original string, target_brands array<string>")

    def searcher():
        def call(prompt):
            if prompt == "best 5":
                raise OSError("gone")
            return [prompt, "more"], "text"
        return call

    records = {r.id: r for r in fanout.collect_fanout(asked, searcher, 1, width=5, retries=1).collect()}
    assert (records["5"].error, records["5"].n_queries) == ("gone", 0) and records["6"].fanout_queries == ["best 6", "more"]


def test_slices_of_a_key_are_found_without_comparing_every_cut(spark):
    """Numbers are right over many slices, and a row is compared with blocks of the cuts, not with all of them at once."""
    rows = spark.range(3_000).select((F.col("id") * 7 % 3_000).alias("id"))
    numbered = numbering.number_rows(rows, ["id"], slices=90)
    assert numbered.filter("row_number <> id + 1").isEmpty() and numbered.count() == 3_000
    text = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("filter(") > 2  # a list of cuts per block
