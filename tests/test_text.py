"""Brand detection, citations, domains, names, sentiment."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from echolens.functions.text import fold
from echolens.operators import answers, citations, entities, mentions, sentiment

FULL = "run_id string, prompt_id string, provider string, response_text string, error string"


def detect(spark, text, brands):
    rows = spark.createDataFrame([("r", "p", "openai", text, None)], FULL)
    prompts = spark.createDataFrame([("p", json.dumps(brands))], "prompt_id string, target_brands string")
    return mentions.detect_brands(rows, prompts).orderBy("position").collect()


@pytest.mark.parametrize("text, brands, expected", [
    ("Our choice for launch week was Asana this year.", ["Asana"], ["Asana"]),
    ("asana once, then ASANA again", ["Asana"], ["Asana"]),
    ("a nonlinear model", ["Linear"], []),
    ("Tickets live in Linear now.", ["Linear"], ["Linear"]),
    ("First Jira; second Asana; third Linear", ["Asana", "Jira", "Linear"], ["Jira", "Asana", "Linear"]),
    ("no product named", ["Asana"], []),
    ("Asana only", [], []),
    ("", ["Asana"], []),
    ("Boards on Monday.com help", ["Monday.com"], ["Monday.com"]),
    ("MondayXcom", ["Monday.com"], []),
    ("Notion AI beats Notion", ["Notion AI", "Notion"], ["Notion AI", "Notion"]),
    ("Notion AI beats Notion", ["Notion", "Notion AI"], ["Notion", "Notion AI"]),
    ("éLinear or Linearé or Linear_x", ["Linear"], []),
    ("école and ÉCOLE", ["École"], ["École"]),
    ("Jira, jira", ["JIRA", "Jira"], ["JIRA"]),
    ("C++ and C#", ["C++"], []),
    ("xC++y", ["++"], ["++"]),
])
def test_detected_brands(spark, text, brands, expected):
    found = detect(spark, text, brands)
    assert [m.brand for m in found] == expected
    assert [m.position for m in found] == list(range(1, len(expected) + 1))


def test_offset_counts_characters(spark):
    text = "😀 Start. Then Asana appears."
    (found,) = detect(spark, text, ["Asana"])
    assert text[found.char_offset:found.char_offset + 5] == "Asana"
    assert found.snippet == text


def test_snippet_is_bounded_and_stripped(spark):
    (found,) = detect(spark, "x" * 200 + " Asana stands there," + " " * 150, ["Asana"])
    assert "Asana" in found.snippet and len(found.snippet) <= 215 and found.snippet == found.snippet.strip()


def brute(text, brands):
    seen, hits = set(), []
    for i, brand in enumerate(brands):
        m = re.search(r"\b" + re.escape(brand) + r"\b", text, re.I)
        if m and brand.lower() not in seen:
            seen.add(brand.lower())
            hits.append((m.start(), i, brand))
    return [(b, p + 1, at) for p, (at, _, b) in enumerate(sorted(hits))]


@pytest.mark.parametrize("n_brands", [5, 100])
def test_detection_equals_brute_force(spark, n_brands):
    """Both prefilters: by substring for short lists, by words for long ones."""
    rng = random.Random(7)
    words = ["asana", "Jira", "Notion", "AI", "monday.com", "c++", "é", "zoho", "CRM", "x_y", "-", "Linear", "linearly", "İx", "straße"]
    brands = list(dict.fromkeys(" ".join(rng.sample(words, rng.randint(1, 2))) for _ in range(400)))[:n_brands]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice([".", "!", ""]) for _ in range(150)]
    rows = spark.createDataFrame([(str(i), "p", "x", t, None) for i, t in enumerate(texts)], FULL)
    prompts = spark.createDataFrame([("p", json.dumps(brands))], "prompt_id string, target_brands string")
    got = {}
    for m in mentions.detect_brands(rows, prompts).collect():
        got.setdefault(int(m.run_id), []).append((m.brand, m.position, m.char_offset))
    assert {i: sorted(v, key=lambda x: x[1]) for i, v in got.items()} == {i: brute(t, brands) for i, t in enumerate(texts) if brute(t, brands)}


def test_fold_joins_what_the_pattern_joins(spark):
    """Any two characters the case-insensitive pattern treats as equal fold to the same text."""
    pairs = [("İ", "i"), ("K", "k"), ("Å", "å"), ("Ω", "ω"), ("ẞ", "ß"), ("ϴ", "θ"), ("ſ", "s"), ("ς", "σ"), ("ı", "i"), ("É", "é")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        F.rlike("a", F.concat(F.lit("(?iu)^"), "b", F.lit("$"))).alias("same"), (fold(F.col("a")) == fold(F.col("b"))).alias("folded")).collect()
    assert all(r.folded for r in rows if r.same) and sum(r.same for r in rows) >= 8


def cited(spark, text, **options):
    rows = spark.createDataFrame([("r", "p", "openai", text, None)], FULL)
    return [(r.url, r.domain, r.domain_type) for r in citations.extract_citations(rows, **options).orderBy("url_index").collect()]


@pytest.mark.parametrize("text, expected", [
    ("Read https://www.g2.com/pm.", [("https://www.g2.com/pm", "g2.com", "review_site")]),
    ("(https://capterra.com/pm)", [("https://capterra.com/pm", "capterra.com", "review_site")]),
    ("https://g2.com/a https://g2.com/a", [("https://g2.com/a", "g2.com", "review_site")]),
    ("https://a.com/x and", [("https://a.com/x", "a.com", "brand_owned")]),
    ("plain words", []),
    ("http://stackoverflow.com/q/1 or https://dev.to/p",
     [("http://stackoverflow.com/q/1", "stackoverflow.com", "developer"), ("https://dev.to/p", "dev.to", "developer")]),
    ("https://wired.com/a", [("https://wired.com/a", "ired.com", "brand_owned")]),
    ("https://[x", [("https://[x", "[x", "other")]),
    ("HTTPS://User@Host.example.org:8080?q=1", [("HTTPS://User@Host.example.org:8080?q=1", "user@host.example.org:8080", "other")]),
])
def test_citations(spark, text, expected):
    assert cited(spark, text) == expected


def test_strict_www_keeps_other_letters(spark):
    assert cited(spark, "https://www.wired.com/a", strict_www=True) == [("https://www.wired.com/a", "wired.com", "tech_media")]


@pytest.mark.parametrize("domain, kind", [
    ("reddit.com", "community"), ("stackoverflow.com", "developer"), ("g2.com", "review_site"), ("capterra.com", "review_site"),
    ("techcrunch.com", "tech_media"), ("forbes.com", "business_media"), ("medium.com", "blog_platform"), ("youtube.com", "video"),
    ("wikipedia.org", "reference"), ("linkedin.com", "professional_social"), ("twitter.com", "social"), ("asana.com", "brand_owned"),
    ("www.notion.so", "brand_owned"), ("some.unknown.site.xyz", "other"), ("netflix.com", "social"),
])
def test_domain_classes(spark, domain, kind):
    assert citations.classify_domains(spark.createDataFrame([(domain,)], "domain string")).first().domain_type == kind


def test_valid_responses_and_summary(spark):
    rows = spark.createDataFrame([("1", "p", "x", "text", None), ("2", "p", "x", "text", ""), ("3", "p", "x", "", None),
                                  ("4", "p", "x", None, None), ("5", "p", "x", "text", "timeout")], FULL)
    assert [r.run_id for r in answers.valid_responses(rows).orderBy("run_id").collect()] == ["1", "2"]
    states = answers.run_summary(rows.withColumn("latency_ms", F.lit(1))).orderBy("run_id").collect()
    assert [(s.chars, s.status) for s in states] == [(4, "OK"), (4, "OK"), (0, "OK"), (0, "OK"), (4, "ERR")]


def test_trial_numbers(spark):
    rows = spark.createDataFrame([("base-t0",), ("my-test-t12",), ("my-test",), ("plain",)], "run_id string")
    got = rows.select("run_id", answers.base_run().alias("b"), answers.trial_number().alias("t")).collect()
    assert [(r.b, r.t) for r in got] == [("base", 0), ("my-test", 12), ("my-test", 0), ("plain", 0)]


def test_discovered_names(spark):
    rows = spark.createDataFrame([("1", "p", "x", "Acme Corp and Asana met Acme Corp", None), ("2", "p", "x", "Then Acme Corp left", None)], FULL)
    known = spark.createDataFrame([("ASANA",)], "brand string")
    assert {(r.entity, r.answers) for r in entities.discover_entities(rows, known).collect()} == {("Acme Corp", 1), ("Then Acme Corp", 1)}


@pytest.mark.parametrize("reply, expected", [
    ('{"sentiment": "positive", "reason": "praised"}', ("positive", "praised")), ('{"sentiment": "negative"}', ("negative", "")),
    ('{"reason": "x"}', ("neutral", "x")), ("", ("neutral", "")), (None, ("neutral", "")), ("{}", ("neutral", "")),
    ('{"sentiment": "great"}', ("neutral", "judge_error")), ('{"sentiment": null}', ("neutral", "judge_error")),
    ("[1]", ("neutral", "judge_error")), ("not json", ("neutral", "judge_error")),
])
def test_judge_replies(spark, reply, expected):
    row = spark.createDataFrame([(reply,)], "reply string").select(sentiment.parse_judgement(F.col("reply")).alias("v")).first().v
    assert (row.sentiment, row.reason) == expected


def test_lexicon_and_client_judges(spark):
    rows = spark.createDataFrame([("Asana", "Asana is great and flexible"), ("Jira", "slow Jira"), ("Linear", "Linear exists")], "brand string, snippet string")
    assert [r.sentiment for r in sentiment.judge_mentions(rows).collect()] == ["positive", "negative", "neutral"]

    def client():
        def call(brand, snippet):
            if brand == "Jira":
                raise TimeoutError("down")
            return json.dumps({"sentiment": "positive", "reason": brand})
        return call

    judged = {r.brand: (r.sentiment, r.reason) for r in sentiment.judge_with_client(rows, client, 2).collect()}
    assert judged == {"Asana": ("positive", "Asana"), "Jira": ("neutral", "judge_error"), "Linear": ("positive", "Linear")}


def test_long_lists_and_marks_take_the_same_path(spark):
    """A list of any length finds what a list of one finds, over combining marks and letters of special case."""
    texts = ["Foo\u0345 bar", "STRASSE straße", "İzmir izmir", "ſoft Soft", "x" * 50 + " Foo."]
    brands = ["Foo", "straße", "İzmir", "soft"]
    fill = [f"Filler{i}" for i in range(120)]
    rows = spark.createDataFrame([("r", f"{kind}{i}", "openai", t, None) for i, t in enumerate(texts) for kind in "sl"], FULL)
    lists = spark.createDataFrame([(f"{kind}{i}", json.dumps(brands + (fill if kind == "l" else []))) for i in range(len(texts)) for kind in "sl"], "prompt_id string, target_brands string")
    found = {}
    for m in mentions.detect_brands(rows, lists).collect():
        found.setdefault(m.prompt_id[0], set()).add((m.prompt_id[1:], m.brand, m.char_offset))
    assert found["s"] == found["l"] and ("0", "Foo", 0) in found["s"]
