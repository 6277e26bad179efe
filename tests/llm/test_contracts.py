"""The queries against plain Python, on odd rows, on empty tables and on the smallest data set."""

import zlib
from pathlib import Path

import pytest

from echolens.llm import queries as q
from tests.llm import brute, fixtures

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return fixtures.write_tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory, odd):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def sets(request):
    return [request.getfixturevalue("odd")] + ([SF] if Path(SF).exists() else [])


def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def multiset(rows, columns):
    return sorted([tuple(r[c] for c in columns) for r in rows], key=repr)


def compare(spark, sf, query, expected):
    """Every document row has the counterpart's values; ids may repeat."""
    got = query(spark, sf).collect()
    want = [{"doc_id": d} | expected(t) for d, t in documents(spark, sf)]
    assert multiset(got, list(want[0])) == multiset(want, list(want[0]))
    return got


def test_chat(spark, request):
    for sf in sets(request):
        rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
        by = {}
        for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or "")):
            by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        by[-1] = [("user", q.CONTROL_TEXT), ("assistant", q.CONTROL_TEXT)]
        want = [{"conv_id": c} | brute.conversation(t) for c, t in by.items()]
        got = q.op1_chat_formatting(spark, sf).collect()
        assert multiset(got, list(want[0])) == multiset(want, list(want[0]))


def test_secrets(spark, request):
    for sf in sets(request):
        got = compare(spark, sf, q.op6_secret_scan, brute.secrets)
        assert all(r["spans"].count(":") == 2 * len(r["spans"].split(",")) for r in got if r["spans"])


def test_personal_data(spark, request):
    for sf in sets(request):
        compare(spark, sf, q.op10_pii, brute.personal)


def test_quality_rules(spark, request):
    for sf in sets(request):
        got = compare(spark, sf, q.op9_quality_rules, brute.quality)
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_decontamination(spark, request):
    for sf in sets(request):
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        if sf == SF:
            compare(spark, sf, q.op7_decontamination, lambda t: brute.hits(t, items))
        else:
            named = [(i, t) for i, t in items if i is not None]
            unnamed = [(i, t) for i, t in items if i is None]
            def want(t):
                both, ids = brute.hits(t, named + unnamed), brute.hits(t, named)
                return both | {k: ids[k] for k in ("n_items", "items_sha256")}
            compare(spark, sf, q.op7_decontamination, want)


def test_mixing(spark, request):
    for sf in sets(request):
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
        sizes = {}
        for r in rows:
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
        target = brute.mix_targets(sizes)
        first, again = (q.op5_mixing(spark, sf).collect() for _ in range(2))
        assert sorted(map(repr, first)) == sorted(map(repr, again))
        assert multiset(first, ["doc_id", "size"]) == sorted([(r["doc_id"], len(brute.WORD.findall(r["text"] or ""))) for r in rows], key=repr)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in first)
        for source in sizes:
            own = [r for r in first if r["source"] == source]
            assert all(r["source_size"] == sizes[source] and abs(r["target"] - target[source]) <= 1e-6 * max(1, target[source]) for r in own)
            largest = max(r["size"] for r in own)
            assert abs(sum(r["taken"] for r in own) - target[source]) <= 1.5 * largest + 1


def test_near_duplicates(spark, request):
    for sf in sets(request):
        rows = documents(spark, sf)
        got = q.op3_minhash_near_dedup(spark, sf).collect()
        assert sorted((r["doc_id"] for r in got), key=repr) == sorted((d for d, _ in rows), key=repr)
        if sf == SF:
            assert {r["doc_id"]: r["class_id"] for r in got} == brute.near_classes(rows, brute.shingle_set)
        else:
            class_of = {r["doc_id"]: r["class_id"] for r in got}
            assert class_of[6] == class_of[7] == class_of[8] == class_of[9] == 6 and class_of[11] == 11 and class_of[1] == 1 and class_of[0] == 0


def test_jaccard_join(spark, request):
    for sf in sets(request):
        got = [tuple(r) for r in q.op13_ngram_jaccard_join(spark, sf).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute.joined_components(documents(spark, sf))))


def test_merkle(spark, request):
    for sf in sets(request):
        rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
        got = q.op11_merkle_manifest(spark, sf)
        assert got.schema["doc_id"].dataType.simpleString() == "bigint"
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute.merkle([tuple(r) for r in rows])))


def test_vector_codes(spark, request):
    for sf in sets(request):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
        got = [tuple(r) for r in q.op12_vector_codes(spark, sf).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute.vector_codes([tuple(r) for r in rows])))


@needs_data
def test_held_out_scores(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = q.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in known) >= 0.97 * len(known)
    got = q.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]]["quality"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    toxic = {r["doc_id"]: r for r in q.op8_toxicity(spark, "/root/testdata/sf0.01").collect()}
    pairs = [(toxic[d]["toxic"], labels[d]["toxic"]) for d in labels]
    assert sum(p for p, y in pairs if y == 0) <= 0.02 * sum(y == 0 for _, y in pairs)
    assert sum(p for p, y in pairs if y == 1) >= 0.7 * sum(y == 1 for _, y in pairs)


def test_scores_of_odd_rows(spark, odd):
    n = len(documents(spark, odd))
    for query in (q.op2_quality_classifier, q.op4_language_id, q.op8_toxicity):
        assert query(spark, odd).count() == n
    found = {r["doc_id"]: r for r in q.op4_language_id(spark, odd).collect()}
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == found[35]["lang_pred"] == "und" and found[0]["score"] == 0


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, empty, name):
    rows = q.queries()[name](spark, empty).collect()
    assert [r["conv_id"] for r in rows] == [-1] if name.startswith("op1_") else not rows
