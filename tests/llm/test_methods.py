"""What the contracts don't say: budgets, sampling, thresholds, offsets, and the trained models' own properties."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echolens.llm import chat, codes, compression, decontaminate, langid, linking, merkle, mixing, neardup, pii, rules, samples, secrets, shinglejoin, toxicity
from echolens.llm.exprs import find_spans, normal_tail, running_sums
from echolens.llm.words import shingles, slices, split_words
from tests.llm import brute, fixtures


def test_words_and_shingles_of_a_batch():
    texts = [t for t in fixtures.odd_texts()]
    seen, at = {}, 0
    for part in slices(pa.array(texts), most_bytes=5_000):
        words = split_words(part)
        assert words.counts.tolist() == [len(brute.plain_words(t)) for t in texts[at:at + len(part)]]
        hashes, row = shingles(words)
        for i in range(len(part)):
            want, got = brute.shingle_set(texts[at + i]), set(hashes[row == i].tolist())
            assert len(want) == len(got)
            seen.setdefault(at + i, got)
        for h, w in zip(words.hash.tolist(), [w for t in texts[at:at + len(part)] for w in brute.plain_words(t)]):
            assert seen.setdefault(("w", w), h) == h
        at += len(part)
    assert seen[6] == seen[8]  # upper case


def test_tiny_batches_have_shingles():
    for n in range(7):
        words = split_words(pa.array([" ".join("abcdef"[:n])]).cast(pa.large_string()))
        assert len(shingles(words)[0]) == (0 if n == 0 else max(1, n - 4))


def test_tiny_partitions_are_deduplicated(spark):
    rows = [(i, " ".join("abcdefg"[:1 + i % 5])) for i in range(10)] + [(10, None), (11, "")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(12)).collect()}
    assert got == {i: i % 5 for i in range(10)} | {10: 10, 11: 11}


def edited(rng, base, edits):
    ws = list(base)
    for k in rng.sample(range(len(ws)), edits):
        ws[k] = f"e{rng.randrange(10**9)}"
    return ws


def copies_and_templates(rng, copies=300, template=120):
    """A hot group of near copies with zero to ten edits each, texts that are four fifths a template or a little more, a chain, and others."""
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    base, shared = fresh(150), fresh(200)
    texts = [edited(rng, base, rng.randrange(11)) for _ in range(copies)] + [base, base]
    texts += [shared + fresh(rng.randrange(10, 60)) for _ in range(template)] + [shared[:rng.randrange(150, 200)] for _ in range(20)]
    step = fresh(100)
    for _ in range(30):
        step = edited(rng, step, 2)
        texts.append(step)
    texts += [base[:40] + fresh(100) for _ in range(60)] + [fresh(n) for n in range(1, 40)]
    rng.shuffle(texts)
    return [(i, " ".join(ws)) for i, ws in enumerate(texts)]


def test_joined_components_of_hot_groups(spark):
    rows = copies_and_templates(random.Random(14))
    got = shinglejoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.joined_components(rows))


def test_heads_share_enough_and_entries_bound_the_overlap():
    """Every pair of the threshold passes each filter, by way of its first common element."""
    rng = random.Random(15)
    texts = [t for _, t in copies_and_templates(rng, 60, 40)]
    sets = [brute.spaced_shingles(t) for t in texts]
    column = pa.array(texts).cast(pa.large_string())
    h, counts = shinglejoin.distinct_shingles(column)
    assert counts.tolist() == [len(s) for s in sets]
    ends = np.cumsum(counts)
    own = [h[e - c:e] for e, c in zip(ends, counts)]
    heads = [set(x[:shinglejoin.head(len(x))].tolist()) for x in own]
    seen = {}
    for x in own:
        for v in x.tolist():
            seen[v] = seen.get(v, 0) + 1
    ordered = [sorted(x.tolist(), key=lambda v: (seen[v], v)) for x in own]
    flat = np.array([v for x in ordered for v in x], np.uint64)
    at, row, rest, words = linking.prefix_entries(flat, np.ones(len(flat)), counts, counts.astype(float), 0.8)
    entries = [{} for _ in texts]
    for i, r, left, s in zip(flat[at].tolist(), row.tolist(), rest.tolist(), words.tolist()):
        entries[r][i] = (left, [(w >> 16 * k & 65535) * int(counts[r]) / 65535 for w in s for k in range(4)])
    met = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                met += 1
                assert len(heads[i] & heads[j]) >= min(shinglejoin.least_shared(len(own[i])), shinglejoin.least_shared(len(own[j])))
                first = min(set(ordered[i]) & set(ordered[j]), key=lambda v: (seen[v], v))
                (left_i, ranges_i), (left_j, ranges_j) = entries[i][first], entries[j][first]
                assert min(left_i, left_j) >= both and sum(map(min, ranges_i, ranges_j)) >= both - 1e-6
    assert met > 200


def test_spans_and_sums_of_long_arrays(spark):
    row = spark.range(1).select(running_sums(F.sequence(F.lit(1), F.lit(1000))).alias("s"), running_sums(F.array().cast("array<int>")).alias("e"),
                                find_spans(F.lit("ab 😀ab" * 600), "ab").alias("f")).first()
    assert list(row.s) == [i * (i + 1) // 2 for i in range(1000)] and row.e == []
    assert [(f.start, f.end) for f in row.f] == [(p, p + 2) for i in range(600) for p in (6 * i, 6 * i + 4)]
    z = [-2.5, -0.3, 0.0, 1.0, 3.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(normal_tail(F.col("z")).alias("p")).collect()
    assert np.allclose([r.p for r in got], [0.99379, 0.617911, 0.5, 0.158655, 0.00135], atol=1e-5)


def test_windows_keep_to_the_budget_and_repeat_masked_history(spark):
    rows = [(1, 0, "system", "stay brief")] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " + "word " * (i * 7 % 60)) for i in range(1, 80)]
    out = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history_turns=2, history_tokens=60)
    found = out.orderBy("window").collect()
    assert len(found) > 5 and all(w.tokens <= 200 for w in found)
    assert all(w.formatted.startswith("<s>[INST]system[/INST]stay brief</s>") for w in found)
    assert any(w.n_repeated == 3 for w in found[1:]) and all(w.n_repeated >= 1 for w in found[1:])
    targets = [w.formatted[s.start:s.end] for w in found for s in w.loss]
    assert targets == [t for _, _, role, t in rows if role == "assistant"]


def test_escapes_are_reversed(spark):
    texts = ["</s>", "<\\s>", "<\\/s>", "[INST]", "[\\\\/INST] <s", "s>", "<<s>>", "\\<s>\\", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]")) for r in got)


def test_sampling_is_consistent_with_weighted_similarity():
    """Equal texts share all bands; the share of equal samples estimates the weighted similarity."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(600)]
    near = list(base)
    for i in rng.sample(range(600), 12):
        near[i] = "edit"
    texts = pa.array([" ".join(base), " ".join(near), " ".join(base).upper(), " ".join(reversed(base))])
    idf = neardup.idf_table(np.zeros(1 << neardup.IDF_BITS, np.int64), 4)
    keys = neardup.band_keys(texts.cast(pa.large_string()), idf).to_pylist()
    equal = lambda a, b: sum(x == y for x, y in zip(keys[a], keys[b]))
    assert equal(0, 2) == neardup.BANDS and equal(0, 3) == 0 and equal(0, 1) >= 2
    sims = neardup.similarities(texts.take([0, 0, 0]).cast(pa.large_string()), texts.take([1, 2, 3]).cast(pa.large_string()), idf)
    a, b = brute.shingle_set(" ".join(base)), brute.shingle_set(" ".join(near))
    assert abs(sims[0] - len(a & b) / len(a | b)) < 0.02 and sims[1] == 1 and sims[2] == 0


def test_components_of_chains_and_stars(spark):
    chain = [(f"{i:05d}", f"{i + 1:05d}") for i in range(300)]
    star = [("a", f"s{i:05d}") for i in range(2000)]
    rows = neardup.components(spark.createDataFrame(chain + star + [("x", "y"), ("y", "x")], "a string, b string")).collect()
    roots = {r.node: r.root for r in rows}
    assert len(roots) == 301 + 2001 + 2 and {roots[k] for k in roots if k[0] == "0"} == {"00000"} and roots["s00007"] == "a" and roots["y"] == "x"


def test_a_hot_group_of_near_copies_is_one_class(spark):
    """Two thousand different near copies and many exact ones: work stays linear and one class comes out."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(2000):
        ws = list(base)
        ws[rng.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(ws)))
    rows += [(2000 + i, " ".join(base)) for i in range(1000)]
    rows += [(3000 + i, " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(80))) for i in range(200)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(3000)} == {0} and all(got[3000 + i] == 3000 + i for i in range(200))


def test_networks_gradients_match_differences():
    net = langid.Network(["a", "b"])
    rng = np.random.Generator(np.random.PCG64(3))
    x, y = rng.integers(97, 123, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    grads = net.gradients(x, y, np.ones(2)[y])
    for name in ("u", "o", "k3", "b2"):
        flat = net.p[name].reshape(-1)
        before, eps = flat[0], 1e-3
        flat[0] = before + eps
        up = loss()
        flat[0] = before - eps
        down = loss()
        flat[0] = before
        assert abs((up - down) / (2 * eps) - grads[name].reshape(-1)[0]) < 2e-3


def test_compression_prefers_the_fitting_dictionary():
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice(k) for _ in range(5))
    good, bad = [word("abcdefgh") for _ in range(80)], [word("uvwxyz") for _ in range(80)]
    text = lambda ws: " ".join(rng.choice(ws) for _ in range(200))
    model = compression.Model(compression.dictionary([text(good) for _ in range(20)]), compression.dictionary([text(bad) for _ in range(20)]))
    x = model.features(pa.array([text(good), text(bad), "", None]))
    assert x[0, 0] < -0.03 and x[1, 0] > 0.03 and x[2, 0] == x[3, 0] == x[2, 1] == 0


def test_thresholds_are_ordered_and_severity_grows():
    rng = np.random.Generator(np.random.PCG64(5))
    n = rng.poisson(2.0, 800)
    x = np.log1p(n)[:, None]
    w, t = toxicity.fit_cumulative(x, np.searchsorted((1, 3, 6), n, "right"))
    assert w[0] > 0 and (np.diff(t) > 0).all()
    p = 1 / (1 + np.exp(-(np.log1p(np.array([0, 2, 8]))[:, None] * w[0] - t)))
    assert (np.diff(p.sum(1)) > 0).all() and (np.diff(p, axis=1) < 0).all()


def test_random_strings_are_told_from_ordinary_ones(spark):
    rng = random.Random(6)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda: "".join(rng.choice(alphabet) for _ in range(64))
    rows = [(i, f"see {key()} here") for i in range(60)] + [(100 + i, "path " + f"aaag{i % 10}bbbz" * 7 + " end") for i in range(60)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(got[i]) for i in range(60)) >= 45 and not any(got[100 + i] for i in range(60))
    assert {s.kind for i in range(60) for s in got[i]} == {"random"} and {(s.start, s.end) for i in range(60) for s in got[i]} == {(4, 68)}


def scanned(spark, rows):
    """Random spans of each document."""
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in found}


@pytest.mark.parametrize("planted", [0, 5, 50])
def test_encoded_prose_is_not_taken_for_random(spark, planted):
    """200 texts hold base64 of prose, none of it a secret; some keys stand among 800 plain texts."""
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    encoded = lambda: base64.b64encode(prose(30)[:rng.randint(16, 60)].encode()).decode()
    rows = [(i, f"{prose(60)} {encoded()} {prose(60)}") for i in range(200)] + [(1000 + i, prose(100)) for i in range(800)]
    rows += [(5000 + i, f"see {''.join(rng.choice(alphabet) for _ in range(40))} {prose(50)}") for i in range(planted)]
    got = scanned(spark, rows)
    assert sum(len(v) for d, v in got.items() if d < 5000) <= 10
    assert sum(v == [(4, 44)] for d, v in got.items() if d >= 5000) >= planted - max(1, planted // 10) * (planted > 0)


def test_random_strings_spread_evenly_over_the_battery(spark):
    """Random strings of each encoding and several lengths keep about the share 1 - t above t, ordinary ones next to nothing."""
    rng = random.Random(8)
    rows = [(e, "".join(rng.choice(secrets.ALPHABETS[e]) for _ in range(n))) for e in secrets.ALPHABETS for n in (24, 40, 120) for _ in range(100)]
    p = spark.createDataFrame(rows, "e string, v string").select("e", secrets._battery(F.col("v"), F.col("e")).alias("p")).collect()
    for e in secrets.ALPHABETS:
        of = [r.p for r in p if r.e == e]
        assert sum(x >= 0.02 for x in of) >= 0.94 * len(of) and 0.35 * len(of) <= sum(x >= 0.5 for x in of) <= 0.65 * len(of)
    plain = spark.createDataFrame([("0123456789abcdef" * 4,), ("the quick brown fox jumps over it".encode().hex(),)], "v string")
    assert all(r.p < 1e-4 for r in plain.select(secrets._battery(F.col("v"), F.lit("hex")).alias("p")).collect())


def test_decoys_are_encodings_of_the_text_itself(spark):
    text = "Ordinary prose, of words and some 12 numbers, that goes on for quite a while. " * 6
    for n in range(12):
        (row,) = spark.createDataFrame([(text + "x" * n,)], "t string").select(secrets.decoys(F.col("t")).alias("d")).collect()
        by_kind = {d.kind: d.value for d in row.d}
        assert 3 in by_kind and all(len(v) in secrets.DECOY_SIZES for v in by_kind.values())
        assert 1 not in by_kind or bytes.fromhex(by_kind[1]).decode() in text + "x" * n
        assert 2 not in by_kind or base64.b32decode(by_kind[2]).decode() in text + "x" * n
        assert base64.b64decode(by_kind[3]).decode() in text + "x" * n
    key = "Zk3" * 20
    rows = spark.createDataFrame([(None,), ("",), (key,), (f"a short {key}",)], "t string").select(secrets.decoys(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows[:3]] == [[], [], []] and rows[3].d
    assert all("Zk3" not in base64.b64decode(d.value).decode() for d in rows[3].d if d.kind == 3)


def test_random_strings_after_an_equals_sign_are_found(spark):
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda: "".join(rng.choice(alphabet) for _ in range(64))
    rows = [(i, f"AWS_KEY={key()} end") for i in range(60)] + [(100 + i, f"https://a.org/x?sig={key()}&v=1") for i in range(60)]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(got[i]) for i in range(60)) >= 45 and sum(len(got[100 + i]) for i in range(60)) >= 45
    assert {(s.start, s.end) for i in range(60) for s in got[i]} == {(8, 72)} and {(s.start, s.end) for i in range(60) for s in got[100 + i]} == {(20, 84)}


def test_hits_of_several_automata_equal_those_of_one(spark, monkeypatch):
    docs, benchmark = fixtures.odd_documents(spark), fixtures.benchmark(spark)
    whole = decontaminate.decontaminate(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 5)
    parts = decontaminate.decontaminate(docs, benchmark).collect()
    key = lambda r: repr((r.doc_id, r.hits.n_words, r.hits.n_hit, list(r.hits["items"])))
    assert sorted(map(key, whole)) == sorted(map(key, parts))


def test_hits_map_to_the_original(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    text = "é😀 x. ALPHA, beta;  Gamma-delta epsilon zeta eta theta iota Kappa! Lambda? y"
    (row,) = decontaminate.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [text[s.start:s.end] for s in row.hits.spans] == ["ALPHA, beta;  Gamma-delta epsilon zeta eta theta iota Kappa! Lambda"] and row.hits["items"] == ["9"]


def test_bad_texts_of_several_kinds_are_told_from_good_ones(spark):
    """Each kind of fault shows in one rule; a rule that fires at random now and then doesn't change the picture."""
    rng = random.Random(7)
    rows = []
    for _ in range(4000):
        kind = rng.choice([None] * 8 + [0, 1])
        fires = lambda k: -1 if rng.random() < (0.9 if kind == k else 0.002) else 0
        rows.append(([1 if rng.random() < (0.6 if kind is None else 0.4) else 0, fires(0), fires(1), -1 if rng.random() < 0.02 else 0],))
    odds = vote_odds(spark.createDataFrame(rows, "votes array<int>").groupBy("votes").agg(F.count("*").alias("n")))
    assert odds(0, 0, 0, 0) < 1 and odds(1, 0, 0, 0) < 1 and odds(1, -1, 0, 0) > 1 and odds(0, 0, -1, 0) > 1


def vote_odds(patterns):
    """The odds of being bad as a function of the votes."""
    terms = rules.estimate(patterns)
    return lambda *votes: sum(t[v + 1] for t, v in zip(terms, votes))


@pytest.mark.parametrize("scale", [1, 1000])
def test_a_rule_that_fires_on_many_good_texts_is_found_poor(spark, scale):
    """Two rules find a fault of 5 and 4 % of the texts, a third fires on 40 % of all texts; the number of texts changes nothing."""
    rows = [((a, b, c), round(10_000 * p * q)) for (a, b), p in (((0, 0), 0.91), ((-1, 0), 0.05), ((0, -1), 0.04)) for c, q in ((0, 0.6), (-1, 0.4))]
    odds = vote_odds(spark.createDataFrame([(list(v), n * scale) for v, n in rows], "votes array<int>, n long"))
    assert odds(0, 0, 0) < 0.2 and odds(0, 0, -1) < 1 and odds(-1, 0, 0) > 1 and odds(0, -1, 0) > 1 and odds(-1, 0, -1) > 1
    assert rules.estimate(spark.createDataFrame([], "votes array<int>, n long")) == []


def test_redaction_replaces_merged_spans(spark):
    span = "array<struct<rank:int,start:bigint,end:bigint,kind:string>>"
    rows = [("😀 ab cd ef", [(0, 2, 4, "email"), (2, 3, 7, "card"), (1, 8, 10, "ip")]), ("same", []), (None, [])]
    got = spark.createDataFrame(rows, f"text string, spans {span}").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in got] == ["😀 [EMAIL] [IP]", "same", None]


def test_hot_source_of_equal_sizes_meets_its_target(spark):
    rows = [(i, "hot", "a b c d") for i in range(5000)] + [(10_000 + i, f"s{i % 5}", "w " * (i % 40)) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").agg(
        F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 40 and r.most <= 3 for r in out)


def test_near_copies_within_a_shared_template_are_found(spark):
    """Texts that are mostly one template fill the same buckets; planted pairs there come out as brute force has them."""
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(150):
        template = rows[0][0][:240] if rows else fresh(240)
        own = fresh(60)
        edited = list(own)
        for k in range(3, 60, 12):
            edited[k] = "edited"
        rows += [(template + own, len(rows)), (template + edited, len(rows))]
    rows += [(rows[0][0][:240] + fresh(60), len(rows) + k) for k in range(200)]
    docs = [(i, " ".join(ws)) for i, (ws, _) in enumerate(rows)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [first for _, first in rows]


def test_prefixes_meet_for_every_similar_pair():
    """Weighted sets: the first common element of a similar pair is in both prefixes, and its bounds let the pair through."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(80)]
    texts = []
    for _ in range(60):
        ws = base[rng.randrange(12):len(base) - rng.randrange(12)]
        ws[rng.randrange(len(ws))] = rng.choice(words)
        texts.append(" ".join(ws))
    idf = neardup.idf_table(np.random.Generator(np.random.PCG64(9)).integers(0, 60, 1 << neardup.IDF_BITS), 60)
    column = pa.array(texts).cast(pa.large_string())
    h, row, weight = neardup.weighted_sets(column, idf)
    seen = {v: (h == v).sum() for v in set(h.tolist())}
    order = sorted(range(len(h)), key=lambda i: (row[i], seen[h[i]], h[i]))
    h, row, weight = h[order], row[order], weight[order].astype(float)
    n = len(texts)
    total = np.bincount(row, weight, n)
    at, of, rest, words = linking.prefix_entries(h, weight, np.bincount(row, minlength=n), total, 0.8)
    entries = [{} for _ in texts]
    for i, r, left, s in zip(h[at].tolist(), of.tolist(), rest.tolist(), words.tolist()):
        entries[r][i] = (left, [(w >> 16 * k & 65535) * total[r] / 65535 for w in s for k in range(4)])
    left, right = [i for i in range(n) for j in range(i)], [j for i in range(n) for j in range(i)]
    sims = neardup.similarities(column.take(left), column.take(right), idf)
    for i, j, s in zip(left, right, sims):
        if s >= 0.8:
            common = set(h[row == i].tolist()) & set(h[row == j].tolist())
            first = min(common, key=lambda v: (seen[v], v))
            (rest_i, ranges_i), (rest_j, ranges_j) = entries[i][first], entries[j][first]
            needed = 0.8 / 1.8 * (total[i] + total[j])
            assert min(rest_i, rest_j) >= needed - 1e-6 and sum(map(min, ranges_i, ranges_j)) >= needed - 1e-6
    assert (sims >= 0.8).sum() > 50 and (sims < 0.8).sum() > 50


def test_near_copies_of_hot_groups_and_templates_are_found_as_by_brute_force(spark):
    """Every pair is compared by weighted similarity; a pair at the threshold may share no band, so a few rows are granted."""
    rows = copies_and_templates(random.Random(16), 250, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequencies, total = neardup.document_frequencies(docs)
    idf = neardup.idf_table(frequencies, total)
    column, n = pa.array([t for _, t in rows]).cast(pa.large_string()), len(rows)
    root = list(range(n))
    for i in range(1, n):
        near = neardup.similarities(column.take([i] * i), column.slice(0, i), idf) >= 0.8
        for j in np.flatnonzero(near):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert sum(got[d] != root[d] for d in range(n)) <= 0.005 * n and len(set(root)) > 200 and max(map(root.count, set(root))) > 100


def test_loose_personal_data_is_redacted_and_clean_numbers_are_not(spark):
    rng = random.Random(10)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(400):
        rows.append((i, f"please mail u{number(4)}@site{i % 9}.org today and call +1 {number(3)} {number(3)} {number(4)} soon"))
    for i in range(400):
        rows.append((1000 + i, f"version {i % 9}.{i % 7}.{i} had {number(6)} rows of {number(9)} and took {number(3)} {number(4)} steps"))
    rows += [(2000 + i, f"please mail v{number(4)} (at) home{i % 9}.org today and call 1 {number(3)} {number(3)} {number(4)} soon") for i in range(80)]
    texts = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("[EMAIL]" in texts[2000 + i] for i in range(80)) >= 72 and sum("[PHONE]" in texts[2000 + i] for i in range(80)) >= 72
    assert all(texts[1000 + i] == rows[400 + i][1] for i in range(400))


def test_examples_are_loose_and_counted_once(spark):
    rows = [(i, "call +1 415 555 2671 or mail a@b.org") for i in range(50)] + [(50, "version 1.2.3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.examples(docs).collect()
    assert {(r.rank, r.label) for r in found} == {(0, 1.0), (3, 1.0), (1, 0.0)} and len(found) < 12
    same = pii.examples(docs.orderBy(F.desc("doc_id")).repartition(7)).collect()
    assert sorted(map(repr, same)) == sorted(map(repr, found))


def test_superblocks_of_any_depth_give_one_manifest(spark):
    rows = [(i, f"s{i % 2}", "hot" if i < 70 else ["a", "b", None, "c", "d", "e"][i % 6], i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    want = sorted(map(repr, brute.merkle(rows)))
    for depth in (1, 2, 12):
        assert sorted(map(repr, map(tuple, merkle.manifest(docs, depth).collect()))) == want


def test_a_lone_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(2**60 + 1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(docs).collect()
    assert row.doc_id == 2**60 + 1 and row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == brute.sha("")


def test_equal_average_search_is_exact():
    rng = np.random.Generator(np.random.PCG64(13))
    for dim, spread, entries in ((4, 40, 64), (4, 2, 64), (1, 5, 7), (8, 100, 1), (2, 1 << 24, 64)):
        book, parts = rng.integers(-spread, spread, (entries, dim)), rng.integers(-spread, spread, (500, dim))
        found, best = codes.search(parts, book)
        distances = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (found == distances.argmin(1)).all() and (best == distances.min(1)).all()


def test_codes_stand_for_near_vectors(spark):
    vectors = fixtures.embeddings(spark)
    kept = vectors.select("vec_id", codes.fixed_point(F.col("embedding")).alias("q")).where("size(q) = 32")
    books = codes.codebooks(kept, 32)
    of = {r.vec_id: r.q for r in kept.collect()}
    for r in codes.compress(vectors).collect():
        back = np.round(codes.decoded(r.code, books) * 256).astype(int)
        assert ((back - np.array(of[r.vec_id])) ** 2).sum() == r.error


CLASHING = ("size", "source_size", "target", "rate", "copies", "quota", "q_n", "q_size", "q_source", "_h", "_bucket", "_rank", "n", "s", "lam", "row", "id", "text_key", "class_id",
            "_text_key", "kept", "least", "root", "c0", "a.b")


def test_columns_of_any_name_come_back_with_their_values(spark):
    """Mixing and deduplication carry whole rows; of rows equal in id and text the least one stays, in whatever order they come."""
    schema = ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in CLASHING]])
    rows = [(i, f"text number {i} " + "word " * (i % 5) + f"end {i}", "ab"[i % 2], *[f"{c}{i}" for c in CLASHING]) for i in range(40)]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mixture(docs)
    assert out.columns == [*docs.columns, "copy"] and {tuple(r)[:-1] for r in out.collect()} <= set(rows)
    named = mixing.mixture(docs.withColumn("copy", F.lit("mine")))
    assert named.columns == [*docs.columns, "copy"] and {r["copy"] for r in named.collect()} == {"mine"}
    mixed = mixing.mix(docs)
    assert {r["a.b"] for r in mixed.collect()} == {r[-1] for r in rows} and mixed.where("copies is null").isEmpty()
    twins = [(i, rows[i][1], "b", *[f"A{c}" for c in CLASHING]) for i in range(10)]
    want = sorted([min(r, t, key=lambda x: x[2:]) for r, t in zip(rows[:10], twins)] + rows[10:])
    for order in (1, -1):
        kept = neardup.keep_one(spark.createDataFrame((rows + twins)[::order], schema).repartition(3))
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == want


def test_every_language_is_learned(spark):
    """150 languages, one of them in long texts alone: a text bound per language, no bound on languages."""
    rng = random.Random(17)
    letters = lambda k: [chr(0x4E00 + 40 * k + j) for j in range(12)]
    text = lambda k, n: " ".join("".join(rng.choice(letters(k)) for _ in range(4)) for _ in range(n))
    rows = [(1000 * k + i, text(k, 30 if k else 9000), f"l{k:03d}") for k in range(150) for i in range(8)]
    network = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert network.labels == [f"l{k:03d}" for k in range(150)]


def test_samples_are_filled_from_usable_texts(spark):
    """Long and missing texts take nobody's place, and an id of very many rows is one text."""
    docs = [(i, "x" * (50 if i % 10 == 0 else 5000)) for i in range(400)] + [(i, None) for i in range(400, 500)] + [(0, f"other {k}") for k in range(300)]
    labels = [(i, i // 10 % 2) for i in range(600)]
    found = samples.labelled_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), "quality", [0, 1], 15, 100)
    assert [sum(y == label for _, y in found) for label in (0, 1)] == [15, 15]


def test_mixing_shuffles_no_text_that_nobody_reads(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "word " * (i % 7)) for i in range(40)], "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = mixing.mix(docs).select("doc_id", "size", "copies")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in text and "struct(" not in text and "AS _row2" not in text


def test_toxicity_training_holds_the_counts_about_once(spark):
    """Before, the driver held the matrix of counts several times over as doubles."""
    import tracemalloc
    x = np.zeros((2000, 1000), np.float32)
    x[np.arange(1000), np.arange(1000) % 40] = 1
    tracemalloc.start()
    try:
        weights, thresholds = toxicity.fit_cumulative(x, np.where(x.sum(1) > 0, 1, 0), steps=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights.shape == (1000,) and weights.dtype == float and (np.diff(thresholds) > 0).all()
    assert peak < 3 * x.nbytes
