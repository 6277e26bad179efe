import corpus_pipeline
from tests.llm import brute, fixtures


def test_stages_on_odd_rows(spark, tmp_path):
    sf = fixtures.write_tables(spark, tmp_path / "in")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in fixtures.benchmark(spark).collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before, rows = [r["text"] for r in docs.collect()], [r["text"] for r in after.collect()]
        if name != "mixing":
            assert after.columns == docs.columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert set(rows) <= set(before)
        if name == "near_dedup":
            assert len([t for t in rows if t]) == len({t for t in rows if t})
            assert rows.count(None) == before.count(None)
        if name == "decontamination":
            assert sorted(map(repr, rows)) == sorted(repr(t) for t in before if not brute.hits(t, items)["n_hit"])
        if name == "pii":
            assert len(rows) == len(before)
            assert not any(brute.personal(t)[f"n_{k}"] for t in rows for k in ("email", "ip", "card", "phone"))
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_run_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    assert 100 <= corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() <= 200
