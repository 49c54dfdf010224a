import corpus_pipeline
import llm_rows
from runlens.llm import near_dedup, quality
from runlens.llm.shingles import shingle_sets

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "minhash near-dedup", "mixing sources", "packing"]

    good = stages["quality classifier"](spark, docs, SMALL)
    assert good.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{SMALL}/labels.parquet")), quality.GOOD)
    one, places = quality.judge(model, quality.GOOD, quality.LEAST_TAIL), quality.Places()
    assert rows == {r["doc_id"]: r["text"] for r in docs.collect() if one(r["text"], places)[3]}

    single = stages["exact dedup"](spark, good, SMALL)
    first = {}
    for doc_id in sorted(rows):
        first.setdefault(" ".join(rows[doc_id].split()), doc_id)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    near = stages["minhash near-dedup"](spark, single, SMALL)
    kept = {r["doc_id"]: r["text"] for r in near.collect()}
    sets = {i: frozenset(s.tolist()) for i, s in zip(first.values(), shingle_sets([rows[i] for i in first.values()], 5))}

    def similar(a, b):
        return 100 * len(a & b) >= 80 * len(a | b)

    ids = sorted(sets)
    assert all(not similar(sets[a], sets[b]) for a in kept for b in kept if a < b)
    assert all(i in kept or any(similar(sets[i], sets[j]) for j in ids if j != i) for i in ids)

    mixed = stages["mixing sources"](spark, near, SMALL)
    assert mixed.columns == docs.columns
    copies = [r["doc_id"] for r in mixed.collect()]
    assert set(copies) <= set(kept)
    packed = stages["packing"](spark, mixed, SMALL).collect()
    assert sorted(r["doc_id"] for r in packed if r["start"] == 0) == sorted(copies)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", llm_rows.odd_documents(spark)), ("none", llm_rows.no_documents(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(got) == (name == "odd")


def test_defaults_of_the_near_duplicate_stage():
    assert (near_dedup.WORDS, near_dedup.PERCENT) == (5, 80)
