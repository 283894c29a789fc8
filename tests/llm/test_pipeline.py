"""The stages of the corpus pipeline, each on what its predecessor kept."""

import __spark_entry__ as entry
import corpus_pipeline
from lexloom.llm import decontamination, mixing, pii, quality_cnn, simhash_dedup
from lexloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    ids = [[r["doc_id"] for r in d.select("doc_id").collect()] for d in kept]
    assert all(d.columns == columns for d in kept[:-1])
    assert all(set(b) <= set(a) and len(b) == len(set(b)) for a, b in zip(ids, ids[1:]))

    bench, labels = table(spark, SF, "benchmark"), table(spark, SF, "labels")
    model = quality_cnn.fit(docs, labels)
    good = {r["doc_id"] for r in quality_cnn.classify(docs, model).where("predicted = 1").collect()}
    assert set(ids[1]) == good
    groups = simhash_dedup.near_duplicates(kept[1], words=True).collect()
    assert set(ids[2]) == {r["component_id"] for r in groups}
    leaking = {r["doc_id"] for r in decontamination.leaks(kept[2], bench).collect()}
    assert set(ids[3]) == set(ids[2]) - leaking and leaking
    before = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    after = {r["doc_id"]: r for r in kept[4].collect()}
    assert set(before) == set(after)
    assert all(not pii.base_spans(r["text"]) for r in after.values() if r["text"])
    assert all(before[i] == r["text"] for i, r in after.items() if not pii.base_spans(before[i] or "") and "<SECRET>" not in r["text"] and "<NUMBER>" not in r["text"] and "<CONTACT>" not in r["text"])
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    mix = kept[5].collect()
    assert len(mix) == len(after) and sum(r["taken"] for r in mix) > 0

    rows = sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert rows == sorted((r["doc_id"], r["taken"]) for r in mix)
    assert rows == sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(kept[4]).collect())


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {n.split("_")[0] for n in names}
    assert "op6_license_scan" in entry.oracle_sql()
