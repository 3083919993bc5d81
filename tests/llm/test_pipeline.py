"""The pipeline's stages, each against its own input."""

import corpus_pipeline
from plumbline.llm import decontaminate, exact_dedup, ngram_join, quality
from plumbline.llm.common import shared_dir
from plumbline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "ngram_jaccard", "decontaminate", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(f"{tmp_path}/{name}")
        seen.append((name, before, after := spark.read.parquet(f"{tmp_path}/{name}")))
        before = after
    ids = [({r["doc_id"] for r in a.select("doc_id").collect()}, {r["doc_id"] for r in b.select("doc_id").collect()}) for _, a, b in seen]
    assert all(after <= first for first, after in ids) and all(b.columns == columns for _, _, b in seen[:-1])
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    kept = [
        {r["doc_id"] for r in quality.score_quality(seen[0][1], labels).filter("good").collect()},
        {r["doc_id"] for r in exact_dedup.exact_dedup(seen[1][1]).filter("kept").collect()},
        {r["doc_id"] for r in ngram_join.ngram_classes(seen[2][1]).filter("doc_id = component_id").collect()},
        ids[3][0] - {r["doc_id"] for r in decontaminate.find_leaks(seen[3][1], bench).collect()},
    ]
    assert [after for _, after in ids[:4]] == kept
    assert len(ids[4][1]) > 0 and "epoch" in seen[4][2].columns


def test_stages_without_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert got.count() == 0 and (name == "mixing" or got.columns == docs.columns)


def test_run_leaves_only_its_result(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [x.getPath() for x in files.listStatus(root) if x.getPath().getName().startswith("pipeline-")]
    assert ["mixing"] in [[x.getPath().getName() for x in files.listStatus(p)] for p in left]


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
