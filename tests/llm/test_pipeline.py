"""The pipeline: each stage on its own input, held against plain versions of its decision."""

import re

import corpus_pipeline as cp
from tessera.llm import quality
from tests_plain import brute_components, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{k}"))
        docs = seen[name][1]
        assert docs.columns[:5] == list(cp.COLUMNS)
    assert [len(x[1].columns) for x in seen.values()][:-1] == [5] * 4

    before, after = seen["quality classifier"]
    weights = quality.train(quality.labelled(before, spark.read.parquet(f"{SF}/labels.parquet"), "quality", quality.fold(5) != 0))
    assert after.count() == quality.scored(before, weights).filter("__score >= 0.3").count() > 0.7 * before.count()

    before, after = ({r["doc_id"]: r for r in x.collect()} for x in seen["line dedup"])
    order = sorted(before)
    assert [after[d]["text"] for d in order] == brute_lines([before[d]["text"] for d in order])
    assert all(after[d]["n_chars"] == len(after[d]["text"]) for d in order)

    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen["minhash near-dedup"])
    component, _ = brute_components(sorted(before.items()))
    assert set(after) == {d for d, c in component.items() if d == c}

    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in seen["benchmark decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = sorted(before)
    hit = [h[4] for h in brute_hits([re.sub(r"\s+", " ", before[d] or "") for d in ids], items)]
    assert set(after) == {d for d, h in zip(ids, hit, strict=True) if not h}

    before, after = seen["mixing"]
    assert 0 < after.count() <= before.count() and after.filter("probability <= 0 or probability > 1").count() == 0
