"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: every operator's report and every stage of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tessera.llm import decontaminate, langid, linededup, media, mixing, neardup, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHES = ("node", "key", "h", "a", "v", "k", "cell", "component_id", "found", "starts", "__score", "__tokens", "__set", "y", "label_id", "media")
LONG = "some words that go on, and on. " * 70_000  # 2.2 MB


def odd_documents(spark):
    texts = [None, "", " \n\t", "x", "12 34", LONG, LONG, "tie one two three four five", "tie one two three four five", "ünïcödé 漢字 \U0001f600", "a\x00b", "line one\nline two\nline one\nline two"]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 5 else 7) for k, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id", "en", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])


def labels_of(spark):
    return spark.createDataFrame([(k, None if k == 3 else k % 2, k % 2) for k in range(2, 12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def items_of(spark):
    return spark.createDataFrame([(1, "line one line two"), (2, None), (3, ""), (None, "go on and on"), (1, "line one line two")], "item_id long, text string")


REPORTS = {
    "mixing": lambda spark, docs: mixing.report(docs),
    "near duplicates": lambda spark, docs: neardup.near_duplicates(docs),
    "decontamination": lambda spark, docs: decontaminate.report(docs, items_of(spark)),
    "lines": lambda spark, docs: linededup.report(docs),
    "quality": lambda spark, docs: quality.predictions(docs, labels_of(spark)),
    "language": lambda spark, docs: langid.predictions(docs),
    "streams": lambda spark, docs: media.report(docs),
    "secrets": lambda spark, docs: secrets.report(docs),
    "toxicity": lambda spark, docs: toxicity.predictions(docs, labels_of(spark)),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_every_odd_row_has_its_row(spark, name):
    docs = odd_documents(spark)
    got = REPORTS[name](spark, docs).collect()
    wanted = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert sorted(str(r["doc_id"]) for r in got) == wanted
    # Repeated rows, and ties of equal texts, are treated alike.
    assert len({tuple(r) for r in got if r["doc_id"] == 7}) == 1
    if name in ("language", "streams", "secrets", "toxicity", "decontamination", "quality"):
        one, two = ([v for c, v in r.asDict().items() if c not in ("doc_id", "held_out")] for r in got if r["doc_id"] in (5, 6))
        assert one == two
    assert REPORTS[name](spark, docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    labels_of(spark).write.parquet(f"{where}/labels.parquet")
    items_of(spark).write.parquet(f"{where}/benchmark.parquet")
    labels_of(spark).limit(0).write.parquet(f"{where}/none/labels.parquet")
    items_of(spark).limit(0).write.parquet(f"{where}/none/benchmark.parquet")
    return where


@pytest.mark.parametrize("k", range(5))
def test_every_stage_takes_odd_rows(spark, tables, k):
    name, stage = cp.STAGES[k]
    docs = odd_documents(spark)
    out = stage(spark, docs, tables)
    assert out.columns[:5] == list(cp.COLUMNS)
    rows, source = out.collect(), {(r["doc_id"], r["text"]) for r in docs.collect()}
    if name == "line dedup":
        assert len(rows) == docs.count()
    else:
        assert {(r["doc_id"], r["text"]) for r in rows} <= source
    if name == "minhash near-dedup":
        kept = [r["doc_id"] for r in rows]
        assert 8 not in kept and 6 not in kept and kept.count(7) == 3 and kept.count(None) == 2 and {0, 1, 2} <= set(kept)
    if name == "benchmark decontamination":
        assert 11 not in [r["doc_id"] for r in rows] and 5 not in [r["doc_id"] for r in rows] and len(rows) == docs.count() - 3
    assert stage(spark, docs.limit(0), tables).collect() == []
    assert stage(spark, docs.limit(0), f"{tables}/none").collect() == []
