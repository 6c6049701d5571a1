"""The corpus pipeline: five stages over the documents table, each on all that the one before it kept.

Part of the text operators (tessera.llm). Each stage takes (spark, docs, sf_dir)
and returns the documents with its decisions applied; all but the last return the
columns of documents.

Odd rows. A null, empty or blank text has no words: the quality stage scores it by
the classifier's bias, and the stages after it keep it as it is. Rows with a null
doc_id are scored and cleaned like others, are near copies of nothing and all stay.
Rows that repeat a doc_id and a text are treated alike. An empty table gives an empty
one; without labels every score is 0.5, without benchmark items nothing goes. Columns
beyond those of documents are left out, whatever their names. Texts of any length are
taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, mixing, neardup, quality
from tessera.scratch import materialize, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score below this go; the classifier's own threshold.
THRESHOLD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from labelled documents of four folds of five."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = quality.train(quality.labelled(docs, labels, "quality", quality.fold(5) != 0))
    return quality.scored(docs.select(*COLUMNS), weights).filter(F.col("__score") >= THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks and passages go from the texts, but for their first place; n_chars follows."""
    out = linededup.line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    out = neardup.near_duplicates(docs.select("doc_id", "text"))
    gone = out.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by raked probabilities: the documents with topic, n_tokens, the probability they came in with and their copies."""
    out = mixing.mix(docs.select(*COLUMNS)).filter("__sampled")
    return out.select(*COLUMNS, *(F.col(f"__{a}").alias(b) for a, b in (("topic", "topic"), ("tokens", "n_tokens"), ("probability", "probability"), ("copies", "copies"))))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier can't be put in SQL; tests hold the other stages against brute-force versions on their own input, the classifier against a plain loop of its training, and all on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents table; each one's result is written and read again, and goes when the next one's is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
