"""From raw documents to packed token sequences: quality, near duplicates, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns documents' columns, the last one the pieces of the sequences.  ``run`` writes each
stage's result and reads it again, so a lost executor repeats a stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import common, decontamination, near_duplicates, packing, quality, secrets

#: Two of the stages learn or compare in ways that SQL cannot express.
ORACLE_SQL = None
#: A document is kept if its quality score is at least this.
ACCEPTED = 0.3
#: Percentage of shared five-word shingles from which documents are near duplicates.
SIMILAR = 80


def _columns(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones outside the fold held out.  Null and empty texts
    get the labels' own frequency, so they stay where good labels prevail."""
    model = quality.train(docs, quality.training_labels(common.table(spark, sf_dir, "labels")))
    return _columns(quality.score(docs, model, docs.columns).where(F.col("score") >= ACCEPTED), docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, rows without an id last.  Every row is a document of its own, also where rows
    share an id; those without words are groups of their own."""
    rows = common.kept(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[common.named(c) for c in docs.columns]).alias("doc")), "pipeline-rows")
    found = near_duplicates.near_duplicates(rows.select("row", F.col("doc").getField("text").alias("text")), SIMILAR, id_col="row")
    by_id = rows.select("row", F.col("doc").getField("doc_id").alias("id")).join(found.select("row", "component_id"), "row")
    stays = by_id.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return _columns(rows.join(stays, "row", "left_semi"), docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontamination.find_benchmark(docs, common.table(spark, sf_dir, "benchmark"), docs.columns)
    return _columns(found.where(F.size("hits") == 0), docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew where that changed a text."""
    clean = secrets.redact(docs, "text")
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("clean") != F.col("doc")["text"], F.length("clean").cast("long")).otherwise(F.col("doc")["n_chars"])
    return _columns(clean, docs.columns, **changed)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.packed(docs, packing.default_tokenizer(), 1024)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", distinct_documents),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.kept(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
