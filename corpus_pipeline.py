"""A training corpus from raw documents: filter, deduplicate, clean, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs.  All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import op4_packing, op5_similar, op5_simhash, op6_quality, op7_suffix_dedup, op8_pii
from tidemark.llm.common import checkpoint_dir, table


def _bundle(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _rest): the other columns in one, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest, F.lit(None).cast("int").alias("_")).alias("_rest"))


def _unbundle(done: DataFrame, columns: list[str], measure: bool = False) -> DataFrame:
    """The columns of documents again; measure: n_chars follows a changed text."""

    def one(c):
        if c in ("doc_id", "text"):
            return F.col(c)
        if c == "n_chars" and measure:
            return F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias(c)
        return F.col("_rest").getField(c).alias(c)

    return done.select(*map(one, columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned list reject go."""
    rules = op6_quality.fit(docs, table(spark, sf_dir, "labels"))
    return _unbundle(op6_quality.filter_documents(_bundle(docs), rules), docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingle similarity 0.8 or more stays: SimHash links held against
    that similarity, and an exact join of what SimHash has not joined."""
    rows = _bundle(docs)
    return _unbundle(op5_simhash.one_of_each(rows, op5_similar.similar(rows)), docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document of nothing else goes whole."""
    done = op7_suffix_dedup.deduplicate(_bundle(docs), "doc_id", "text", "_rest", whole_chars=True)
    done = done.withColumn("text", F.when(F.size("removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text")))
    empty = (F.size("removed") > 0) & ~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))
    return _unbundle(done.filter(~empty), docs.columns, measure=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return _unbundle(op8_pii.redact(_bundle(docs)), docs.columns, measure=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's pieces in sequences of 2048 tokens."""
    return op4_packing.pack(op4_packing.pieces(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash),
    ("suffix-array dedup", repeats),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: The learned list, XXH64 fingerprints and the tokenizer are not SQL; tests/llm/test_pipeline.py
#: holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
