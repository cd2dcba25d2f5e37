"""From raw documents to a tokenized mix, in five stages.

Every stage takes ``documents`` as the one before left them; all but the last return the same
columns. ``run`` writes each stage's rows to the shared folder and reads them again.
Nulls, empty tables, repeated rows and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automata, backtrack, kernel, pivotal, prefixes
from tidemark.llm.catalog import ship, table, vocabulary
from tidemark.llm.text import restored, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    return kernel.keep(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id."""
    ship(spark)
    return prefixes.representatives(docs, percent=80)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier document holds; ``n_chars`` follows the text."""
    ship(spark)
    cut = automata.removed(docs)
    kept = dict(zip(docs.columns, restored(docs), strict=True))
    if "n_chars" in kept:
        size = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(kept["n_chars"])
        kept["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return cut.select(*[column.alias(name) for name, column in kept.items()])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    ship(spark)
    return pivotal.apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    ship(spark)
    path = vocabulary()
    return backtrack.decode(backtrack.encode(docs, path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("mixing sources", mixture),
    ("BPE encoding", tokens),
]

ORACLE_SQL = None  # a fitted classifier and random rounding: see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
