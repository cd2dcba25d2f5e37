"""The named queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    archive, automata, backtrack, cascade, crossent, curves, divergence, kernel, ledger, licences, orchard, pivotal, prefixes,
)
from tidemark.llm.text import PIECE_BYTES, scratch, stored

# fixed values: the rules that the url query is asked to judge by
ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")

# rows and bytes of an Arrow batch: Spark's default and what the operators run with. A batch takes
# a piece of texts (``text.PIECE_BYTES``), one row at least
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(PIECE_BYTES)),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless they have it on their path,
    and make Arrow batches small where the session left their size as it was: texts are long."""
    for name, (default, small) in BATCH.items():
        if spark.conf.get(name, default) in (default, default + "b"):
            spark.conf.set(name, small)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in paths or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp()  # the driver's own copy; Spark's file server hands it out until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tidemark"), "zip", root, "tidemark"))
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> str:
    """Path of the tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return run


@query
def op1_curve_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return curves.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op2_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    target = table(spark, folder, "labels").where("quality = 1 and toxic = 0")
    return crossent.score(table(spark, folder, "documents"), target)


@query
def op3_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch(spark, "archive")
    archive.write(table(spark, folder, "pages"), place)
    return archive.parse(archive.records(spark, place)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op4_url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return cascade.judge(table(spark, folder, "pages"), ALLOW, BLOCK)


@query
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.near_duplicates(table(spark, folder, "documents"), percent=80)


@query
def op6_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    book = stored(ledger.ledger(table(spark, folder, "documents")), "ledger")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~ledger.passes(ledger.POLICIES["base-1"])).alias("base_failed"),
        ledger.passes(ledger.POLICIES["web-1"]).alias("kept"),
        "failed",
        ledger.only_rule(ledger.POLICIES["web-1"]).alias("only_rule"),
    )


@query
def rule_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """What leaving out one rule of each policy would keep, from the stored ledger alone."""
    book = stored(ledger.ledger(table(spark, folder, "documents")), "ledger")
    counts = [
        ledger.ablation(book, rules).select(F.lit(name).alias("policy"), "rule", "failing", "alone", "kept_without")
        for name, rules in ledger.POLICIES.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def op7_kernel_quality(spark: SparkSession, folder: str) -> DataFrame:
    return kernel.judge(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)


@query
def op8_backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary()
    return backtrack.decode(backtrack.encode(table(spark, folder, "documents"), path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query
def op9_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    return pivotal.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return automata.remove(table(spark, folder, "documents"), texts=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


@query
def op11_orchard_codes(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.compress(table(spark, folder, "embeddings"))


@query
def op12_licence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents")).drop("spans")


@query
def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
