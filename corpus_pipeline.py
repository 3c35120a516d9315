"""From raw documents to packed sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written
as Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import release, scratch_path
from gridweave.llm.decontamination import drop_contaminated
from gridweave.llm.language import fit_languages, keep_known_language
from gridweave.llm.line_dedup import line_dedup
from gridweave.llm.packing import pack
from gridweave.llm.simhash import keep_one_each

#: A text whose best language covers less of it is no text of a known language. Texts in two
#: languages have about one half.
LEAST_SCORE = 0.4
#: Documents are near-duplicates from this Jaccard similarity of their five-word shingles.
NEAR = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or spread over many languages, go."""
    return keep_known_language(docs, fit_languages(docs), LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occurred before are deleted: runs by winnowing, shorter repeats in a second pass. A document of which
    nothing is left goes."""
    done = line_dedup(docs, run=1, window=4, scope="pipeline-lines", short=True)
    left = done.where((F.col("n_deleted") == 0) | (F.col("text") != ""))
    sizes = {"n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return left.withColumns(sizes).drop("n_deleted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    release(spark, "pipeline-lines")
    return keep_one_each(docs, scope="pipeline-near", similarity=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    release(spark, "pipeline-near")
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return pack(docs, limit=1024, scope="pipeline-pieces")


STAGES = [
    ("language ID", language_id),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the language model, the trie join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{k}", f"pipeline-written-{k}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        release(spark, f"pipeline-written-{k - 1}")
    release(spark, "pipeline-pieces")
    return docs
