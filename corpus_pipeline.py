"""From raw documents to packed sequences: language, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the documents of the next
one. All but the last return the columns of their documents. Any column may be null, columns beyond those of ``documents`` stay, and an
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.decontam import WINDOW, contaminated
from fleetlens.llm.langid import drop_unclear
from fleetlens.llm.minhash import near_duplicates
from fleetlens.llm.packing import pack_sequences
from fleetlens.llm.queries import WORD_VOCABULARY
from fleetlens.llm.suffix_dedup import cut_repeats
from fleetlens.plans.shared import new_folder, scratch

#: A document whose best language is less likely than this is rejected.
LEAST_LANGUAGE_SCORE = 0.3
#: Benchmark items of fewer words than a window of the search are reported by it, but ordinary sentences hold them too, so they drop nothing here.
LEAST_ITEM_WORDS = WINDOW


def _with(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """Join on id and text name; decisions have d, t and no other column of the documents."""
    left = docs.alias("doc")
    ident = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("made.d"))
    return left.join(decisions.alias("made"), ident & (F.xxhash64(F.coalesce("doc.text", F.lit(""))) == F.col("made.t")), how)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and those whose language stays unclear."""
    return drop_unclear(docs, LEAST_LANGUAGE_SCORE)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near and exact copies, that with the smallest id; of rows that repeat its id and text, one."""
    found = near_duplicates(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("d"), "t").distinct()
    once = _with(docs, kept, "left_semi")
    return once.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that stand elsewhere too out of the texts; n_chars follows where the text has changed. Every document stays."""
    return cut_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item of at least LEAST_ITEM_WORDS stands, verbatim or with other parameters."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.col("window_words") >= LEAST_ITEM_WORDS)
    return _with(docs, found.select(F.col("doc_id").alias("d"), "t").distinct(), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    return pack_sequences(docs, WORD_VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: the stages learn a network, hash with numpy and tokenise. tests/llm holds the stages to brute force.
ORACLE_SQL = None
