"""A corpus from raw documents to token ids: five stages, each written as Parquet and read by the next.

Every stage but the last returns its input's columns, whatever they are called, and rows as they were but for what it
decides.  For all of them: null and empty texts, null ids, texts of any length and repeated rows are input like any
other; an empty table gives an empty table.  The tables that a stage leaves in the shared folder for its result are
deleted when the next stage begins on an input that does not read them, that is, once the result has been written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mosaica.llm import bpe, decontaminate, jaccard, quality, suffixes
from mosaica.llm.common import discard, save, ship, sweep, table, written
from mosaica.llm.queries import BYTE_BPE

_LEFT: list[str] = []


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        if _LEFT and not any(path.rpartition("/")[2] in file for file in docs.inputFiles() for path in _LEFT):
            sweep(spark, _LEFT)
            _LEFT.clear()
        before = set(written())
        out = work(spark, docs, sf_dir)
        _LEFT.extend(path for path in written() if path not in before)
        return out

    run_stage.__doc__, run_stage.__name__ = work.__doc__, work.__name__
    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go.

    Null and empty texts go; repeated rows have equal keys and stay or go together; of rows that tie with the last
    drawn one all stay; without labels every text with a feature stays.
    """
    return quality.drawn(docs, table(spark, sf_dir, "labels"))


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    The one of the smallest id stays (null ids last); texts without words link with nothing and all stay, null ones
    included; of repeated rows one stays; a text of fewer words than a shingle is one shingle.
    """
    return jaccard.deduplicate(docs, percent=80, width=5)


@stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document holds.

    Earlier means a smaller id (null ids last).  Documents of which nothing is left go; null and empty texts stay, and
    so do rows equal in id and text; of equal texts of 50 words or more the first id stays.  ``n_chars`` follows a text that is cut.
    """
    return suffixes.cut(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items; null and empty texts stay, repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's ids and of what they decode to; null is the empty text."""
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Resampling, components and suffix order are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES:
        before, docs = docs, save(work(spark, docs, sf_dir))
        discard(before)  # the stage before last is no longer read
    return docs
