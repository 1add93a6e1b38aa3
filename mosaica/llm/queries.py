"""One query an operator, with production parameters and over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from mosaica.llm import ann, bpe, decontaminate, jaccard, langid, licenses, quality, suffixes, token_files, warc
from mosaica.llm.common import scratch_dir, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold, verbatim or with other values."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, and where each stays."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op3_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set sizes and near-duplicate components of all documents."""
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages, taken as WARC responses."""
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality models draw."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and read back."""
    path = scratch_dir(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), END_ID, path)
    return token_files.crc_rows(token_files.read_tokens(spark, path))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, as files ``source/lang/doc-id``; a document that is mostly a licence speaks for its directory."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.lit("doc-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op10_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.pmod("vec_id", F.lit(20)) == 0))


QUERIES = {
    "op1_template_decontamination": op1_template_decontamination,
    "op2_sparse_suffixes": op2_sparse_suffixes,
    "op3_jaccard_components": op3_jaccard_components,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_orc_tokens": op6_orc_tokens,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_language_kernel": op8_language_kernel,
    "op9_licence_scan": op9_licence_scan,
    "op10_additive_quantisation": op10_additive_quantisation,
}

#: SQL that gives the same rows, where SQL can.
ORACLE: dict[str, str] = {
    "op1_template_decontamination": decontaminate.oracle(),
    "op4_warc_derivatives": warc.oracle(),
    "op9_licence_scan": licenses.oracle("SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/doc-' || coalesce(doc_id::VARCHAR, '') AS path, text FROM documents"),
}
