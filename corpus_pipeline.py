"""From raw documents to packed training sequences, in stages that each read what the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, mixing, near_duplicates, packing, secrets
from corpusloom.llm.common import Scratch, table
from corpusloom.llm.queries import TOKENIZER

#: A text that the best language codes no shorter than raw bytes isn't in a language.
RAW_BITS = 8.0

#: Near-duplicates here share four fifths of their five-word shingles; op8's contract has bounds of its own.
NEAR = near_duplicates.JaccardConfig(words=5, threshold=80, spare=0.05, prefer=0.1)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, labelled with the one that was found."""
    model = language_id.learn(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < RAW_BITS))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.keep_one(docs, NEAR).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, as often as its source's weight asks."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return packing.pack(docs, TOKENIZER, 2048, 0)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned code lengths, tokenizers and sampling aren't SQL's; stages' operators have plain versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
