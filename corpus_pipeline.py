"""A corpus pipeline over ``documents``: five stages, each reading what the one before wrote.

Every stage is a function of the session, its predecessor's rows and the folder of the
test tables. ``run`` chains them over ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickreports.llm import language_id, mixing, near_dups, packing, repeats
from clickreports.llm.queries import PACKING_TOKENIZER, table, tokenizer_path
from clickreports.llm.steps import Steps, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the others go. ``lang`` keeps its given value."""
    ship(spark)
    evidence = language_id.page_evidence(table(spark, sf_dir, "pages"))
    found = language_id.identify(docs, language_id.fit(docs), evidence, host_column="source")
    return language_id.accepted_rows(docs, found).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 over five-word shingles."""
    ship(spark)
    return near_dups.one_of_each(docs, words=5, percent=80).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; null texts stay null."""
    ship(spark)
    cut = repeats.remove_repeats(docs.select(*COLUMNS), length=100)
    n_chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.withColumn("n_chars", n_chars).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size, as many characters in all as before; rows repeat."""
    ship(spark)
    return mixing.replicate(docs, mixing.source_rates(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token pieces and their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(packing.token_pieces(docs, tokenizer_path(PACKING_TOKENIZER)))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Fitted language models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    steps = Steps(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = steps.land(name, stage(spark, docs, sf_dir))
    return docs
