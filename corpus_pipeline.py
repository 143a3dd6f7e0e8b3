"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.llm import bpe, lsa, secret_ledger, simhash, toxicity
from quarrion.llm.common import materialise, table

#: Near duplicates: five-word shingles, and their Jaccard similarity from which on two texts are linked.
SHINGLE, SIMILARITY = 5, 0.8


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier predicts toxic go.

    Null and empty texts stay, repeated rows go or stay together; an empty
    table gives none, and without labels of both kinds nothing goes.
    """
    return toxicity.keep_clean(docs, sf_dir)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, one row of it.

    Null, empty and blank texts are one group; rows without an id come after
    all others; an empty table gives none.
    """
    return simhash.keep_one(docs, SIMILARITY, SHINGLE)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or paraphrased, go, rows without an id too.

    Null and empty texts stay, repeated rows go or stay together; an empty
    table gives none, and without a benchmark nothing goes.
    """
    return lsa.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret that the ledger has for a text's blob is replaced by a mask; n_chars follows the text.

    All rows stay, repeated ones too; a null text stays null and has 0
    characters; an empty table gives none.
    """
    return secret_ledger.redact(docs, secret_ledger.ledger_path(spark)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, checked by decoding; a null text has none."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", tokenise),
]

#: Trained models, graphs and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
