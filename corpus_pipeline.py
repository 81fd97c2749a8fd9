"""From raw documents to packed sequences: five stages, each reading what the one before it has written.

Every stage but the last returns the columns it was given, of whatever names. Defined results of odd input: a
document of null or empty text, or without a letter, is rejected by the first stage; of documents that
repeat a doc_id, those of unrelated texts stay, each for itself; a null doc_id, lang or source is a value like
another; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import decontaminate, langid, neardup, packing, quality
from strandframe.llm.common import discard, stash, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model, fitted on the labelled ones, knows."""
    return langid.accepted(docs, langid.train(langid.training_rows(docs)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are not depleted of lines of their own; boilerplate lines leave their texts.

    ``n_chars`` follows the text where lines were taken out.
    """
    left = quality.accepted(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near-duplicates."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No SQL gives tokenizer ids, naive Bayes scores or edit distances; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before:
            discard(spark, before)
        before = path
    return docs
