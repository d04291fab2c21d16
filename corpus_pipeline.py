"""A corpus pipeline: stages that each take the documents the stage before has kept.

run(spark, sf_dir) applies STAGES to the documents table. Every stage's result is written as Parquet
and read again as the next one's documents, in the shared folder.

In every stage a null text counts as empty, long texts are read whole, further columns stay whatever their names, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirel.llm import exact_dedup, mixing, similar, spm, toxicity
from quirel.llm.common import stored
from quirel.llm.queries import table, tokenizer_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text isn't scored toxic; rows that repeat are decided alike, a tie at 0.5 goes."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; null ids lose to others, and of repeated rows one stays."""
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shared five-word shingles link (Jaccard of 0.8 or more).

    Texts without words are one group; of rows that share an id the smallest digest counts; null ids all stay.
    """
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is one of its own, rows that repeat an id and a source get the same draw."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the number of their texts' pieces and the digests of the ids and of the decoded text; an empty text has the end id alone."""
    found = spm.encode(docs, tokenizer_model(), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]

#: The first stage's scores and the fingerprints can't be told in SQL; tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
