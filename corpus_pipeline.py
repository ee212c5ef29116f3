"""The training-data pipeline: STAGES in order, each over all that the stage before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to
the shared folder and reads it again as the next one's documents. All stages but the last return the
columns of ``documents``; the last adds each document's place in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontaminate, mixing, near, secrets, toxicity
from tilewright.llm.common import read_table, staged

#: Documents of at least this score are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC; the lexicon is learned from the labelled rows of these documents.

    Null texts have the score of a text without words and stay.
    """
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.learn_lexicon(toxicity.labelled_rows(docs.select("doc_id", "text"), labels))
    return toxicity.drop_toxic(docs, lexicon, limit=TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose 5-word shingle sets are linked by a similarity of 0.8 or more."""
    return near.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without four fifths of the 5-word shingles of any test item of five words or more."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by its kind in brackets; n_chars follows the text."""
    return secrets.redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with mix_slot, mix_rank and mix_block (with _ at the end where documents have such a name): reading by (mix_slot, mix_rank) gives the mix."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

#: SQL can't express the learned lexicon and the Markov models of two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, in the form that the last returns."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
