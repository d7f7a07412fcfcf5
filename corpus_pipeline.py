"""A corpus pipeline: language ID, near-duplicate removal, secret redaction, mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``; every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``. All read whole texts and take tables without rows, extra columns of any name and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import bpe, langid, mixing, secrets, simhash
from sylva.llm.common import save

#: SQL has neither the learned classifiers, the network nor the merges.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter (``und``; null and empty texts, too) and those whose language is ambiguous, as
    a tie is; where no label teaches a language, only those without any letter. Repeated rows meet one fate."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group, all its rows where an id is repeated; rows
    without an id stay."""
    later = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id")
    # Joined by name, and columns picked by quoted names, so that extra columns may be called anything.
    return docs.join(later, "doc_id", "left_anti").select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every finding in the text; documents themselves stay, null and empty texts as they are."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source meets its share; null is a source of its own. Texts without words
    count nothing and come as often as others of their source, none where the whole source has no words."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes each document of the mixture and decodes it again; null is empty and has no tokens."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secret_redaction", secret_redaction),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
