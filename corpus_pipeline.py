"""From raw documents to packed sequences: five stages, each one operator of muster.llm.

A stage takes what its predecessor kept and returns the columns of documents; the last one
returns packed pieces. Each stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import mixing, packing, simhash, surrogates, toxicity
from muster.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject.

    Null and empty texts are scored like a text without words. Rows without a doc_id are
    scored, but teach nothing; repeated rows go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(spark, docs.select(*COLUMNS), toxicity.train(docs, labels))
    return scored.where("toxicity < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates.

    Rows without a doc_id come after all others, and null, empty and wordless texts are one
    group. Of several texts under one doc_id those that are no near duplicates all stay.
    """
    return simhash.first_of_each(spark, docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; null and empty texts stay."""
    return _counted(surrogates.replace_entities(spark, docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix reads them: a row for each time, the last one of a source cut.

    Documents without words, null texts among them, are in no mix. Null sources are one.
    """
    docs = docs.select(*COLUMNS)
    return _counted(mixing.read_mix(docs, written(spark, mixing.mix(spark, docs), "mix")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; each row is a document, whatever its doc_id."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hash voting, a fitted classifier and tokenizing have no SQL. Tests hold each stage against what
#: its docstring says, on odd rows too; there is no row-at-a-time version of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
