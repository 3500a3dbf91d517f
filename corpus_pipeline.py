"""From raw documents to token files: reject poor texts, keep one of each group of near copies, drop texts that hold benchmark
passages, mix sources to their weights, and write token-id files.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
`documents`; the last returns the index of the token files. Rows that mixing takes twice are two documents from there on.
"""

from pyspark.sql import DataFrame, SparkSession

from scenelake.llm.catalog import table
from scenelake.llm.contamination import decontaminated
from scenelake.llm.mixing import mixed
from scenelake.llm.near_dups import deduplicated
from scenelake.llm.quality import good_documents
from scenelake.llm.token_files import public_tokenizer, token_index
from scenelake.scale import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_index(docs, public_tokenizer())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]
ORACLE_SQL = None                                # classifier and tokenizer are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
