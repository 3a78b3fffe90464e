"""The corpus pipeline: its stages, in order, over the table ``documents``.

Toxic documents go; one document of each group of near-duplicates stays; documents that hold a
benchmark window go; personal data is blanked in the texts (``n_chars`` follows, where there is
such a column); what is left is packed into token sequences. Each stage but the last returns
the columns of its input and keeps rows with null ids, null or empty texts and repeated rows as
its operator defines; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credline.llm import decontaminate, neardup, packing, pii, toxicity
from credline.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs, packing.tokenizer_path()))


STAGES = [("toxicity", toxicity_stage), ("neardup", neardup_stage), ("decontaminate", decontaminate_stage),
          ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # toxicity and packing are not expressible; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
