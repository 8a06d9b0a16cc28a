"""The corpus pipeline: the stages applied to `documents`, one after another.

1. toxicity: a scorer is learned from `labels`; documents that it marks toxic go.
2. quality: a classifier is learned from `labels`; documents below its threshold go.
3. near duplicates: sets of five-word shingles that overlap by 0.8 or more link; of each class the
   document of the least id stays.
4. decontamination: documents that are contaminated by `benchmark` go; the others stay as they are.
5. packing: what is left is tokenised and packed into sequences; a row for each piece.

All stages but the last return the columns of their input, whatever their names. Only the third
moves texts, and of these only the few that a filter can't tell apart from dropped ones. Rows are
judged one by one, so repeated rows share their fate but for the third stage, where one of a class
stays. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewell.llm import op2_quality, op5_decontamination, op6_jaccard, op7_packing, op9_toxicity
from lodewell.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no hit and stay, as all do without labels; null ids are never learned from."""
    return op9_toxicity.keep(docs, op9_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are judged as empty ones are; without labels every score is 0.5 and all stay."""
    return op2_quality.keep(docs, op2_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words are alike to none: of these only repeated rows (id and text) fall together. Rows without id give way to those with one."""
    return op6_jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words and stay; tests without id, text or words have no phrase."""
    return op5_decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty documents of one token; each row has its pieces, repeated rows too."""
    return op7_packing.pack(docs, op7_packing.vocabulary_path())


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Learned models and token packing cannot be stated in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
