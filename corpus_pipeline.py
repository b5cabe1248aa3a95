"""From raw documents to token files: five stages, each over all that the last one kept."""

from pyspark.sql import DataFrame, SparkSession

from mastline.llm import decontaminate, mixture, quality_rules, simhash, token_files
from mastline.llm.queries import tokenizer_path
from mastline.llm.runtime import on_workers, stored, table
from mastline.workspace import new_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score below 0.3 go."""
    on_workers(spark)
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.accepted(docs, model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, that with the smallest id."""
    on_workers(spark)
    return simhash.distinct_documents(docs, shingle=3, radius=2)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    on_workers(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become what the mix takes of them, a row for each pass."""
    on_workers(spark)
    return mixture.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back."""
    on_workers(spark)
    folder = new_folder(spark, "tokens")
    token_files.write(docs, folder, tokenizer_path(), end_id=0)
    return token_files.read(spark, folder)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_id_output", token_output),
]

#: SQL can express neither the trained model nor SimHash groups; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
