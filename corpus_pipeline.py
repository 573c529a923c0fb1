"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastermill.llm.decontamination import remove_contaminated
from rastermill.llm.mixing import mix_sources, take_copies
from rastermill.llm.near_dedup import NearDedup, near_duplicates
from rastermill.llm.quality_rules import quality_rules
from rastermill.functions.store import Scratch, read_table
from rastermill.llm.token_files import encode_documents

#: The scratch tables of the stage that ran last on a folder; its result is written once the next stage starts.
_open: dict[tuple[str, int], Scratch] = {}


def _scratch(spark: SparkSession, sf_dir: str, stage: int) -> Scratch:
    if (sf_dir, stage - 1) in _open:
        _open.pop((sf_dir, stage - 1)).release()
    _open[sf_dir, stage] = Scratch(spark, f"stage-{stage}")
    return _open[sf_dir, stage]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; null and empty texts don't."""
    return quality_rules(docs, scratch=_scratch(spark, sf_dir, 0), keep=True).where("kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Of rows that repeat an id and a text, or an id and nearly a text, one stays;
    rows without an id are in no group and stay.
    """
    found = near_duplicates(docs, NearDedup(words=5), scratch=_scratch(spark, sf_dir, 1)).where("kept")
    # one text of each component, then one row of each id and text
    one = found.groupBy("doc_id", "component").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    rows = docs.where("doc_id is not null").select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("text_hash"))
    rows = rows.join(one, ["doc_id", "text_hash"], "left_semi").select("row", nth.alias("nth")).where("nth = 1").select("row.*")
    return rows.unionByName(docs.where("doc_id is null"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of `benchmark` occurs."""
    return remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"), scratch=_scratch(spark, sf_dir, 2))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take_copies(docs, mix_sources(docs, scratch=_scratch(spark, sf_dir, 3)))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the token files."""
    return encode_documents(docs, scratch=_scratch(spark, sf_dir, 4))


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", keep_one_of_each),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
    ("token output", write_tokens),
]

#: Counts of n-grams, MinHash and random rounding aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    between = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = between.save(docs, f"stage-{k}")
    return docs
