"""The corpus pipeline over ``documents``: each stage gets what the stage before kept, and all but the last return its columns.

1. quality classifier: documents that it rejects go;
2. MinHash near-dedup: one document of each group of copies and near copies stays;
3. substring dedup: words of passages that repeat go from the texts;
4. source mixing: documents come as often as the mix takes them;
5. best-fit packing: what is left as pieces in sequences.

Nulls and edges, in every stage: null and empty texts are documents without words, which the classifier scores as it does
others, near-dedup and substring dedup keep as they are, mixing takes 0 times and packing gives the end token alone; a null
doc_id or source is a value like another; rows that repeat an id are told apart by their text, and rows equal in both are
copies, of which near-dedup keeps one; very long texts are read whole; ties are settled by hashes, so that reruns agree; an
empty table gives an empty table; other columns are carried along untouched, but n_chars follows a text that is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import near_dedup, packing, quality, source_mixing, substring_dedup
from lodestone.llm.common import materialise, read
from lodestone.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' models and hashes are beyond SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
