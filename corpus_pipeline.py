"""Corpus preparation in stages, each a step over all documents that its predecessor kept.

Rows are kept or dropped whole: columns keep their names and values, also names that an operator uses.
A filter that has nothing to learn from keeps every row. Rows with a null id are never duplicates; of rows
that repeat an id and its text one stays, rows that repeat an id with another text count by their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asnwatch.llm import jaccard_join, langid, packing, quality_model
from asnwatch.llm.common import checkpointed, id_bucket, read

#: Scores below these are rejected.
QUALITY = 0.5
LANGUAGE = 0.5


def _filtered(docs: DataFrame, judge: Callable[..., DataFrame], keep: Column) -> DataFrame:
    """Rows of ``docs`` that ``judge`` gives ``keep``. The columns go along under other names, so nothing is shuffled."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = judge(plain, id_column=f"c{names.index('doc_id')}", text_column=f"c{names.index('text')}", carry=tuple(plain.columns))
    return judged.filter(keep).select(plain.columns).toDF(*names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects; it learns from ``labels``."""
    model = quality_model.train(docs, read(spark, sf_dir, "labels").filter(id_bucket(3) != 1))
    return _filtered(docs, lambda df, **names: quality_model.score(df, model, **names), F.col("score") >= QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those not likelier in one than in all other languages together that the
    documents' own ``lang`` column teaches. A text in an untaught language goes to the nearest taught one."""
    model = langid.train(docs.filter(id_bucket(4) != 2))
    if not model.languages:
        return docs
    keep = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE)
    return _filtered(docs, lambda df, **names: langid.identify(df, model, **names), keep)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near duplicates the document with the smallest id."""
    return jaccard_join.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: Trained models and tokenizers are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one keeps is stored before the next one reads it, more than once."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
