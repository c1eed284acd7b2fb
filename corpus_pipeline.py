"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last one returns packed pieces.
``run`` writes every stage's result as Parquet and reads it back, so a lost
executor costs at most the stage at hand. Rows travel as one struct beside the
columns that an operator reads, so further columns of any name pass through.

In every stage a null text counts as empty, a null id or source is a value like
others, an empty table gives an empty one with the same columns, and rows that
repeat are judged alike, each by itself, but for near_dedup, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import line_quality, packing, pii, rules, simhash
from latticework.llm.scratch import materialize

#: The key of this demonstration's pseudonyms. A deployment passes its own secret.
PSEUDONYM_KEY = b"latticework demonstration key"


def _with_text(row: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``_row``'s columns with its text replaced, and n_chars, where there is one, to match."""
    out = []
    for name in columns:
        value = F.col("_row").getField(name)
        if name == "text":
            value = F.col(text)
        elif name == "n_chars":
            value = F.length(text).cast(row.schema["_row"].dataType["n_chars"].dataType)
        out.append(value.alias(name))
    return row.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-frequency rules, without the lines above the limits.

    Null and empty texts have too few words and go. A null source is a host of its own.
    A line that lies exactly at a limit stays.
    """
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))
    judged = line_quality.line_frequency_verdicts(rows, carry=("text", "_row"))
    return _with_text(judged.where("kept"), docs.columns, "clean_text")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more; exactly 0.5 stays.

    Without a usable label every score is 0.5, so all documents stay. Labels of documents that
    earlier stages rejected are not learnt from.
    """
    model = rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select("text", F.struct("*").alias("_row"))
    return rules.score(rows, model, keep=("_row",)).where("score >= 0.5").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are similar in 0.8 or more of their five-word shingles.

    The smallest id of a group stays, null ids last; of rows with one id and one text one stays.
    All texts without a word are one group.
    """
    return simhash.keep_one_of_each_group(docs, shingle_words=5, similarity=0.8)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by format-preserving pseudonyms. A null text stays null."""
    replaced = pii.pseudonymize(docs, PSEUDONYM_KEY, with_counts=False)
    if "n_chars" not in docs.columns:
        return replaced
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 4096 tokens.

    A null or empty text is one piece, the closing id alone. Repeated rows are packed each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("bins", "generations", "migrations")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("pack", pack),
]

#: No SQL: the classifier, the groups of similar texts and the packing are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
