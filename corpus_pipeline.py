"""From raw documents to packed token sequences, in stages that each apply one operator.

A stage gets what its predecessor kept and returns the columns of documents; the
last returns pieces of sequences. Between stages the documents are stored, so a
lost executor costs at most a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import langid, linedup, packing, pii, simhash
from scorelake.llm.common import prepare
from scorelake.llm.queries import vocabulary
from scorelake.session import cut_lineage

#: Texts farther than this from every learned language are rejected; real texts score from 0.35 on.
MIN_LANGUAGE_SCORE = 0.2


def _with_text(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The struct ``doc`` unfolded, with the new ``text`` and its length in place of the old."""
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return packed.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language learned from the documents themselves, go."""
    prepare(spark)
    found = langid.predict_languages(docs, langid.learn_profiles(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines of 50 words or more go, and documents of which nothing stays."""
    prepare(spark)
    found = linedup.delete_repeated_lines(docs, min_words=50)
    emptied = (F.col("removed") > 0) & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    return _with_text(found.where(~F.coalesce(emptied, F.lit(False))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it become the names of their kinds."""
    clean = pii.sanitise(docs)
    length = F.length("text").cast("bigint")
    return clean.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in clean.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 4096 tokens; each ends with id 2."""
    prepare(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language", known_language),
    ("line dedup", repeated_lines),
    ("near dedup", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack_sequences),
]

#: Language profiles, components and a tokenizer: no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
