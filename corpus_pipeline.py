"""Training-data pipeline: raw documents to token ids.

``STAGES`` are (name, function) pairs; every function takes (spark, docs,
sf_dir) and works on all that its predecessor kept.  ``run`` applies them to
``documents``; each result is written as Parquet under the shared checkpoint
folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, mixing, ngram_join, pii, sentencepiece
from lectern.llm.catalog import tokenizer_path
from lectern.llm.common import crc_mod, discard, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS, PERCENT = 5, 80      # shingles and least similarity of near copies; op5 has its own


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a
    letter go.  Short or mixed texts have low scores but are not dirty, so no
    score is asked for.  Where the language is missing, the network's stands in."""
    net = language.train(language.training_sample(docs, crc_mod("doc_id", 5) != 0))
    scored = language.classify(docs.select(*COLUMNS), net)
    kept = scored.filter(F.col("lang_pred") != language.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies: five-word shingles, similarity 0.8."""
    scratch: list[DataFrame] = []
    joined = materialize(ngram_join.join(docs, words=WORDS, percent=PERCENT, scratch=scratch), "classes")
    discard(*scratch)
    return ngram_join.one_of_each(docs.select(*COLUMNS), joined)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    fixed = pii.replace(docs.select(*COLUMNS))
    return fixed.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text")).otherwise(F.col("n_chars"))
                            .cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, and whether they decode to the text."""
    path = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece.decode_ids(sentencepiece.encode_texts(docs.select(*COLUMNS), path), path)
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_ids"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("pii_surrogates", personal_data),
    ("source_mix", source_mix),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        result = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            discard(docs)
        docs = result
    return docs


#: The recurrent network and the search have no SQL; tests compare with plain versions.
ORACLE_SQL = None
