"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. All but the last return the columns of `documents`; the last
returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textshield import runtime
from textshield.llm import exact, langid, packing, quality, simhash

#: Least cosine with the prototype of the predicted language. Texts of known languages, however short, lie far above it.
LEAST_COSINE = 0.25

#: Near copies: texts are candidates if one of their fingerprints of two-word shingles is within this many bits of the
#: other's, and copies if their five-word shingles have this Jaccard similarity (README: how many such pairs are reached).
SHINGLE, RADIUS, PRINTS, WORDS, SIMILARITY = 2, 5, 4, 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; prototypes come from the documents' own labels.

    Null texts and those without a letter go. Repeated rows and ties get the same answer, a null identifier or label has
    no effect on a document, whole texts are read, an empty table stays empty, and all columns stay, whatever their names.
    """
    return langid.told(docs, langid.fit(docs), LEAST_COSINE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like some language's references.

    Null and empty texts go. Edge cases are otherwise those of the first stage.
    """
    return quality.kept_rows(docs, quality.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, A-Z lower-cased: that of the largest identifier (null last), of repeated rows one.

    Null counts as empty. All columns stay, whatever their names; an empty table stays empty.
    """
    return exact.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest identifier (null last), of repeated rows one.

    Texts of fewer than five words resemble only equal ones. All columns stay, whatever their names; an empty table stays
    empty.
    """
    return simhash.kept_rows(docs, shingle=SHINGLE, radius=RADIUS, prints=PRINTS, words=WORDS, least=SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences; edge cases are those of packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on. An empty table gives no pieces."""
    docs = runtime.spread(runtime.load(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = runtime.shared_dir(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
