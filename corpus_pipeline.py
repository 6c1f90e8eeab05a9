"""Corpus preparation: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import materialize, small, table
from emberlog.llm.decontamination import with_overlaps
from emberlog.llm.language_id import held_out, train, with_language
from emberlog.llm.line_dedup import drop_repeated_lines
from emberlog.llm.mixing import mix, word_count
from emberlog.llm.simhash_similar import similar_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the ones too far from any are left out.

    ``lang`` is the predicted language.  The model learns from the rows that it is
    given and that the held-out rule leaves; without any, nothing can be judged and
    all documents stay.
    """
    labelled = docs.where(~held_out()).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if labelled.isEmpty():
        return docs.select(*COLUMNS)
    found = with_language(docs, train(labelled)).where("NOT rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document of which nothing is left by that."""
    kept = drop_repeated_lines(docs).where("n_dropped = 0 OR length(text) > 0")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates; documents without an id stay."""
    found = similar_documents(docs.select("doc_id", "text"))
    # written first: a join that knows how few they are moves no texts
    gone = materialize(found.where("doc_id != component_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return with_overlaps(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``copies``, how often the mix takes them; those that it does not take go."""
    docs = mix(docs.select(*COLUMNS), word_count(F.col("text"))).where("taken > 0")
    return docs.select(*COLUMNS, "size", "source_size", "target", (F.col("taken") / F.col("size")).cast("int").alias("copies"), "taken")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: Fitted models and fingerprints are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
